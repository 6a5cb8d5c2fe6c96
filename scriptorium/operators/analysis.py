"""Word analysis: an ordered cascade of lookups as column expressions.

Roots are found by one anchored alternation, longest first; chains of suffixes by
taking all suffix tokens and asking that they make up the whole remainder, which is
the greedy chain.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists in Latin letters, in the cascade's order.
PRONOUNS = ["n", "i", "a", "an", "alu", "awu"]
TENSE_MARKERS = ["be", "te", "ka", "ma", "na", "bena"]
POSTPOSITIONS = ["la", "do", "kan", "fe", "ye", "bolo"]
SUFFIXES = ["li", "ba", "lan", "ya", "ma", "na", "la", "den"]
PLURAL = "lu"
PREFIXES = ["la", "ma", "na"]
VERBS = {
    "taa": "go", "naa": "come", "ke": "do/make", "fo": "say", "don": "enter", "min": "drink", "sodo": "know", "bo": "exit/leave", "do": "stay/remain", "ye": "see", "landi": "understand", "kalan": "speak/tell",
    "sebe": "write", "kara": "read", "di": "give", "mako": "return", "so": "buy", "fe": "want", "se": "be able", "men": "hear", "sila": "travel", "ta": "take", "da": "learn",
}
NOUNS = {
    "mogo": ("person", "person"), "den": ("child", "person"), "muso": ("woman", "person"), "ce": ("man", "person"), "so": ("house", "thing"), "jama": ("market", "place"), "ji": ("water", "liquid"), "dumu": ("food/rice", "mass"),
    "sira": ("road", "thing"), "kuru": ("boat", "thing"), "kan": ("language/word", "abstract"), "dugu": ("land/soil", "place"), "sebe": ("writing/book", "thing"), "faa": ("father", "kinship"), "baa": ("mother", "kinship"), "togo": ("name", "abstract"),
    "ja": ("money", "thing"), "du": ("earth/land", "place"), "sa": ("rain/sky", "abstract"), "fen": ("food", "mass"),
}
CLASS_HINTS = {"ya": "abstract", "li": "abstract", "lan": "abstract", "den": "person", "ba": "person"}
STRUCTURES = [("pronoun-particle-verb", "STV (Subject-Tense-Verb)"), ("pronoun-particle-verb-noun", "STVO (Subject-Tense-Verb-Object)"), ("noun-particle-verb", "STV (Noun Subject-Tense-Verb)"), ("noun-postposition", "NP (Noun Phrase + Postposition)"), ("noun-noun", "NN (Compound / Genitive)")]


def longest(words) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


CHAIN = longest([*SUFFIXES, PLURAL])


def _rest(word: Column, root: Column) -> Column:
    return F.substr(word, F.length(root) + 1)


def _chain(rest: Column) -> tuple[Column, Column]:
    """(suffixes, whether they make up the rest)."""
    parts = F.regexp_extract_all(rest, F.lit(f"({CHAIN})"), F.lit(1))
    return parts, (F.size(parts) > 0) & (F.array_join(parts, "") == rest)


def _struct(kind, confidence, prefix, root, suffixes, noun_class) -> Column:
    empty = F.lit("")
    return F.struct(
        F.lit(kind).alias("word_class"), confidence.alias("confidence"), (prefix if prefix is not None else empty).alias("prefix"), (root if root is not None else empty).alias("root"),
        (suffixes if suffixes is not None else empty).alias("suffixes"), (noun_class if noun_class is not None else F.lit(None).cast("string")).alias("noun_class"),
    )


def _verb(word: Column, prefix: Column | None) -> tuple[Column, Column]:
    root = F.regexp_extract(word, f"^({longest(VERBS)})", 1)
    rest = _rest(word, root)
    parts, whole = _chain(rest)
    confidence = F.when(rest == "", 0.80).when(whole, 0.85).otherwise(0.60)
    if prefix is not None:
        confidence = F.round(F.least(confidence + 0.05, F.lit(1.0)), 2)
    return root != "", _struct("verb", confidence, prefix, root, F.when(whole, F.array_join(parts, "+")).otherwise(rest), None)


def analyze(word: Column) -> Column:
    """struct(word_class, confidence, prefix, root, suffixes, noun_class) of a word in lower-case Latin letters."""
    prefix = F.regexp_extract(word, f"^({'|'.join(PREFIXES)}).", 1)
    prefixed, prefixed_verb = _verb(_rest(word, prefix), prefix)
    plain, plain_verb = _verb(word, None)
    root = F.regexp_extract(word, f"^({longest(NOUNS)})", 1)
    rest = _rest(word, root)
    plural = rest.startswith(PLURAL)
    tail = F.when(plural, F.substr(rest, F.lit(len(PLURAL) + 1))).otherwise(rest)
    parts, whole = _chain(tail)
    after = tail.isin(POSTPOSITIONS)
    hints = F.create_map(*[F.lit(x) for kv in CLASS_HINTS.items() for x in kv])
    classes = F.create_map(*[F.lit(x) for k, (_, c) in NOUNS.items() for x in (k, c)])
    hinted = F.filter(F.transform(parts, lambda p: F.try_element_at(hints, p)), lambda h: h.isNotNull())
    noun_class = F.when(whole & ~after & (F.size(hinted) > 0), F.try_element_at(hinted, F.lit(-1))).otherwise(F.try_element_at(classes, root))
    found = F.when(after, tail).when(whole, F.array_join(parts, "+")).otherwise("")
    suffixes = F.concat_ws("+", F.when(plural, PLURAL), F.when(found != "", found))
    noun = _struct("noun", F.when(after, 0.85).when(plural, 0.90).otherwise(0.80), None, root, suffixes, noun_class)
    return (
        F.when(word.isin(PRONOUNS), _struct("pronoun", F.lit(0.95), None, None, None, None)).when(word.isin(TENSE_MARKERS), _struct("particle", F.lit(0.90), None, None, None, None))
        .when((prefix != "") & prefixed, prefixed_verb).when(plain, plain_verb).when(root != "", noun)
        .when(word.isin(POSTPOSITIONS), _struct("postposition", F.lit(0.85), None, None, None, None)).otherwise(_struct("unknown", F.lit(0.30), None, word, None, None))
    )


def noun_class(word: Column) -> Column:
    """The class of a noun: by root, by root less the plural, by ending; else null."""
    classes = F.create_map(*[F.lit(x) for k, (_, c) in NOUNS.items() for x in (k, c)])
    bare = F.regexp_replace(word, f"{PLURAL}$", "")
    out = F.coalesce(F.try_element_at(classes, word), F.try_element_at(classes, bare))
    hint = None
    for suffix, kind in CLASS_HINTS.items():
        cond = word.endswith(suffix) & (word != suffix)
        hint = F.when(cond, kind) if hint is None else hint.when(cond, kind)
    return F.coalesce(out, hint)


def structure(classes: Column) -> Column:
    """The first pattern in order that the joined classes begin with, so a longer pattern after its own beginning never comes."""
    joined = F.array_join(classes, "-")
    out = None
    for pattern, label in STRUCTURES:
        out = F.when(joined.startswith(pattern), label) if out is None else out.when(joined.startswith(pattern), label)
    return out.otherwise("unclassified")


def sql(w: str) -> str:
    """analyze() in DuckDB's SQL over column w: a SELECT list of word_class, confidence, prefix, root, suffixes, noun_class."""

    def q(words):
        return ", ".join(f"'{x}'" for x in words)

    def extract(x, pattern):
        return f"regexp_extract({x}, '{pattern}', 1)"

    def chain(x):
        return f"regexp_extract_all({x}, '{CHAIN}')"

    def whole(x):
        return f"(len({chain(x)}) > 0 AND array_to_string({chain(x)}, '') = {x})"

    p = extract(w, f"^({'|'.join(PREFIXES)}).")
    tail = f"substr({w}, length({p}) + 1)"
    pr, vr, nr = extract(tail, f"^({longest(VERBS)})"), extract(w, f"^({longest(VERBS)})"), extract(w, f"^({longest(NOUNS)})")
    prest, vrest, nrest = f"substr({tail}, length({pr}) + 1)", f"substr({w}, length({vr}) + 1)", f"substr({w}, length({nr}) + 1)"
    plural = f"starts_with({nrest}, '{PLURAL}')"
    nt = f"CASE WHEN {plural} THEN substr({nrest}, 3) ELSE {nrest} END"
    nt = f"({nt})"
    hints = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in CLASS_HINTS.items()) + "}"
    classes = "MAP {" + ", ".join(f"'{k}': '{c}'" for k, (_, c) in NOUNS.items()) + "}"
    hinted = f"list_filter(list_transform({chain(nt)}, lambda z: {hints}[z]), lambda z: z IS NOT NULL)"
    after = f"{nt} IN ({q(POSTPOSITIONS)})"
    kind = f"CASE WHEN {w} IN ({q(PRONOUNS)}) THEN 'pronoun' WHEN {w} IN ({q(TENSE_MARKERS)}) THEN 'particle' WHEN {p} <> '' AND {pr} <> '' THEN 'prefixed' WHEN {vr} <> '' THEN 'verb' WHEN {nr} <> '' THEN 'noun' WHEN {w} IN ({q(POSTPOSITIONS)}) THEN 'postposition' ELSE 'unknown' END"

    def confidence(rest, extra):
        return f"CASE WHEN {rest} = '' THEN {0.80 + extra:.2f} WHEN {whole(rest)} THEN {0.85 + extra:.2f} ELSE {0.60 + extra:.2f} END"

    def suffixes(rest):
        return f"CASE WHEN {whole(rest)} THEN array_to_string({chain(rest)}, '+') ELSE {rest} END"

    found = f"CASE WHEN {after} THEN {nt} WHEN {whole(nt)} THEN array_to_string({chain(nt)}, '+') ELSE '' END"
    return f"""CASE WHEN k = 'prefixed' THEN 'verb' ELSE k END AS word_class,
  CASE k WHEN 'pronoun' THEN 0.95::DOUBLE WHEN 'particle' THEN 0.90 WHEN 'prefixed' THEN {confidence(prest, 0.05)} WHEN 'verb' THEN {confidence(vrest, 0)} WHEN 'noun' THEN CASE WHEN {after} THEN 0.85 WHEN {plural} THEN 0.90 ELSE 0.80 END WHEN 'postposition' THEN 0.85 ELSE 0.30 END AS confidence,
  CASE k WHEN 'prefixed' THEN {p} ELSE '' END AS prefix, CASE k WHEN 'prefixed' THEN {pr} WHEN 'verb' THEN {vr} WHEN 'noun' THEN {nr} WHEN 'unknown' THEN {w} ELSE '' END AS root,
  CASE k WHEN 'prefixed' THEN {suffixes(prest)} WHEN 'verb' THEN {suffixes(vrest)} WHEN 'noun' THEN concat_ws('+', CASE WHEN {plural} THEN '{PLURAL}' END, CASE WHEN {found} <> '' THEN {found} END) ELSE '' END AS suffixes,
  CASE k WHEN 'noun' THEN CASE WHEN {whole(nt)} AND NOT ({after}) AND len({hinted}) > 0 THEN {hinted}[-1] ELSE {classes}[{nr}] END END AS noun_class""", kind
