"""Morphology as joins of literal dimensions and anchored patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Pronouns, tense particles, suffixes.
PRONOUNS = [("1sg", "n", "I"), ("2sg", "i", "you"), ("3sg", "a", "he/she/it"), ("1pl", "an", "we"), ("2pl", "aw", "you all"), ("3pl", "alu", "they")]
TENSES = [("progressive", "bɛ"), ("neg_progressive", "tɛ"), ("completive", "ka"), ("neg_completive", "ma"), ("future", "na"), ("future_progressive", "bɛ na"), ("imperative", "")]
PREFIXES = ["la", "ma", "na"]
SUFFIXES = ["lu", "li", "la", "ya", "baga", "len", "to", "ma", "ntan", "nin", "ba", "ka"]


def _dim(spark: SparkSession, rows, names: list[str]) -> DataFrame:
    each = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, r, strict=True))) for r in rows))
    return spark.range(1).select(F.explode(each).alias("r")).select("r.*")


def paradigm(spark: SparkSession, verbs: DataFrame, verb: str) -> DataFrame:
    """Every verb in every tense and person; the imperative has second persons only and no particle."""
    people = _dim(spark, PRONOUNS, ["person", "pronoun", "gloss"])
    tenses = _dim(spark, TENSES, ["tense", "particle"])
    grid = verbs.select(F.col(verb).alias("verb")).crossJoin(F.broadcast(people)).crossJoin(F.broadcast(tenses))
    imperative = F.col("tense") == "imperative"
    form = F.when(imperative, F.col("verb")).otherwise(F.concat_ws(" ", "pronoun", "particle", "verb"))
    return grid.where(~imperative | F.col("person").isin("2sg", "2pl")).select("verb", "tense", "person", form.alias("form"))


def decompose(word: Column, prefixes: list[str] = PREFIXES, suffixes: list[str] = SUFFIXES, least: int = 2) -> Column:
    """struct(prefix, root, suffix): one anchored pattern, longest affixes first, a root of at least ``least`` letters."""
    p = "|".join(sorted(prefixes, key=lambda x: (-len(x), x)))
    s = "|".join(sorted(suffixes, key=lambda x: (-len(x), x)))
    pattern = f"^({p})?(.{{{least},}}?)((?:{s})?)$"
    return F.struct(F.regexp_extract(word, pattern, 1).alias("prefix"), F.regexp_extract(word, pattern, 2).alias("root"), F.regexp_extract(word, pattern, 3).alias("suffix"))


# Roots of compounds (gloss, class), known compounds (parts, meaning, head), affixes in the order they are looked up.
COMPOUND_ROOTS = {
    "so": ("house", "noun"), "da": ("mouth/create", "noun"), "ji": ("water", "noun"), "bo": ("exit", "verb"), "fo": ("say", "verb"), "kan": ("language/word", "noun"), "mogo": ("person", "noun"), "den": ("child", "noun"),
    "ba": ("mother/big", "noun"), "fa": ("father", "noun"), "ke": ("do/make", "verb"), "taa": ("go", "verb"), "naa": ("come", "verb"), "don": ("know/enter", "verb"), "min": ("drink", "verb"), "sira": ("road", "noun"),
    "dugu": ("village/land", "noun"), "muso": ("woman", "noun"), "ce": ("man", "noun"), "ye": ("see", "verb"), "se": ("be able", "verb"), "fe": ("want/near", "verb"), "lu": ("plural", "suffix"), "tigi": ("owner/chief", "noun"),
    "fin": ("black/dark", "adj"), "je": ("white/clear", "adj"), "kele": ("battle/war", "noun"), "sebe": ("write", "verb"), "kara": ("read", "verb"), "nko": ("clear language", "noun"), "dumu": ("food/eat", "noun"), "sila": ("travel", "verb"),
    "wolo": ("give birth", "verb"), "kolo": ("bone/hard", "noun"), "fili": ("lose", "verb"), "bolo": ("hand", "noun"),
}
KNOWN_COMPOUNDS = {
    "soda": ("so+da", "doorway", "so"), "jibo": ("ji+bo", "spring/fountain", "bo"), "kanmogo": ("kan+mogo", "linguist/interpreter", "mogo"), "dugutigi": ("dugu+tigi", "village chief", "tigi"), "denba": ("den+ba", "birth mother", "ba"),
    "fokan": ("fo+kan", "speech/language", "kan"), "siradon": ("sira+don", "guide", "don"), "nkosebe": ("nko+sebe", "N'Ko script", "sebe"), "musoden": ("muso+den", "daughter", "den"), "ceden": ("ce+den", "son", "den"),
    "sofin": ("so+fin", "prison", "so"), "duguji": ("dugu+ji", "well water", "ji"), "sirakele": ("sira+kele", "roadblock/obstacle", "kele"), "jidon": ("ji+don", "well/water source", "don"),
}
AFFIXES = [
    ("prefix", "ߟߊ߬", "la", "CAUS"), ("prefix", "ߡߊ߬", "ma", "BEN"), ("prefix", "ߣߊ߬", "na", "VEN"),
    ("derivational", "ߟߌ", "li", "AGENT"), ("derivational", "ߓߊ", "ba", "AGENT"), ("derivational", "ߟߊ߲", "lan", "CAUS"), ("derivational", "ߦߊ", "ya", "QUAL"), ("derivational", "ߡߊ", "ma", "POSS"), ("derivational", "ߣߊ", "na", "INSTR"), ("derivational", "ߟߊ", "la", "LOC"), ("derivational", "ߘߋ߲", "den", "DIM"),
    ("inflectional", "ߟߎ", "lu", "PL"), ("inflectional", "ߟߊ", "la", "PFV"), ("inflectional", "ߕߐ", "to", "PROG"), ("inflectional", "ߓߐ", "bo", "ABL"), ("inflectional", "ߘߏ߲", "don", "ILL"),
    ("postposition", "ߟߊ", "la", "LOC"), ("postposition", "ߘߐ", "do", "INESS"), ("postposition", "ߞߊ߲", "kan", "SUPER"), ("postposition", "ߝߍ", "fe", "PROX"), ("postposition", "ߦߋ", "ye", "ALL"), ("postposition", "ߓߟߏ", "bolo", "DIR"),
]


def affix_forms() -> dict[str, tuple[str, str, str, str]]:
    """The affix that each form, in the script or in lower-case Latin letters, stands for."""
    out: dict[str, tuple[str, str, str, str]] = {}
    for kind in dict.fromkeys(a[0] for a in AFFIXES):  # within a kind the script's forms are tried before Latin ones
        own = [a for a in AFFIXES if a[0] == kind]
        for place in (1, 2):
            for a in own:
                out.setdefault(a[place], a)
    return out


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])


def affix(form: Column) -> Column:
    """struct(kind, latin, gloss) of an affix by its form in either script, nulls if there is none."""
    forms = affix_forms()
    key = F.when(form.rlike("^[A-Za-z]+$"), F.lower(form)).otherwise(form)
    return F.struct(*(F.try_element_at(_map({k: v[i] for k, v in forms.items()}), key).alias(n) for i, n in ((0, "kind"), (2, "latin"), (3, "gloss"))))


ROOT_PATTERN = "|".join(sorted(COMPOUND_ROOTS, key=lambda x: (-len(x), x)))


def compound(word: Column) -> Column:
    """struct(parts, head, literal, meaning, confidence) of a compound in lower-case Latin
    letters: a known one, or roots from the left, longest first, with what is left as a
    part of unknown meaning; at least two parts, the last noun being the head. Else null."""
    taken = F.regexp_extract(word, f"^((?:{ROOT_PATTERN})*)", 1)
    roots = F.regexp_extract_all(taken, F.lit(f"({ROOT_PATTERN})"), F.lit(1))
    rest = F.substr(word, F.length(taken) + 1)
    parts = F.when(F.size(roots) == 0, F.array().cast("array<string>")).when(rest == "", roots).otherwise(F.concat(roots, F.array(rest)))
    gloss, kind = (_map({k: v[i] for k, v in COMPOUND_ROOTS.items()}) for i in (0, 1))
    nouns = F.filter(roots, lambda r: F.try_element_at(kind, r) == "noun")
    literal = F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(gloss, p), F.lit("?"))), "-")
    known = [_map({k: v[i] for k, v in KNOWN_COMPOUNDS.items()})[word] for i in range(3)]
    known_literal = F.array_join(F.transform(F.split(known[0], "[+]"), lambda p: F.try_element_at(gloss, p)), "-")
    is_known = known[0].isNotNull()
    greedy = F.size(parts) >= 2
    return F.when(is_known | greedy, F.struct(
        F.when(is_known, known[0]).otherwise(F.array_join(parts, "+")).alias("parts"), F.when(is_known, known[2]).otherwise(F.try_element_at(nouns, F.lit(-1))).alias("head"),
        F.when(is_known, known_literal).otherwise(literal).alias("literal"), F.when(is_known, known[1]).otherwise(F.concat(F.lit("("), literal, F.lit(")"))).alias("meaning"),
        F.when(is_known, 1.0).otherwise(0.7).alias("confidence"),
    ))


def generated(spark: SparkSession) -> DataFrame:
    """(first, second, word, literal, kind, confidence): hypothetical compounds of any two known roots."""
    roots = _dim(spark, [(k, *v) for k, v in COMPOUND_ROOTS.items()], ["root", "gloss", "kind"])
    a, b = roots.alias("a"), roots.alias("b")
    kind = F.concat_ws("-", "a.kind", "b.kind")
    return a.crossJoin(F.broadcast(b)).select(  # 36 x 36 rows
        F.col("a.root").alias("first"), F.col("b.root").alias("second"), F.concat("a.root", "b.root").alias("word"), F.concat_ws("-", "a.gloss", "b.gloss").alias("literal"),
        F.when(kind.isin("noun-noun", "noun-verb", "verb-noun", "adj-noun", "noun-adj", "verb-verb"), kind).otherwise("noun-noun").alias("kind"), F.lit(0.5).alias("confidence"),
    )


def noun_class(word: Column) -> Column:
    """A class hint by the word's ending."""
    return F.when(word.endswith("baga"), "agent").when(word.endswith("ya"), "abstract").when(word.endswith("nin"), "diminutive").when(word.endswith("ba"), "augmentative").when(word.endswith("lu"), "plural").otherwise("common")
