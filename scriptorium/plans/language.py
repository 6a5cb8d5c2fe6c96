"""Queries of morphology, tagging and phonemes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean, fsm, script, translit
from ..operators import analysis
from ._base import query, quoted, sql_map, table
from .scripts import NATIVE, n, native, sub

SELECT, KIND = analysis.sql("w")
WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents"


def words(spark, d):
    return table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()


@query(f"SELECT w, {SELECT} FROM (SELECT w, {KIND} AS k FROM ({WORDS}))")
def word_analysis(spark, d):
    """MOR01, MOR02, MOR03: the cascade over distinct words."""
    return words(spark, d).select("w", analysis.analyze(F.col("w")).alias("a")).select("w", "a.*")


@query(f"SELECT word_class, count(*) AS n, round(avg(confidence), 9) AS confidence FROM (SELECT w, {SELECT} FROM (SELECT w, {KIND} AS k FROM ({WORDS}))) GROUP BY word_class")
def word_class_counts(spark, d):
    """AG31, MOR08."""
    a = words(spark, d).select(analysis.analyze(F.col("w")).alias("a")).select("a.*")
    return a.groupBy("word_class").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"))


_CLASSES = "MAP {" + ", ".join(f"'{k}': '{c}'" for k, (_, c) in analysis.NOUNS.items()) + "}"
_HINTS = " ".join(f"WHEN suffix(w, '{s}') AND w <> '{s}' THEN '{k}'" for s, k in analysis.CLASS_HINTS.items())


@query(f"SELECT w, coalesce({_CLASSES}[w], {_CLASSES}[regexp_replace(w, 'lu$', '')], CASE {_HINTS} END) AS noun_class FROM ({WORDS})")
def word_noun_classes(spark, d):
    """MOR04."""
    return words(spark, d).select("w", analysis.noun_class(F.col("w")).alias("noun_class"))


_FIRST = r"SELECT conv_id, turn, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')[1:4] AS f FROM conversations"
_LABEL = "CASE " + " ".join(f"WHEN starts_with(c, '{p}') THEN '{x}'" for p, x in analysis.STRUCTURES) + " ELSE 'unclassified' END"


@query(f"WITH t AS (SELECT conv_id, turn, unnest(f) AS w, generate_subscripts(f, 1) AS i FROM ({_FIRST})), a AS (SELECT conv_id, turn, i, CASE WHEN k = 'prefixed' THEN 'verb' ELSE k END AS k FROM (SELECT *, {KIND} AS k FROM t)) SELECT conv_id, turn, {_LABEL} AS structure FROM (SELECT conv_id, turn, string_agg(k, '-' ORDER BY i) AS c FROM a GROUP BY conv_id, turn)")
def conv_sentence_structure(spark, d):
    """MOR05: a pattern has at most four classes, so the first four words decide."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.slice(clean.words(F.lower("text")), 1, 4).alias("f")).where(F.size("f") > 0)
    return t.select("conv_id", "turn", analysis.structure(F.transform("f", lambda w: analysis.analyze(w)["word_class"])).alias("structure"))


#: Abbreviations of word classes in the order they are tried. Fixed values.
TAGS = [
    ("vt", "verb_transitive"), ("vi", "verb_intransitive"), ("vq", "verb_qualitative"), ("v", "verb"), ("n", "noun"), ("adj/n", "adjective_noun"), ("n/adj", "noun_adjective"), ("adj", "adjective"), ("adv", "adverb"), ("prep", "preposition"),
    ("pp", "postposition"), ("conj", "conjunction"), ("interj", "interjection"), ("pron", "pronoun"), ("num", "numeral"), ("dtm", "determiner"), ("part", "particle"), ("dem", "demonstrative"), ("quant", "quantifier"), ("expr", "expression"), ("idm", "idiom"),
]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_]){a}[.]') THEN '{b}'" for a, b in TAGS) + " END AS tag FROM documents")
def doc_part_of_speech(spark, d):
    """STR22: the first abbreviation of an ordered list."""
    out, low = None, F.lower("text")
    for a, b in TAGS:
        out = F.when(low.rlike(f"(^|[^\\p{{L}}\\p{{N}}_]){a}[.]"), b) if out is None else out.when(low.rlike(f"(^|[^\\p{{L}}\\p{{N}}_]){a}[.]"), b)
    return table(spark, d, "documents").select("doc_id", out.alias("tag"))


@query(
    f"""SELECT doc_id, len(regexp_extract_all(text, '[áéíóúÁÉÍÓÚ]')) AS high, len(regexp_extract_all(text, '[àèìòùÀÈÌÒÙ]')) AS low,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[^\\p{{L}}]', '', 'g'), '[áéíóúÁÉÍÓÚ]', '1', 'g'), '[àèìòùÀÈÌÒÙ]', '2', 'g'), '[^12]', '0', 'g')) AS pattern FROM documents"""
)
def doc_tone_pattern(spark, d):
    """STR23: marked high 1, marked low 2, other letters 0."""
    high, low = "[áéíóúÁÉÍÓÚ]", "[àèìòùÀÈÌÒÙ]"
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "[^\\p{L}]", ""), high, "1"), low, "2"), "[^12]", "0")
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(high)).cast("long").alias("high"), F.regexp_count("text", F.lit(low)).cast("long").alias("low"), F.md5(p).alias("pattern"))


LETTER_IPA = {k: v for k, v in translit.NKO_TO_IPA.items() if 0x07CA <= ord(k) <= 0x07EA}
UNIT = f"({script.NKO_LETTER}{script.NKO_MARK}*)"


@query(
    f"""SELECT symbol, kind, tone, count(*) AS n, CAST(sum(ms) AS BIGINT) AS ms FROM (SELECT {sql_map(LETTER_IPA)}[substr(u, 1, 1)] AS symbol, CASE WHEN regexp_matches(u, {quoted("^" + script.NKO_VOWEL)}) THEN 'vowel' ELSE 'consonant' END AS kind,
  CASE WHEN length(u) > 1 THEN right(u, 1) ELSE '' END AS tone, CASE WHEN regexp_matches(u, {quoted("^" + script.NKO_VOWEL)}) THEN 120 ELSE 80 END AS ms FROM (SELECT unnest(regexp_extract_all(t, {quoted(UNIT)}, 1)) AS u FROM ({NATIVE}))) GROUP BY symbol, kind, tone"""
)
def phoneme_durations(spark, d):
    """STR12: letters with the last mark after them, 120 ms for vowels and 80 for consonants."""
    u = native(spark, d).select(F.explode(F.regexp_extract_all("t", F.lit(UNIT), F.lit(1))).alias("u"))
    vowel = F.col("u").rlike(f"^{script.NKO_VOWEL}")
    symbol = F.try_element_at(translit.as_map(LETTER_IPA), F.substring("u", 1, 1))
    p = u.select(symbol.alias("symbol"), F.when(vowel, "vowel").otherwise("consonant").alias("kind"), F.when(F.length("u") > 1, F.right("u", F.lit(1))).otherwise("").alias("tone"), F.when(vowel, 120).otherwise(80).alias("ms"))
    return p.groupBy("symbol", "kind", "tone").agg(F.count("*").alias("n"), F.sum("ms").alias("ms"))


@query(f"SELECT doc_id, CASE WHEN a + b = 0 THEN 0.0 ELSE a / (a + b) END AS validity FROM (SELECT doc_id, {n('t', script.NKO_CONSONANT + '*' + script.NKO_MARK + '*' + script.NKO_VOWEL)} AS a, {n('t', script.NKO_CONSONANT + '+' + script.NKO_MARK + '*(?:[^' + chr(92) + 'x{07CA}-' + chr(92) + 'x{07F3}]|$)')} AS b FROM ({NATIVE}))")
def doc_segment_validity(spark, d):
    """FSM05."""
    return native(spark, d).select("doc_id", fsm.segment_validity(F.col("t")).alias("validity"))


@query(f"SELECT w, NOT regexp_matches(w, {quoted(script.NKO)}) OR NOT regexp_matches(w, {quoted(fsm.CONSONANT_END)}) AS admissible FROM (SELECT DISTINCT unnest(list_filter(string_split(t, ' '), lambda w: w <> '')) AS w FROM ({NATIVE}))")
def token_admissibility(spark, d):
    """FSM03: tokens without the script always pass."""
    w = native(spark, d).select(F.explode(F.filter(F.split("t", " "), lambda x: x != "")).alias("w")).distinct()
    return w.select("w", (~script.has_nko(F.col("w")) | fsm.admissible(F.col("w"))).alias("admissible"))


@query(f"SELECT doc_id, md5({sub('t', {k: v for k, v in translit.NKO_TO_IPA.items() if 0x07CA <= ord(k) <= 0x07EA})}) AS toneless, md5({sub('ipa', translit.IPA_TO_NKO)}) AS back FROM (SELECT doc_id, t, {sub('t', translit.NKO_TO_IPA)} AS ipa FROM ({NATIVE}))")
def doc_ipa_variants(spark, d):
    """STR10, STR11: letters only, and back to the script."""
    ipa = translit.nko_to_ipa(F.col("t"))
    return native(spark, d).select("doc_id", F.md5(translit.substitute(F.col("t"), LETTER_IPA)).alias("toneless"), F.md5(translit.from_ipa(ipa, "nko")).alias("back"))
