"""Queries over scripts: detection, transliteration, syllable structure, codebook."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fsm, script, translit
from ..operators import codebook
from ._base import query, quoted, sql_map, table


def n(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {quoted(pattern)}))"


def sub(expr: str, d: dict) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({expr}, {quoted(translit.pattern(d))}, 1), lambda t: coalesce({sql_map(d)}[t], t)), '')"


IPA = sub(sub("lower(text)", translit.NFD), translit.LATIN_TO_IPA)
NATIVE = f"SELECT doc_id, {sub('ipa', translit.IPA_TO_NKO)} AS t FROM (SELECT doc_id, {IPA} AS ipa FROM documents)"


def native(spark, d):
    return table(spark, d, "documents").select("doc_id", translit.from_ipa(translit.latin_to_ipa(F.col("text")), "nko").alias("t"))


@query(
    f"""SELECT doc_id,
  CASE WHEN n + a + l = 0 THEN 'latin' WHEN n >= a AND n >= l THEN 'nko' WHEN a >= l THEN 'arabic' ELSE 'latin' END AS by_vote,
  CASE WHEN n + b + k = 0 THEN 'latin' WHEN n + b + k > 2 AND greatest(n, b, k) / (n + b + k) < 0.6 THEN 'mixed' WHEN n = greatest(n, b, k) THEN 'nko' WHEN b = greatest(n, b, k) THEN 'arabic' ELSE 'latin' END AS by_share
  FROM (SELECT doc_id, {n("text", script.NKO)} AS n, {n("text", script.ARABIC)} AS a, {n("text", script.LATIN)} AS l, {n("text", script.ARABIC_NARROW)} AS b, {n("text", script.LATIN_ASCII)} AS k FROM documents)"""
)
def doc_detect_script(spark, d):
    """STR01, STR02."""
    return table(spark, d, "documents").select("doc_id", script.detect_vote(F.col("text")).alias("by_vote"), script.detect_mixed(F.col("text")).alias("by_share"))


@query(
    f"""SELECT doc_id, nko, arabic, latin, seen - nko - arabic - latin AS other, round(100.0 * latin / greatest(seen, 1), 1) AS latin_percent
  FROM (SELECT doc_id, {n("text", script.NKO)} AS nko, {n("text", script.ARABIC_NARROW)} AS arabic, {n("text", script.LATIN_ASCII)} AS latin, {n("text", "[^ \\t\\n\\r\\f]")} AS seen FROM documents)"""
)
def doc_script_composition(spark, d):
    """STR04."""
    out = table(spark, d, "documents").select("doc_id", script.composition(F.col("text")).alias("c")).select("doc_id", "c.*")
    total = F.col("nko") + F.col("arabic") + F.col("latin") + F.col("other")
    return out.select("doc_id", *(F.col(c).cast("long") for c in ("nko", "arabic", "latin", "other")), F.round(100.0 * F.col("latin") / F.greatest(total, F.lit(1)), 1).alias("latin_percent"))


@query(f"SELECT doc_id, {IPA} AS ipa FROM documents")
def doc_to_ipa(spark, d):
    """STR07."""
    return table(spark, d, "documents").select("doc_id", translit.latin_to_ipa(F.col("text")).alias("ipa"))


@query(f"SELECT doc_id, t AS native FROM ({NATIVE})")
def doc_to_native_script(spark, d):
    """STR06, STR08, STR18."""
    return native(spark, d).select("doc_id", F.col("t").alias("native"))


@query(f"SELECT doc_id, {sub('ipa', translit.IPA_TO_LATIN)} AS latin, {sub('ipa', translit.IPA_TO_ARABIC)} AS arabic FROM (SELECT doc_id, {IPA} AS ipa FROM documents)")
def doc_to_all_scripts(spark, d):
    """STR09."""
    ipa = table(spark, d, "documents").select("doc_id", translit.latin_to_ipa(F.col("text")).alias("ipa"))
    return ipa.select("doc_id", translit.from_ipa(F.col("ipa"), "latin").alias("latin"), translit.from_ipa(F.col("ipa"), "arabic").alias("arabic"))


@query(f"SELECT doc_id, md5({sub(sub('t', translit.NKO_TO_IPA), translit.IPA_TO_LATIN)}) AS back, md5({sub('t', translit.SIMPLE_LATIN)}) AS simple FROM ({NATIVE})")
def doc_native_back_to_latin(spark, d):
    """STR06 from the script, STR17."""
    return native(spark, d).select("doc_id", F.md5(translit.from_ipa(translit.nko_to_ipa(F.col("t")), "latin")).alias("back"), F.md5(translit.substitute(F.col("t"), translit.SIMPLE_LATIN)).alias("simple"))


@query(
    f"""SELECT doc_id, CASE WHEN letters > 0 THEN nl / letters ELSE 0.0::DOUBLE END AS of_letters, CASE WHEN seen > 0 THEN nv / seen ELSE 0.0::DOUBLE END AS of_visible, nv > 0 AS present
  FROM (SELECT doc_id, {n("t", "[\\p{L}]")} AS letters, {n("t", script.NKO_ALPHABETIC)} AS nl, {n("t", "[^ \\t\\n\\r\\f]")} AS seen, {n("t", script.NKO)} AS nv FROM ({NATIVE}))"""
)
def doc_purity_after_translit(spark, d):
    """FLT01, FLT02 (both definitions)."""
    t = F.col("t")
    return native(spark, d).select("doc_id", script.purity_of_letters(t).alias("of_letters"), script.purity_of_visible(t).alias("of_visible"), script.has_nko(t).alias("present"))


@query(
    f"""SELECT doc_id, NOT regexp_matches(t, {quoted(fsm.CONSONANT_END)}) AS admissible,
  CASE WHEN length(bare) = 0 THEN 1.0::DOUBLE ELSE 1.0 - ({n("bare", script.NKO_CONSONANT)} - {n("bare", script.NKO_CONSONANT + "+")} + CAST(regexp_matches(bare, {quoted(script.NKO_CONSONANT + "$")}) AS INT)) / length(bare) END AS ratio,
  {n("t", script.NKO_VOWEL)} AS syllables, regexp_matches(t, {quoted(script.NKO_CONSONANT + "{4}")}) AS long_run
  FROM (SELECT *, regexp_replace(regexp_replace(t, '[^\\x{{07C0}}-\\x{{07FF}}]', '', 'g'), {quoted(script.NKO_MARK)}, '', 'g') AS bare FROM ({NATIVE}))"""
)
def doc_fsm_validity(spark, d):
    """FSM01, FSM02, FSM04, FSM06."""
    t = F.col("t")
    return native(spark, d).select("doc_id", fsm.admissible(t).alias("admissible"), fsm.validity_ratio(t).alias("ratio"), fsm.syllable_count(t).cast("long").alias("syllables"), fsm.long_run(t).alias("long_run"))


@query(
    f"""SELECT syllable, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, {quoted(f"({script.NKO_CONSONANT}*{script.NKO_VOWEL}{script.NKO_MARK}*)")}, 1)) AS syllable FROM ({NATIVE}))
  GROUP BY syllable ORDER BY n DESC, syllable LIMIT 200"""
)
def syllable_frequencies(spark, d):
    """TOK01, TOK04, WN08 on text."""
    return native(spark, d).select(F.explode(fsm.syllables(F.col("t"))).alias("syllable")).groupBy("syllable").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "syllable").limit(200)


@query(f"SELECT syllable, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, {quoted(f'({script.NKO_CONSONANT}*{script.NKO_VOWEL}{script.NKO_MARK}*)')}, 1)) AS syllable FROM ({NATIVE})) GROUP BY syllable")
def all_syllable_frequencies(spark, d):
    """TOK01, TOK04, WN08 on text: the whole table."""
    return native(spark, d).select(F.explode(fsm.syllables(F.col("t"))).alias("syllable")).groupBy("syllable").agg(F.count("*").alias("n"))


_IS = {k: f"regexp_matches(x.c, {quoted(p)})" for k, p in (("c", script.NKO_CONSONANT), ("v", script.NKO_VOWEL), ("m", script.NKO_MARK), ("n", script.NKO_NASAL))}
_SPOKEN = "ߒߞߏ ߞߊ߲ߓߟ ߝߐ߫abߕ ߘ"
_CLOSED = "list_append(s.o, {'r': s.r, 'f': s.f / s.k, 'v': s.v})"


@query(
    f"""WITH a AS (SELECT p_partkey, string_split(substr({quoted(_SPOKEN)} || {quoted(_SPOKEN)}, 1 + p_partkey % 7, 6 + p_partkey % 9), '') AS c FROM part),
  b AS (SELECT p_partkey, list_transform(c, lambda x, i: {{'c': x, 'p': ((i * 37 + p_partkey) % 100) / 100.0::DOUBLE}}) AS c FROM a),
  e AS (SELECT p_partkey, list_reduce(list_append(c, {{'c': '$', 'p': 0.0::DOUBLE}}), lambda s, x:
    CASE WHEN x.c = '$' THEN {{'o': CASE WHEN s.r <> '' THEN {_CLOSED} ELSE s.o END, 'r': '', 'f': 0.0::DOUBLE, 'k': 0, 'v': false}}
      WHEN x.c = ' ' THEN {{'o': list_append(CASE WHEN s.v THEN {_CLOSED} ELSE s.o END, {{'r': ' ', 'f': 0.0::DOUBLE, 'v': true}}), 'r': '', 'f': 0.0::DOUBLE, 'k': 0, 'v': false}}
      WHEN {_IS["c"]} AND s.v THEN {{'o': {_CLOSED}, 'r': x.c, 'f': x.p, 'k': 1, 'v': false}}
      WHEN {_IS["n"]} THEN {{'o': list_append(s.o, {{'r': s.r || x.c, 'f': (s.f + x.p) / (s.k + 1), 'v': s.v}}), 'r': '', 'f': 0.0::DOUBLE, 'k': 0, 'v': false}}
      WHEN {_IS["c"]} OR {_IS["v"]} OR {_IS["m"]} THEN {{'o': s.o, 'r': s.r || x.c, 'f': s.f + x.p, 'k': s.k + 1, 'v': s.v OR {_IS["v"]}}} ELSE s END,
    {{'o': []::STRUCT(r VARCHAR, f DOUBLE, v BOOLEAN)[], 'r': '', 'f': 0.0::DOUBLE, 'k': 0, 'v': false}}) AS s FROM b)
  SELECT p_partkey, place, y.r AS raw, round(y.f, 9) AS confidence, y.v AS valid FROM (SELECT p_partkey, unnest(s.o) AS y, generate_subscripts(s.o, 1) - 1 AS place FROM e)"""
)
def syllable_confidences(spark, d):
    """WN08: syllables of decoded characters with their mean confidence."""
    p = F.col("p_partkey")
    c = table(spark, d, "part").select("p_partkey", F.split(F.substring(F.lit(_SPOKEN * 2), (p % 7 + 1).cast("int"), (p % 9 + 6).cast("int")), "").alias("c"))
    c = c.withColumn("f", F.transform("c", lambda _, i: ((i + 1) * 37 + p) % 100 / 100.0))
    s = c.select("p_partkey", F.posexplode(fsm.spoken_syllables("c", "f")).alias("place", "s"))
    return s.select("p_partkey", F.col("place").cast("long").alias("place"), F.col("s.raw").alias("raw"), F.round("s.confidence", 9).alias("confidence"), F.col("s.valid").alias("valid"))


@query(
    f"""SELECT doc_id, md5(regexp_replace(t, {quoted(script.NKO_TONE)}, '', 'g')) AS toneless, {n("t", script.NKO_TONE)} AS tones,
  md5(array_to_string(regexp_extract_all(t, {quoted(script.NKO_TONE)}), '')) AS pattern FROM ({NATIVE})"""
)
def doc_tones(spark, d):
    """STR13, STR23."""
    t = F.col("t")
    return native(spark, d).select("doc_id", F.md5(script.strip_tones(t)).alias("toneless"), script.count(t, script.NKO_TONE).cast("long").alias("tones"), F.md5(F.array_join(F.regexp_extract_all(t, F.lit(f"({script.NKO_TONE})"), F.lit(1)), "")).alias("pattern"))


def _class(c: str) -> str:
    parts = [("vowel", script.NKO_VOWEL), ("consonant", script.NKO_CONSONANT), ("tone", script.NKO_TONE), ("combining", script.NKO_NASAL), ("digit", script.NKO_DIGIT), ("punctuation", script.NKO), ("arabic", script.ARABIC), ("latin", script.LATIN)]
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, {quoted('^' + p)}) THEN '{k}'" for k, p in parts) + " ELSE 'other' END"


@query(f"SELECT c, {_class('c')} AS class, count(*) AS n FROM (SELECT unnest(regexp_extract_all(t, '(?s).')) AS c FROM ({NATIVE})) GROUP BY c")
def char_classes(spark, d):
    """STR05, STR16, STR28: characters of the documents in the script, with classes and counts."""
    chars = native(spark, d).select(F.explode(F.regexp_extract_all("t", F.lit("(?s)(.)"), F.lit(1))).alias("c"))
    return chars.groupBy("c").agg(F.count("*").alias("n")).select("c", script.classify(F.col("c")).alias("class"), "n")


@query("SELECT CAST(n_nationkey AS BIGINT) AS k, translate(CAST(n_nationkey AS VARCHAR), '0123456789', '߀߁߂߃߄߅߆߇߈߉') AS native, CAST(n_nationkey AS BIGINT) AS back FROM nation")
def nation_native_digits(spark, d):
    """STR15."""
    k = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")).withColumn("native", script.native_digits(F.col("k")))
    return k.withColumn("back", F.translate("native", script.NKO_DIGITS, "0123456789").cast("long"))


@query(codebook.SQL)
def syllable_codebook(spark, d):
    """CBK01, JN09."""
    return codebook.codebook(spark)


@query(f"SELECT pattern, count(*) AS n, count(DISTINCT nucleus) AS nuclei, count(DISTINCT onset) AS onsets FROM ({codebook.SQL}) GROUP BY pattern")
def codebook_stats(spark, d):
    """AG25."""
    return codebook.codebook(spark).groupBy("pattern").agg(F.count("*").alias("n"), F.countDistinct("nucleus").alias("nuclei"), F.countDistinct("onset").alias("onsets"))


_UNIT = f"[^\\x{{07EB}}-\\x{{07EF}}\\x{{07F2}}\\x{{07F3}}]{script.NKO_MARK}*"


def _merges(least: int) -> str:
    """Byte-pair merging in SQL: words b(step, word, n, u) after each step, with its pair; only words of 5 and more are counted."""
    words = f"SELECT word, n, regexp_extract_all(word, {quoted(_UNIT)}) AS u FROM (SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(t, '\\s+')) AS word FROM ({NATIVE})) WHERE word <> '' GROUP BY word HAVING count(*) >= {least})"
    return f"""WITH RECURSIVE w AS MATERIALIZED ({words}), b AS (SELECT 0 AS step, word, n, u, '' AS a, '' AS c FROM w UNION ALL
  SELECT step + 1, word, n, CASE WHEN contains(word, x.a || x.c) AND list_contains(u, x.a) AND list_contains(u, x.c) THEN list_reduce(u, lambda s, y: CASE WHEN len(s) > 0 AND s[-1] = x.a AND y = x.c THEN list_append(s[:-2], x.a || x.c) ELSE list_append(s, y) END, []::VARCHAR[]) ELSE u END, x.a, x.c
  FROM b, (SELECT p.a AS a, p.c AS c FROM (SELECT unnest(list_transform(range(1, len(u)), lambda i: {{'a': u[i], 'c': u[i + 1]}})) AS p, n FROM b WHERE n >= 5) GROUP BY p HAVING sum(n) >= 5 ORDER BY sum(n) DESC, p.a || chr(1) || p.c LIMIT 1) x WHERE step < 256)"""


@query(f"{_merges(5)} SELECT DISTINCT CAST(step - 1 AS INT) AS step, a, c AS b FROM b WHERE step > 0")
def native_bpe_merges(spark, d):
    """TOK02, TK06, AG31: 256 merges over the documents' words in the script."""
    from ..operators import bpe

    merges = bpe.train(bpe.word_frequencies(native(spark, d), "t"))
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "step int, a string, b string")


@query(
    f"""{_merges(1)}, l AS (SELECT word, len(u) AS k, array_to_string(u, '') = word AS whole FROM b WHERE step = (SELECT max(step) FROM b)),
  d AS (SELECT doc_id, unnest(string_split_regex(t, '\\s+')) AS word FROM ({NATIVE}))
  SELECT doc_id, CAST(sum(length(word)) AS BIGINT) AS chars, CAST(sum(k) AS BIGINT) AS tokens, bool_and(whole) AS whole FROM d JOIN l USING (word) GROUP BY doc_id"""
)
def native_bpe_metrics(spark, d):
    """TOK03, AG14: characters for each token, with 256 merges applied."""
    from ..operators import bpe

    merges = bpe.train(bpe.word_frequencies(native(spark, d), "t"))
    t = bpe.encode(native(spark, d), "t", merges)
    chars = F.length(F.regexp_replace("t", r"\s+", ""))
    return t.select("doc_id", chars.cast("long").alias("chars"), F.size("tokens").cast("long").alias("tokens"), (F.array_join("tokens", "") == F.regexp_replace("t", r"\s+", "")).alias("whole"))


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(f, {quoted(script.NKO)}) THEN 'nko' WHEN regexp_matches(f, {quoted(script.ARABIC)}) THEN 'arabic' ELSE 'latin' END AS first_script
  FROM (SELECT doc_id, regexp_extract(t, {quoted(f"({script.NKO}|{script.ARABIC}|{script.LATIN})")}, 1) AS f FROM ({NATIVE}))"""
)
def doc_first_script(spark, d):
    """STR03."""
    return native(spark, d).select("doc_id", script.detect_first(F.col("t")).alias("first_script"))


@query(f"SELECT doc_id, len(regexp_extract_all(ipa, '[^aeiouɔɛə]*[aeiouɔɛə]')) AS syllables FROM (SELECT doc_id, {IPA} AS ipa FROM documents) WHERE regexp_matches(ipa, '[aeiouɔɛə]')")
def doc_ipa_syllables(spark, d):
    """STR14."""
    ipa = table(spark, d, "documents").select("doc_id", translit.latin_to_ipa(F.col("text")).alias("ipa")).where(F.col("ipa").rlike("[aeiouɔɛə]"))
    return ipa.select("doc_id", F.size(translit.syllabify_ipa(F.col("ipa"))).cast("long").alias("syllables"))
