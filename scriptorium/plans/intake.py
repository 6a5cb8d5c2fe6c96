"""Queries of readers, settings, OCR answers and word candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clean
from ..shared import folder
from ..sources import readers
from ._base import query, quoted, table


@query("SELECT n_nationkey, n_name AS by_item, n_name AS by_key FROM nation")
def json_documents(spark, d):
    """SRC01: whole-file JSON documents, a file for each region, as rows of their array and of their object."""
    path = folder(spark)
    n = table(spark, d, "nation")
    item = F.struct("n_nationkey", "n_name")
    entry = F.struct(F.col("n_nationkey").cast("string").alias("key"), F.struct(F.col("n_name").alias("name")).alias("value"))
    whole = n.groupBy("n_regionkey").agg(F.collect_list(item).alias("items"), F.map_from_entries(F.collect_list(entry)).alias("index"))  # 25 rows
    whole.write.partitionBy("n_regionkey").option("pretty", "true").json(path)
    items = readers.json_items(spark, path, "items array<struct<n_nationkey: int, n_name: string>>", "items")
    keyed = readers.json_map(spark, path, "index", "struct<name: string>")
    return items.join(keyed, F.col("key").cast("int") == F.col("n_nationkey")).select("n_nationkey", F.col("n_name").alias("by_item"), F.col("name").alias("by_key"))


@query("SELECT c_mktsegment AS line, count(*) AS n FROM customer WHERE c_mktsegment <> '' GROUP BY c_mktsegment")
def text_lines_read(spark, d):
    """SRC03: lines stripped of white space, blank ones dropped."""
    path = folder(spark)
    table(spark, d, "customer").select(F.concat(F.lit(" \t"), F.col("c_mktsegment"), F.lit("  \n \t\n")).alias("value")).write.text(path)
    return readers.text_lines(spark, path).groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_acctbal > 0")
def csv_catalog_read(spark, d):
    """SRC12: a catalogue with a header and quoted cells."""
    path = folder(spark)
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit('"A", '), "s_name").alias("s_name"), "s_nationkey", "s_acctbal")
    s.write.option("header", True).option("escape", '"').csv(path)
    back = readers.csv_catalog(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    return back.where("s_acctbal > 0").select("s_suppkey", F.substring("s_name", 6, 1000).alias("s_name"), "s_nationkey")


_SETTINGS = {"provider": {"name": "local", "retries": 3, "key": "${SCRIPTORIUM_KEY:-none}"}, "limits": {"cost": 5.0, "items": 100}, "languages": ["nko", "en"]}
_OVERRIDE = "provider:\n  retries: 5\n  timeout: 30\nlimits:\n  cost: 2.5\n"


@query("SELECT * FROM (VALUES ('languages', '[\"nko\", \"en\"]'), ('limits.cost', '2.5'), ('limits.items', '100'), ('provider.key', 'none'), ('provider.name', 'local'), ('provider.retries', '5'), ('provider.timeout', '30')) v(setting, value)")
def settings_rows(spark, d):
    """SRC15: settings from a file over defaults, nested, with fallbacks for the environment's values."""
    path = folder(spark)
    spark.createDataFrame([(_OVERRIDE,)], "value string").coalesce(1).write.text(path)
    found = readers.settings(spark, path, _SETTINGS, environment={})
    return spark.createDataFrame(readers.flat(found), "setting string, value string")


_NATIVE = "ߒߞߏߞߊߝ"


def _answers(spark, d):
    w = F.substring(F.lit(_NATIVE), 1, (F.col("p_partkey") % 6).cast("int"))
    first = F.struct(F.lit("title").alias("type"), F.concat(F.lit("**NKO: "), w, F.lit("`abc`")).alias("nko_text"), F.lit(" Latin ").alias("latin_text"))
    second = F.struct(F.lit("vocabulary").alias("type"), F.lit("latin only").alias("nko_text"), F.lit(" ").alias("latin_text"))
    good = F.to_json(F.struct(F.concat(F.lit("  "), F.col("p_brand")).alias("slide_title"), F.lit(True).alias("has_nko"), F.array(first, second).alias("sections"), F.array(F.lit(0), F.lit(7)).alias("reading_order")))
    kind = F.col("p_partkey") % 3
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(kind == 1, F.concat(F.lit("NKO: "), w, F.lit(" *x*"))).otherwise(F.concat(F.lit('{"sections": '), w))
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"))


@query(
    f"""SELECT p_partkey, k = 0 AS structured, CASE WHEN k = 0 THEN p_brand END AS title, CASE WHEN w = '' THEN 0 ELSE 1 END AS sections, CASE WHEN w = '' THEN '' ELSE '0' END AS reading, length(w) >= 3 AS has_nko, w AS cleaned, length(w) AS nko_chars
  FROM (SELECT p_partkey, p_brand, p_partkey % 3 AS k, substr({quoted(_NATIVE)}, 1, p_partkey % 6) AS w FROM part)"""
)
def ocr_answers(spark, d):
    """STR26: answers cleaned, unfenced, parsed, with the flat text where they do not parse."""
    a = _answers(spark, d).select("p_partkey", clean.ocr(F.col("raw")).alias("o"))
    return a.select(
        "p_partkey", "o.structured", F.col("o.slide_title").alias("title"), F.size("o.sections").alias("sections"), F.array_join(F.transform("o.reading_order", lambda x: x.cast("string")), ",").alias("reading"),
        "o.has_nko", "o.cleaned", F.col("o.nko_chars").cast("long").alias("nko_chars"),
    )


_LETTERS = "a-zA-ZɛɔɲŋÈÉÊËèéêëÒÓÔÕòóôõ"


@query(
    f"""SELECT word, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(t, '[\\x{{07C0}}-\\x{{07FF}}]+'), list_filter(list_transform(regexp_extract_all(t, '[{_LETTERS}]{{2,}}'), lambda w: lower(w)), lambda w: regexp_matches(w, '[ɛɔɲŋ]')),
  list_filter(list_transform(regexp_extract_all(t, '["'']([{_LETTERS} \\t\\n\\r\\f\\v]{{2,}})["'']', 1), lambda w: lower(trim(w))), lambda w: length(w) <= 30))) AS word FROM (SELECT doc_id, 'ɲɛ "' || lang || ' word" ' || text AS t FROM documents)) GROUP BY word"""
)
def doc_word_candidates(spark, d):
    """STR27: runs of the script, words with its letters, quoted spans."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit('ɲɛ "'), "lang", F.lit(' word" '), "text").alias("t"))
    return t.select(F.explode(clean.candidates(F.col("t"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
