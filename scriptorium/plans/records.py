"""Queries of record shaping, sampling, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean, fsm, script
from ..operators import decode, sample
from ..shared import folder
from ..sources import readers, sinks
from ._base import query, quoted, table


def docs(spark, d):
    return table(spark, d, "documents")


_AROUND = "SELECT item_id, row_number() OVER (ORDER BY md5(CAST(item_id AS VARCHAR)), item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark"


@query(f"SELECT a.item_id, string_agg(CAST(b.item_id AS VARCHAR), ',' ORDER BY b.item_id) AS distractors FROM ({_AROUND}) a JOIN ({_AROUND}) b ON b.item_id <> a.item_id AND b.r IN ((a.r + 1) % a.n, (a.r + 2) % a.n, (a.r + 3) % a.n) GROUP BY a.item_id")
def benchmark_distractors(spark, d):
    """SMP06: three others for each item, the next ones in a ring by hash."""
    found = sample.next_in_ring(table(spark, d, "benchmark").select("item_id"), "item_id", 3)
    return found.groupBy("item_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("other")), lambda x: x.cast("string")), ",").alias("distractors"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r = 1")
def doc_random_row(spark, d):
    """SMP07: a random row by a fixed order."""
    return docs(spark, d).select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(1)


@query("SELECT CAST(i AS BIGINT) AS i, CASE i % 3 WHEN 0 THEN 'Translate: ' WHEN 1 THEN 'Explain: ' ELSE 'Continue: ' END AS template FROM range(40) t(i)")
def template_padding(spark, d):
    """SMP09, SMP10: templates repeated to a count."""
    t = F.array(*map(F.lit, ("Translate: ", "Explain: ", "Continue: ")))
    return spark.range(40).select(F.col("id").alias("i"), F.element_at(t, (F.col("id") % 3 + 1).cast("int")).alias("template"))


@query(
    r"""SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents WHERE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) BETWEEN 5 AND 200) WHERE r <= 50"""
)
def doc_sample_by_length(spark, d):
    """SMP02: texts of a length band."""
    kept = docs(spark, d).where(F.size(clean.words(F.col("text"))).between(5, 200))
    return kept.select("doc_id").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(50)


@query("SELECT CAST(l_orderkey AS BIGINT) AS k, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS place FROM lineitem WHERE l_quantity >= 10")
def lineitem_consecutive(spark, d):
    """WN09, WN10: consecutive numbers of the rows that are kept."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, d, "lineitem").where("l_quantity >= 10").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT status, count(*) AS n, round(avg(confidence), 9) AS confidence FROM (SELECT CASE WHEN score IS NULL THEN 'new' WHEN score >= 0.8 OR quality = 1 THEN 'known' ELSE 'weak' END AS status, coalesce(score, 0) AS confidence FROM (SELECT d.doc_id, l.quality, CASE WHEN l.doc_id IS NOT NULL THEN (d.doc_id % 10) / 10.0 END AS score FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)) GROUP BY status")
def doc_known_gate(spark, d):
    """FLT15, FLT16: skip what is known with enough confidence."""
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("seen"))
    j = docs(spark, d).select("doc_id").join(labels, "doc_id", "left")
    j = j.withColumn("score", F.when(F.col("seen"), F.col("doc_id") % 10 / F.lit(10.0)))
    status = F.when(F.col("score").isNull(), "new").when((F.col("score") >= 0.8) | (F.col("quality") == 1), "known").otherwise("weak")
    return j.groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("score", F.lit(0.0))), 9).alias("confidence"))


@query("SELECT doc_id, length(text) >= 2 AND (trim(coalesce(lang, '')) <> '' OR trim(coalesce(source, '')) <> '') AS good FROM documents")
def doc_quality_predicate(spark, d):
    """FLT07."""
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return docs(spark, d).select("doc_id", ((F.length("text") >= 2) & (some("lang") | some("source"))).alias("good"))


@query("SELECT subject, t.p AS predicate, t.o AS object FROM (SELECT CAST(p_partkey AS VARCHAR) AS subject, unnest([{'p': 'p_brand', 'o': p_brand}, {'p': 'p_type', 'o': p_type}, {'p': 'p_size', 'o': CAST(p_size AS VARCHAR)}]) AS t FROM part)")
def part_triples(spark, d):
    """SNK10, PRJ02."""
    return sinks.triples(table(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


@query("SELECT a.p_partkey, CAST(b.p_partkey AS BIGINT) AS other FROM (SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 1) a JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part WHERE p_size > 40) b ON a.p_brand = b.p_brand AND r <= 20")
def part_collocations(spark, d):
    """JN17: at most twenty partners of a key."""
    p = table(spark, d, "part")
    b = p.where("p_size > 40").select("p_brand", F.col("p_partkey").alias("other")).withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("other"))).where("r <= 20").drop("r")
    return p.where("p_size = 1").select("p_partkey", "p_brand").join(b, "p_brand").select("p_partkey", "other")


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS place, md5(s) AS section FROM (SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS s, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), 1) - 1 AS i FROM documents)"""
)
def doc_sections(spark, d):
    """PRJ12, PRJ05: one row for each section in reading order, empty ones dropped."""
    s = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return docs(spark, d).select("doc_id", F.posexplode(s).alias("place", "section")).select("doc_id", F.col("place").cast("long"), F.md5("section").alias("section"))


@query("SELECT origin, count(*) AS n, count(payload) AS with_payload FROM (SELECT 'benchmark' AS origin, CAST(NULL AS VARCHAR) AS payload FROM benchmark UNION ALL SELECT 'labels', CAST(quality AS VARCHAR) FROM labels UNION ALL SELECT 'documents', lang FROM documents) GROUP BY origin")
def unified_sources(spark, d):
    """SRC07, SET04, PRJ10: tables of different shape as one."""
    parts = [("benchmark", table(spark, d, "benchmark").select(F.col("item_id").alias("id"))), ("labels", table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("payload"))), ("documents", docs(spark, d).select(F.col("doc_id").alias("id"), F.col("lang").alias("payload")))]
    return readers.unified(parts).groupBy("origin").agg(F.count("*").alias("n"), F.count("payload").alias("with_payload"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IS NOT NULL ORDER BY o_totalprice LIMIT 20")
def orders_filtered_read(spark, d):
    """SRC08, SRC09: conditions, order and limit of a read."""
    return readers.filtered(table(spark, d, "orders"), {"o_orderstatus": "F"}, not_null=("o_orderpriority",), order="o_totalprice", limit=20).select("o_orderkey", "o_totalprice")


@query("SELECT event_type AS split, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def manifest_round_trip(spark, d):
    """SNK01, SRC02: JSON lines by split, written and read."""
    path = folder(spark)
    sinks.manifests(table(spark, d, "events").select("event_id", "value", F.col("event_type").alias("split")), path)
    back = spark.read.schema("event_id long, value double, split string").json(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE trim(c_name) <> '' GROUP BY c_mktsegment")
def text_round_trip(spark, d):
    """SRC03, SRC04, SRC12: a tab-separated table, written and read as pairs."""
    path = folder(spark)
    table(spark, d, "customer").select(F.concat_ws("\t", "c_name", "c_mktsegment").alias("value")).write.text(path)
    return readers.tsv_pairs(spark, path, ("c_name", "c_mktsegment")).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS events, sum(value) FILTER (event_type = 'purchase') AS total, arg_max(value, event_id) AS latest FROM events GROUP BY user_id")
def run_progress(spark, d):
    """SNK11: increments are summed, absolute values keep the latest."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("increment"), F.col("value").alias("absolute"), F.col("event_id").alias("at"))
    return sinks.progress(e).select(F.col("run_id").alias("user_id"), "events", "total", "latest")


@query("SELECT user_id, array_to_string(list_filter(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 OR a[i] <> a[i - 1] THEN a[i] END), lambda x: x IS NOT NULL AND x <> 0), ',') AS kept FROM (SELECT user_id, list(CAST(event_id % 4 AS BIGINT) ORDER BY ts, event_id) AS a FROM events GROUP BY user_id)")
def frame_collapse(spark, d):
    """WN07 on arrays."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: s["event_id"] % 4).alias("a"))
    return e.select("user_id", F.array_join(F.transform(decode.collapse(F.col("a")), lambda x: x.cast("string")), ",").alias("kept"))


@query(r"""SELECT doc_id, md5(t) AS plain FROM (SELECT doc_id, regexp_replace(regexp_replace('== ' || doc_id || ' ==' || chr(10) || text, '(?m)^==\s*(.*?)\s*==\s*$', '\1', 'g'), '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[^a-zA-Z .]', ' ', 'g'), '[ ]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents))""")
def doc_wikitext(spark, d):
    """STR24: headings and templates around the documents' letters are taken out."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", "[^a-zA-Z .]", " "), "[ ]+", " "))
    wiki = F.concat(F.lit("{{box|{{inner}}}}== "), F.col("doc_id").cast("string"), F.lit(" ==\n'''"), plain, F.lit("'''<!-- end -->"))
    return docs(spark, d).select("doc_id", F.md5(clean.strip_wikitext(wiki)).alias("plain"))


@query("SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey IS NOT NULL")
def aligned_files(spark, d):
    """SRC06: two files, line by line."""
    base = folder(spark)
    n = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)  # 25 rows
    n.select(F.col("n_name").alias("value")).write.text(f"{base}/names")
    n.select(F.col("n_regionkey").cast("string").alias("value")).write.text(f"{base}/regions")
    out = readers.aligned(spark, {"name": f"{base}/names", "region": f"{base}/regions"})
    return out.select("name", F.col("region").cast("int").alias("region"))


@query("SELECT p_name AS nko, p_type AS en FROM part")
def parallel_file(spark, d):
    """SRC05, PRJ09: a reader by suffix, columns by what their names contain."""
    path = f"{folder(spark)}/pairs.jsonl"
    table(spark, d, "part").select(F.col("p_name").alias("nko_text"), F.col("p_type").alias("EN")).write.json(path)
    return readers.parallel(spark, path)


@query("SELECT 'json' AS suffix, 1::BIGINT AS files UNION ALL SELECT 'parquet', 1")
def folder_listing(spark, d):
    """SRC13: files of a folder by suffix, contents not read."""
    base = folder(spark)
    r = table(spark, d, "region").coalesce(1)
    r.write.json(f"{base}/a")
    r.write.parquet(f"{base}/b")
    files = readers.listing(spark, base, "part-*")
    return files.groupBy(F.regexp_extract("path", "\\.([a-z]+)$", 1).alias("suffix")).agg(F.count("*").alias("files"))


@query(r"""SELECT conv_id, count(*) AS frames, count(*) FILTER (role = 'user') AS frames_with_text, CAST(sum(len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 12))) AS BIGINT) AS detections FROM conversations GROUP BY conv_id""")
def fan_out_tables(spark, d):
    """SNK02, SNK05: one input as three tables, read back and counted."""
    base = folder(spark)
    long = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda x: F.length(x) > 12)
    frames = table(spark, d, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("has_text"), F.transform(long, lambda x: F.struct(x.alias("word"))).alias("detections"))
    sinks.fan_out(frames, "conv_id", base)
    found = spark.read.parquet(f"{base}/detections").groupBy("conv_id").agg(F.count("*").alias("detections"))
    return spark.read.parquet(f"{base}/sources").join(found, "conv_id", "left").select("conv_id", "frames", "frames_with_text", F.coalesce("detections", F.lit(0)).alias("detections"))


@query("SELECT conv_id, turn, coalesce(nullif(trim(text), ''), role) AS english, CASE WHEN role = 'user' THEN 'question' ELSE 'answer' END AS category FROM conversations")
def nested_to_rows(spark, d):
    """PRJ01, SNK09: a nested document of each conversation, flattened with fallbacks."""
    item = F.struct("turn", F.trim("text").alias("english"), F.col("role").alias("fallback"))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(item).alias("items"))
    flat = nested.select("conv_id", F.explode("items").alias("i"))
    text = F.coalesce(F.nullif(F.col("i.english"), F.lit("")), F.col("i.fallback"))
    return flat.select("conv_id", "i.turn", text.alias("english"), F.when(F.col("i.fallback") == "user", "question").otherwise("answer").alias("category"))


@query("SELECT c_custkey, c_acctbal AS balance, c_mktsegment AS segment FROM customer")
def struct_round_trip(spark, d):
    """PRJ08, SNK07: records as JSON with either spelling of a key, and back."""
    c = table(spark, d, "customer")
    even = F.to_json(F.struct(F.col("c_acctbal").alias("accountBalance"), F.col("c_mktsegment").alias("marketSegment")))
    odd = F.to_json(F.struct(F.col("c_acctbal").alias("account_balance"), F.col("c_mktsegment").alias("market_segment")))
    packed = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, even).otherwise(odd).alias("j"))
    j = packed.select("c_custkey", F.from_json("j", "accountBalance double, account_balance double, marketSegment string, market_segment string").alias("s"))
    return j.select("c_custkey", F.coalesce("s.accountBalance", "s.account_balance").alias("balance"), F.coalesce("s.marketSegment", "s.market_segment").alias("segment"))


@query("SELECT role, avg(CAST(length(trim(coalesce(text, ''))) > 0 AS INT)) AS rate, count(*) AS n FROM conversations GROUP BY role")
def response_rate(spark, d):
    """MET07."""
    return table(spark, d, "conversations").groupBy("role").agg(F.avg((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).cast("int")).alias("rate"), F.count("*").alias("n"))


@query(
    """SELECT user_id, n >= 10 AND c >= 0.5 AND k >= 0.4 AND e >= 0.5 AS passed, CASE WHEN n < 10 THEN 'insufficient_coverage' WHEN c < 0.5 THEN 'inconsistent_direction' WHEN k < 0.4 THEN 'curvature_noise' WHEN e < 0.5 THEN 'low_context_entropy' END AS failure,
  round(CASE WHEN n < 10 THEN n / 10 WHEN c < 0.5 THEN 0.5 * c / 0.5 WHEN k < 0.4 THEN 0.5 * k / 0.4 WHEN e < 0.5 THEN 0.5 * e / 0.5 ELSE least(1.0, 0.5 + 0.1 * (n / 10 - 1)) END, 9) AS score
  FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'view') * 2.0 / count(*) AS c, count(*) FILTER (event_type <> 'error') * 1.0 / count(*) AS k, count(DISTINCT event_type) / 5.0 AS e FROM events GROUP BY user_id)"""
)
def invariance_gates(spark, d):
    """FEA08."""
    from ..functions import features

    n = F.count("*")
    g = table(spark, d, "events").groupBy("user_id").agg(n.alias("n"), (F.count_if(F.col("event_type") == "view") * 2.0 / n).alias("c"), (F.count_if(F.col("event_type") != "error") * 1.0 / n).alias("k"), (F.count_distinct("event_type") / 5.0).alias("e"))
    s = features.invariance(F.col("n"), F.col("c"), F.col("k"), F.col("e"))
    return g.select("user_id", s.alias("s")).select("user_id", "s.passed", "s.failure", F.round("s.score", 9).alias("score"))


_ALPHABET = "ߓߕߞߟߡߣߛߊߌߎߍߏ"
_BARE = f"regexp_replace(word, {quoted(script.NKO_MARK)}, '', 'g')"


@query(
    f"""WITH r AS (SELECT CAST(id AS BIGINT) AS id FROM range((SELECT count(*) FROM customer)) t(id)), s AS (SELECT id, md5('word-' || id) AS h FROM r),
  w AS (SELECT id, array_to_string(list_transform(range(1, 3 + CAST('0x' || substr(h, 1, 1) AS INT) % 5), lambda i: substr('{_ALPHABET}', 1 + CAST('0x' || substr(h, 1 + i, 1) AS INT) % 12, 1)), '') AS word FROM s)
  SELECT id, word FROM w WHERE NOT regexp_matches(word, {quoted(fsm.CONSONANT_END)}) AND NOT regexp_matches({_BARE}, {quoted(script.NKO_CONSONANT + script.NKO_CONSONANT)})"""
)
def synthetic_words(spark, d):
    """SMP08: words drawn by hash, one try for each customer, kept if the automaton admits them."""
    h = F.md5(F.concat(F.lit("word-"), F.col("id").cast("string")))
    digit = lambda i: F.conv(F.substr(h, i, F.lit(1)), 16, 10).cast("int")
    letters = F.transform(F.sequence(F.lit(1), digit(F.lit(1)) % 5 + 2), lambda i: F.substr(F.lit(_ALPHABET), digit(i + 1) % 12 + 1, F.lit(1)))
    rows = spark.range(table(spark, d, "customer").count()).select("id", F.array_join(letters, "").alias("word"))
    return rows.where(fsm.admissible(F.col("word")) & (fsm.validity_ratio(F.col("word")) == 1.0) & script.has_nko(F.col("word")))


BEAM = ["", "a", "b", "c", "d", "e", "f", "g"]


def admits(text: str, c: str) -> bool:
    """Syllables of at most one consonant before a vowel."""
    return not text or c in "ae" or text[-1] in "ae"


def complete(text: str) -> bool:
    return not text or text[-1] in "ae"


@query()
def vec_beam_search(spark, d):
    """DEC01, TK08, EXT06: vectors as eight frames of eight scores, decoded by beam search with
    a model of character pairs, counted in the customers' segments, and an automaton."""
    letters = F.filter(F.split(F.lower("c_mktsegment"), ""), lambda c: c.isin(BEAM[1:]))
    two = F.zip_with(letters, F.slice(letters, 2, 1 << 20), lambda a, b: F.concat(a, b))
    found = table(spark, d, "customer").select(F.explode(two).alias("p")).where(F.length("p") == 2).groupBy("p").agg(F.count("*").alias("n"))
    counts = {r.p: r.n for r in found.collect()}  # at most 49 pairs of letters
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    v = table(spark, d, "embeddings").select("vec_id", frames.alias("f"))
    return decode.beam_search(v, "f", BEAM, language=decode.PairModel(counts, len(BEAM) - 1), admits=admits, complete=complete).select("vec_id", "text", F.round("score", 6).alias("score"))
