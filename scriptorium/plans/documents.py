"""Queries over documents, pages and the benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clean, features, translit
from ..operators import dedup, sample
from ._base import query, quoted, table

W = r"list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')"
PHRASE = r"array_to_string(list_filter(string_split_regex(regexp_replace(text, '" + clean.PUNCTUATION.replace("'", "''") + r"', '', 'g'), '\s+'), lambda w: w <> ''), ' ')"
#: Words that are no keywords. Fixed values.
STOP = (
    "a an the is are was were be been being have has had do does did will would shall should may might must can could am it its i me my we our you your he him his she her they them their "
    "this that these those in on at to for of with by from as into through during before after above below between and but or nor not no so if then than too very just about up out off over under again further once here there "
    "when where why how all each every both few more most other some such only own same what which who whom don't doesn't didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's"
).split()


def docs(spark, d):
    return table(spark, d, "documents")


def _reason(w):
    return F.when(F.size(w) < 5, "too_short").when(features.repetitive(w), "repetitive").when(F.col("lang").isNull(), "no_language").when(F.length("text") > 20000, "too_long").otherwise("keep")


REASON = "CASE WHEN len(w) < 5 THEN 'too_short' WHEN len(w) > 6 AND len(list_distinct(w)) / len(w) < 0.3 THEN 'repetitive' WHEN lang IS NULL THEN 'no_language' WHEN length(text) > 20000 THEN 'too_long' ELSE 'keep' END"


@query(
    f"""WITH k AS (SELECT doc_id, lang, source, {PHRASE} AS p, len(w) AS n FROM (SELECT *, {W} AS w FROM documents) WHERE {REASON} = 'keep'),
  f AS (SELECT p, min(doc_id) AS doc_id FROM k GROUP BY p)
  SELECT lang, source, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM k JOIN f USING (doc_id) GROUP BY lang, source ORDER BY words DESC, lang, source LIMIT 20"""
)
def doc_flagship(spark, d):
    """Reject chain, first-wins dedup, rollup, top 20: FLT03, FLT05, WN03, AG01, TK01."""
    kept = docs(spark, d).withColumn("w", clean.words(F.col("text"))).where(_reason(F.col("w")) == "keep")
    kept = kept.select("doc_id", "lang", "source", clean.phrase(F.col("text")).alias("p"), F.size("w").cast("long").alias("n"))
    first = dedup.first_wins(kept, F.col("p"), "doc_id")
    return first.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n").alias("words")).orderBy(F.desc("words"), "lang", "source").limit(20)


@query(f"SELECT reason, count(*) AS n, count(DISTINCT source) AS sources FROM (SELECT source, {REASON} AS reason FROM (SELECT *, {W} AS w FROM documents)) GROUP BY reason")
def doc_reject_reasons(spark, d):
    """FLT03, FLT04, FLT05."""
    out = docs(spark, d).withColumn("w", clean.words(F.col("text"))).select("source", _reason(F.col("w")).alias("reason"))
    return out.groupBy("reason").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {PHRASE} AS p FROM documents) GROUP BY p")
def doc_first_wins_dedup(spark, d):
    """WN03, STR20, SET01."""
    p = docs(spark, d).select("doc_id", F.sha2(clean.phrase(F.col("text")), 256).alias("p"))
    return p.groupBy("p").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("p")


@query("SELECT lang, source, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, round(sum(length(text)) / 3600, 1) AS hours FROM documents GROUP BY lang, source")
def doc_counts_by_lang_source(spark, d):
    """AG01, AG04."""
    n = F.sum(F.length("text"))
    return docs(spark, d).groupBy("lang", "source").agg(F.count("*").alias("docs"), n.alias("chars"), F.round(n / 3600, 1).alias("hours"))


@query("SELECT lang, count(DISTINCT c) AS chars, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) GROUP BY lang")
def doc_distinct_chars(spark, d):
    """AG04 (distinct characters), AG02."""
    counts = docs(spark, d).select("lang", F.explode(F.split("text", "")).alias("c")).groupBy("lang", "c").agg(F.count("*").alias("n"))
    return counts.groupBy("lang").agg(F.count("*").alias("chars"), F.sum("n").alias("n"))


@query(f"SELECT lang, bucket, count(*) AS n FROM (SELECT lang, CASE WHEN len(w) <= 3 THEN 'simple' WHEN len(w) <= 10 THEN 'medium' ELSE 'complex' END AS bucket FROM (SELECT lang, {W} AS w FROM documents)) GROUP BY lang, bucket")
def doc_complexity_buckets(spark, d):
    """FEA10."""
    return docs(spark, d).select("lang", features.complexity(clean.words(F.col("text"))).alias("bucket")).groupBy("lang", "bucket").agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT doc_id, lang, md5(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents),
  c AS (SELECT doc_id, lang FROM r WHERE r <= CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 50 WHEN 'de' THEN 20 ELSE -1 END),
  x AS (SELECT doc_id, lang, row_number() OVER (ORDER BY h, doc_id) AS k FROM r WHERE doc_id NOT IN (SELECT doc_id FROM c))
  SELECT doc_id, lang FROM c UNION ALL SELECT doc_id, lang FROM x WHERE k <= 100 - (SELECT count(*) FROM c)"""
)
def doc_stratified_sample(spark, d):
    """SMP01, SMP02, SMP03: 30/50/20 of 100, what is missing filled."""
    return sample.stratified(docs(spark, d).select("doc_id", "lang"), "lang", {"en": 0.3, "fr": 0.5, "de": 0.2}, 100, "doc_id")


PLACE = "CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0"


@query(f"SELECT split, lang, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, lang, CASE WHEN p < 0.9 THEN 'train' WHEN p < 0.9 + 0.05 THEN 'val' ELSE 'test' END AS split FROM (SELECT *, {PLACE} AS p FROM documents)) GROUP BY split, lang")
def doc_split_90_5_5(spark, d):
    """SMP04."""
    out = sample.split(docs(spark, d).select("doc_id", "lang"), "doc_id", [("train", 0.9), ("val", 0.05), ("test", 0.05)])
    return out.groupBy("split", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query(f"SELECT doc_id, CASE WHEN {PLACE} < 0.9 THEN 'train' ELSE 'val' END AS split FROM documents")
def doc_split_90_10(spark, d):
    """SMP05, SET04."""
    return sample.split(docs(spark, d).select("doc_id"), "doc_id", [("train", 0.9), ("val", 0.1)])


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 3")
def doc_sample_per_source(spark, d):
    """SMP03, FLT13."""
    return sample.per_group(docs(spark, d).select("doc_id", "source"), "source", 3, "doc_id")


@query("SELECT doc_id, n < 5 OR top / n > 0.7 AS degenerate FROM (SELECT doc_id, max(k) AS top, sum(k) AS n FROM (SELECT doc_id, c, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\r\\f]')) AS c FROM documents) GROUP BY doc_id, c) GROUP BY doc_id)")
def doc_degenerate(spark, d):
    """FLT06: the most frequent character among those that are not white space."""
    out = docs(spark, d).select("doc_id", features.char_counts(F.regexp_replace("text", "[ \\t\\n\\r\\f]", "")).alias("c"))
    return out.where("c.n > 0").select("doc_id", ((F.col("c.n") < 5) | (F.col("c.top") / F.col("c.n") > 0.7)).alias("degenerate"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest(tok) AS w, generate_subscripts(tok, 1) AS i FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z'']+'), lambda w: length(w) > 2 AND NOT list_contains([{", ".join(map(quoted, STOP))}], w)) AS tok FROM documents WHERE lang = 'en')),
  s AS (SELECT doc_id, w, count(*) * ln(1 + length(w)) AS score, min(i) AS first FROM t GROUP BY doc_id, w),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, first) AS r FROM s)
  SELECT doc_id, string_agg(w, '|' ORDER BY w) AS concept FROM r WHERE r <= 5 GROUP BY doc_id"""
)
def doc_keywords_topk(spark, d):
    """TK02: five words by tf * ln(1 + length), ties by first occurrence."""
    low = F.regexp_extract_all(F.lower("text"), F.lit("([a-zA-Z']+)"), F.lit(1))
    tokens = F.filter(low, lambda w: (F.length(w) > 2) & ~w.isin(STOP))
    t = docs(spark, d).where("lang = 'en'").select("doc_id", F.posexplode(tokens).alias("i", "w"))
    s = t.groupBy("doc_id", "w").agg(F.count("*").alias("tf"), F.min("i").alias("first")).withColumn("score", F.col("tf") * F.log(1 + F.length("w")))
    r = s.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.round("score", 9).desc(), "first"))).where("r <= 5")
    return r.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("w")), "|").alias("concept"))


@query(f"SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM (SELECT {W.replace('text', 'lower(text)')} AS w FROM documents)) GROUP BY w ORDER BY n DESC, w LIMIT 100")
def doc_word_frequencies(spark, d):
    """AG20, TK01."""
    return docs(spark, d).select(F.explode(clean.words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(100)


@query(f"SELECT a, b, count(*) AS n FROM (SELECT unnest(list_zip(w[:-2], w[2:])) AS p, p[1] AS a, p[2] AS b FROM (SELECT {W.replace('text', 'lower(text)')} AS w FROM documents) WHERE len(w) > 1) GROUP BY a, b ORDER BY n DESC, a, b LIMIT 100")
def doc_pair_counts(spark, d):
    """AG20: adjacent pairs."""
    p = docs(spark, d).select(F.explode(features.pairs(clean.words(F.lower("text")))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    a, b = F.split("p", "\x01")[0], F.split("p", "\x01")[1]
    return p.select(a.alias("a"), b.alias("b"), "n").orderBy(F.desc("n"), "a", "b").limit(100)


@query(f"SELECT w, count(*) AS n FROM (SELECT unnest(w) AS w FROM (SELECT {W.replace('text', 'lower(text)')} AS w FROM documents)) GROUP BY w")
def doc_all_word_frequencies(spark, d):
    """AG20: the whole table."""
    return docs(spark, d).select(F.explode(clean.words(F.lower("text"))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))


@query(f"SELECT a, b, count(*) AS n FROM (SELECT unnest(list_zip(w[:-2], w[2:])) AS p, p[1] AS a, p[2] AS b FROM (SELECT {W.replace('text', 'lower(text)')} AS w FROM documents) WHERE len(w) > 1) GROUP BY a, b")
def doc_all_pair_counts(spark, d):
    """AG20: the whole table of adjacent pairs."""
    p = docs(spark, d).select(F.explode(features.pairs(clean.words(F.lower("text")))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return p.select(F.split("p", "\x01")[0].alias("a"), F.split("p", "\x01")[1].alias("b"), "n")


@query(
    "SELECT w[1] AS ctx, w[2] AS next, count(*) AS n FROM (SELECT unnest(list_zip(c[:-2], c[2:])) AS w FROM (SELECT string_split(text, '') AS c FROM documents) WHERE len(c) > 1) GROUP BY ctx, next"
)
def doc_char_ngram_counts(spark, d):
    """AG21: next character after a context of one."""
    chars = F.split("text", "")
    p = docs(spark, d).where(F.length("text") > 1).select(F.explode(features.pairs(chars)).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    return p.select(F.split("p", "\x01")[0].alias("ctx"), F.split("p", "\x01")[1].alias("next"), "n")


@query(
    f"""SELECT doc_id, len(list_distinct(w)) / greatest(len(w), 1) AS unique_ratio, CASE WHEN len(w) > 1 THEN len(list_distinct(p)) / len(p) ELSE 0.0 END AS distinct_2
  FROM (SELECT doc_id, w, list_zip(w[:-2], w[2:]) AS p FROM (SELECT doc_id, {W} AS w FROM documents))"""
)
def doc_distinct_n(spark, d):
    """AG24."""
    out = docs(spark, d).withColumn("w", clean.words(F.col("text")))
    return out.select("doc_id", features.unique_ratio(F.col("w")).alias("unique_ratio"), features.distinct_n(F.col("w"), 2).alias("distinct_2"))


@query(
    """WITH t AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) AS t FROM documents),
  c AS (SELECT doc_id, p AS pos, substr(t, p + 1, 300) AS c, length(t) AS n FROM (SELECT *, unnest(range(0, length(t) - 80, 250)) AS p FROM t WHERE length(t) >= 600)),
  s AS (SELECT doc_id, pos, CASE WHEN pos + 300 < n AND length(regexp_extract(c, '(?s)^(.*[.!? ])', 1)) > length(c) - 79 THEN regexp_extract(c, '(?s)^(.*[.!? ])', 1) ELSE c END AS chunk FROM c)
  SELECT doc_id, pos, md5(chunk) AS chunk, length(chunk) AS n FROM s"""
)
def doc_chunks(spark, d):
    """PRJ06: chunks of 300 every 250, cut back to a sentence or word end within the last 80."""
    t = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    long = docs(spark, d).select("doc_id", t.alias("t")).where(F.length("t") >= 600)
    c = long.select("doc_id", F.length("t").alias("len"), F.col("t"), F.explode(F.sequence(F.lit(0), F.length("t") - 81, F.lit(250))).alias("pos")).withColumn("c", F.expr("substring(t, pos + 1, 300)"))
    whole = F.regexp_extract("c", "(?s)^(.*[.!? ])", 1)
    chunk = F.when((F.col("pos") + 300 < F.col("len")) & (F.length(whole) > F.length("c") - 79), whole).otherwise(F.col("c"))
    return c.select("doc_id", F.col("pos").cast("long"), F.md5(chunk).alias("chunk"), F.length(chunk).cast("long").alias("n"))


@query(
    """WITH t AS (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)) AS t FROM documents)
  SELECT doc_id, CAST(0 AS BIGINT) AS pos, md5(t) AS chunk, length(t) AS n FROM t WHERE length(t) BETWEEN 80 AND 599"""
)
def doc_short_chunks(spark, d):
    """PRJ06: texts too short for doc_chunks, each one chunk."""
    t = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    short = docs(spark, d).select("doc_id", t.alias("t")).where(F.length("t").between(80, 599))
    return short.select("doc_id", F.lit(0).cast("long").alias("pos"), F.md5("t").alias("chunk"), F.length("t").cast("long").alias("n"))


@query("SELECT doc_id FROM documents WHERE substr(sha256(text), 1, 16) NOT IN (SELECT substr(sha256(text), 1, 16) FROM benchmark)")
def doc_benchmark_exclusion(spark, d):
    """JN04, JN05, SET02: exclusion by the prefix of a content hash."""
    key = F.substring(F.sha2("text", 256), 1, 16)
    return docs(spark, d).withColumn("k", key).join(table(spark, d, "benchmark").select(key.alias("k")), "k", "left_anti").select("doc_id")


@query("SELECT lang, grouping(lang) AS overall, count(*) AS n, avg(quality) * 100 AS accuracy, avg(toxic) AS toxic, count(*) FILTER (quality IS NULL) AS errors FROM documents JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((), (lang))")
def doc_quality_join(spark, d):
    """JN16, AG11: overall and by group."""
    j = docs(spark, d).select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    sets = j.groupingSets([[], [F.col("lang")]], F.col("lang"))
    return sets.agg(F.grouping("lang").cast("long").alias("overall"), F.count("*").alias("n"), (F.avg("quality") * 100).alias("accuracy"), F.avg("toxic").alias("toxic"), F.count_if(F.col("quality").isNull()).alias("errors"))


@query(
    """SELECT *, sha256(layer_0 || '|' || layer_1 || '|' || layer_2) AS provenance, 'NKP1|' || substr(sha256(layer_0 || '|' || layer_1 || '|' || layer_2), 1, 16) AS compact
  FROM (SELECT doc_id, sha256(text) AS layer_0, sha256(coalesce(lang, '')) AS layer_1, sha256(coalesce(source, '')) AS layer_2 FROM documents)"""
)
def doc_provenance_chain(spark, d):
    """FEA04, FEA05."""
    layers = [F.sha2(x, 256) for x in (F.col("text"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))]
    out = docs(spark, d).select("doc_id", *(x.alias(f"layer_{i}") for i, x in enumerate(layers)))
    whole = F.sha2(F.concat_ws("|", "layer_0", "layer_1", "layer_2"), 256)
    return out.select("*", whole.alias("provenance"), F.concat(F.lit("NKP1|"), F.substring(whole, 1, 16)).alias("compact"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'layer_0' ELSE '' END AS broken FROM documents")
def doc_chain_verify(spark, d):
    """FEA05: every third chain is altered, and the altered layers are listed."""
    stored = doc_provenance_chain(spark, d).withColumn("layer_0", F.when(F.col("doc_id") % 3 == 0, F.sha2("layer_0", 256)).otherwise(F.col("layer_0")))
    again = docs(spark, d).select("doc_id", F.sha2("text", 256).alias("r0"), F.sha2(F.coalesce("lang", F.lit("")), 256).alias("r1"), F.sha2(F.coalesce("source", F.lit("")), 256).alias("r2"))
    checks = F.array(*(F.when(F.col(f"layer_{i}") != F.col(f"r{i}"), f"layer_{i}") for i in range(3)))
    return stored.join(again, "doc_id").select("doc_id", F.array_join(F.array_compact(checks), ",").alias("broken"))


@query("SELECT doc_id, signature, CAST(('0x' || signature)::UBIGINT AS VARCHAR) AS number FROM (SELECT doc_id, substr(sha256('ops:0' || CASE WHEN length(text) > 3 THEN ',1' ELSE '' END || ',3|surf:' || trim(text)), 1, 16) AS signature FROM documents)")
def doc_signature(spark, d):
    """FEA07, AG28."""
    s = docs(spark, d).select("doc_id", features.signature(F.col("text")).alias("signature"))
    return s.select("doc_id", "signature", features.unsigned(F.col("signature")).cast("string").alias("number"))


NORM = "lower(trim(text))"
for _a, _b in clean.FOLDED:
    NORM = f"replace({NORM}, '{_a}', '{_b}')"


@query(f"SELECT doc_id, md5({NORM}) AS folded FROM documents")
def doc_folded(spark, d):
    """STR21."""
    return docs(spark, d).select("doc_id", F.md5(clean.folded(F.col("text"))).alias("folded"))


@query("SELECT doc_id, md5(trim(array_to_string(list_transform(regexp_extract_all(lower(text), '(?s).'), lambda t: coalesce(" + "MAP {" + ", ".join(f"{quoted(k)}: {quoted(''.join(c for c in v if not 0x300 <= ord(c) <= 0x36F))}" for k, v in translit.NFD.items()) + "}[t], t)), ''))) AS form FROM documents")
def doc_word_forms(spark, d):
    """STR19: lower case without marks."""
    return docs(spark, d).select("doc_id", F.md5(clean.word_form(F.col("text"))).alias("form"))


def _entities(x: str) -> str:
    for a, b in clean.ENTITIES:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


PLAIN = _entities(r"regexp_replace(regexp_replace(html, '<br\s*/?\s*>', chr(10), 'g'), '<[^>]+>', '', 'g')")
PLAIN = rf"regexp_replace(regexp_replace(regexp_replace({PLAIN}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, length(p) AS n, md5(p) AS plain FROM (SELECT page_id, {PLAIN} AS p FROM pages)")
def page_plain_text(spark, d):
    """STR25."""
    p = table(spark, d, "pages").select("page_id", clean.html_to_plain(F.col("html")).alias("p"))
    return p.select("page_id", F.length("p").cast("long").alias("n"), F.md5("p").alias("plain"))


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]*)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages")
def page_entries(spark, d):
    """SRC10: typed fields of pages by patterns."""
    h = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]*)"', 1).alias("lang"),
        F.regexp_count(h, F.lit('<a href="([^"]*)"')).cast("long").alias("links"), F.regexp_count(h, F.lit("<p>")).cast("long").alias("paragraphs"),
    )


@query("SELECT word, count(*) AS n FROM (SELECT DISTINCT page_id, unnest(list_transform(regexp_extract_all(html, '<a href=\"[^\"]*\">([a-zA-Z]{2,})</a>', 1), lambda w: lower(w))) AS word FROM pages) GROUP BY word")
def page_word_candidates(spark, d):
    """STR27: vocabulary candidates, here link texts."""
    words = F.transform(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([a-zA-Z]{2,})</a>'), F.lit(1)), F.lower)
    return table(spark, d, "pages").select("page_id", F.explode(F.array_distinct(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace('<think>x ' || doc_id || '</think>' || text || '<|end|>', '(?s)<think>.*?</think>', '', 'g'), '<\|[^|>]*\|>', '', 'g'))) AS cleaned FROM documents"""
)
def doc_generation_cleanup(spark, d):
    """STR29."""
    raw = F.concat(F.lit("<think>x "), F.col("doc_id").cast("string"), F.lit("</think>"), F.col("text"), F.lit("<|end|>"))
    return docs(spark, d).select("doc_id", F.md5(clean.clean_generation(raw)).alias("cleaned"))


@query(
    f"""WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 5)) AS token FROM benchmark),
  h AS (SELECT token, doc_id, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS r FROM (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 5)) AS token FROM documents) JOIN (SELECT DISTINCT token FROM w) USING (token))
  SELECT token, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first FROM h WHERE r <= 3 GROUP BY token ORDER BY token LIMIT 200"""
)
def token_sentence_containment(spark, d):
    """JN11: tokens of the benchmark, the first three documents that hold each; an
    equi-join on tokens in place of a nested loop over substrings."""
    tokens = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda x: F.length(x) >= 5))
    w = table(spark, d, "benchmark").select(F.explode(tokens).alias("token")).distinct()
    h = docs(spark, d).select("doc_id", F.explode(tokens).alias("token")).join(w, "token")
    r = h.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy("doc_id"))).where("r <= 3")
    return r.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first")).orderBy("token").limit(200)


@query("SELECT doc_id, avg(CAST(k AS INT)) AS coverage FROM (SELECT doc_id, w, w IN (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) FROM benchmark) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)) GROUP BY doc_id")
def doc_dictionary_coverage(spark, d):
    """AG27: share of a document's words in the benchmark's vocabulary."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")
    known = table(spark, d, "benchmark").select(word).distinct().withColumn("k", F.lit(1))
    own = docs(spark, d).select("doc_id", word).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    j = own.join(known, "w", "left")
    return j.groupBy("doc_id").agg((F.sum(F.coalesce("k", F.lit(0)) * F.col("n")) / F.sum("n")).alias("coverage"))


@query("SELECT doc_id, m.role AS role, md5(m.content) AS content FROM (SELECT doc_id, unnest([{'role': 'user', 'content': 'Continue: ' || substr(text, 1, CAST(floor(length(text) * 0.6) AS BIGINT))}, {'role': 'assistant', 'content': substr(text, CAST(floor(length(text) * 0.6) AS BIGINT) + 1)}]) AS m FROM documents WHERE length(text) >= 80)")
def doc_completion_tasks(spark, d):
    """PRJ03, PRJ04, PRJ05: a chat record of a text's beginning and its continuation."""
    cut = F.floor(F.length("text") * 0.6).cast("int")
    t = docs(spark, d).where(F.length("text") >= 80).withColumn("cut", cut)
    m = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Continue: "), F.expr("substring(text, 1, cut)")).alias("content")), F.struct(F.lit("assistant").alias("role"), F.expr("substring(text, cut + 1)").alias("content")))
    return t.select("doc_id", F.explode(m).alias("m")).select("doc_id", "m.role", F.md5("m.content").alias("content"))
