"""Queries over the star schema: joins, rankings, lookups, paging, upserts, grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import dedup, lookup, morphology
from ._base import query, quoted, sql_map, table


@query(
    """SELECT s_suppkey, s_name, revenue, CAST(row_number() OVER (ORDER BY revenue DESC, s_suppkey) AS BIGINT) AS place FROM
  (SELECT s_suppkey, s_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name) ORDER BY revenue DESC, s_suppkey LIMIT 50"""
)
def supplier_leaderboard(spark, d):
    """WN02, AG16: a dense sequence after a stable sort. Revenue is aggregated before
    the join; the window runs over the 50 rows that are kept."""
    r = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    j = r.join(table(spark, d, "supplier"), r["l_suppkey"] == F.col("s_suppkey")).select("s_suppkey", "s_name", "revenue")
    top = j.orderBy(F.desc("revenue"), "s_suppkey").limit(50)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("revenue"), "s_suppkey")).cast("long"))


@query("SELECT n_name, s_name AS best, s_acctbal AS score FROM (SELECT n_name, s_name, s_acctbal, row_number() OVER (PARTITION BY n_name ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE r = 1")
def nation_best_of(spark, d):
    """AG16: argmax of each group, the first of equal ones."""
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("best"), F.max("s_acctbal").alias("score"))


@query("SELECT r_name, sum(s_acctbal * w) / sum(w) AS weighted, count(*) AS n FROM (SELECT r_name, s_acctbal, 1.0 + (n_regionkey % 4) * 0.5 AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name")
def region_weighted_average(spark, d):
    """AG17, AG32: weights by level."""
    j = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    w = 1.0 + (F.col("n_regionkey") % 4) * 0.5
    return j.groupBy("r_name").agg((F.sum(F.col("s_acctbal") * w) / F.sum(w)).alias("weighted"), F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def orders_resume_anti(spark, d):
    """JN03, SNK06: work that is not done."""
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def orders_available_semi(spark, d):
    """JN02."""
    have = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").join(have, "o_orderkey", "left_semi")


@query("SELECT o_orderpriority, o_orderstatus, o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r <= 25")
def orders_queue_claim(spark, d):
    """TK05."""
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderkey").limit(25).select("o_orderpriority", "o_orderstatus", "o_orderkey")


@query(
    """WITH b AS (SELECT k, max_by(p_partkey, p_partkey) AS build FROM (SELECT p_partkey, lower(substr(p_type, 1, 30)) AS k FROM part WHERE p_size < 25) GROUP BY k)
  SELECT p_partkey, b.build FROM (SELECT p_partkey, lower(substr(p_type, 1, 30)) AS k FROM part WHERE p_size >= 25) JOIN b USING (k)"""
)
def part_cognate_join(spark, d):
    """JN01: hash join on a key of 30 characters, the build side's last row wins."""
    p = table(spark, d, "part").withColumn("k", F.lower(F.substring("p_type", 1, 30)))
    build = lookup.last_wins(p.where("p_size < 25").select("k", "p_partkey"), "k", "p_partkey").withColumnRenamed("p_partkey", "build")
    return p.where("p_size >= 25").join(build, "k").select("p_partkey", "build")


@query(
    """WITH n AS (SELECT min(p_partkey) AS v, p_name AS k FROM part WHERE p_size <= 20 GROUP BY p_name), l AS (SELECT min(p_partkey) AS v, lower(p_name) AS k FROM part WHERE p_size <= 20 GROUP BY lower(p_name)),
  f AS (SELECT min(p_partkey) AS v, split_part(p_name, ' ', 1) AS k FROM part WHERE p_size <= 20 GROUP BY k), t AS (SELECT min(p_partkey) AS v, p_type AS k FROM part WHERE p_size <= 20 GROUP BY p_type)
  SELECT p_partkey, coalesce(n.v, l.v, f.v, t.v) AS hit, CASE WHEN n.v IS NOT NULL THEN 'exact' WHEN l.v IS NOT NULL THEN 'normalized' WHEN f.v IS NOT NULL THEN 'prefix' WHEN t.v IS NOT NULL THEN 'type' ELSE 'none' END AS tier
  FROM part q LEFT JOIN n ON n.k = q.p_name LEFT JOIN l ON l.k = lower(q.p_name) LEFT JOIN f ON f.k = split_part(q.p_name, ' ', 1) LEFT JOIN t ON t.k = q.p_type WHERE p_size > 20"""
)
def part_tiered_lookup(spark, d):
    """JN10."""
    p = table(spark, d, "part")
    dim = p.where("p_size <= 20").select("p_name", "p_type", F.col("p_partkey").alias("hit"))
    first = F.split_part(F.col("p_name"), F.lit(" "), F.lit(1))
    tiers = [("exact", F.col("p_name"), F.col("p_name")), ("normalized", F.lower("p_name"), F.lower("p_name")), ("prefix", first, first), ("type", F.col("p_type"), F.col("p_type"))]
    return lookup.tiered(p.where("p_size > 20").select("p_partkey", "p_name", "p_type"), dim, tiers, "hit").select("p_partkey", "hit", "tier")


@query("SELECT c_custkey, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS orders, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def customer_provenance(spark, d):
    """JN13: ids attached one to many; rows without any stay."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    j = table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left")
    return j.select("c_custkey", F.array_join(F.transform("o", lambda x: x.cast("string")), ",").alias("orders"), F.when(F.col("o").isNull(), 0).otherwise(F.size("o")).cast("long").alias("n"))


@query("SELECT n_name FROM nation ORDER BY n_name LIMIT 10 OFFSET 20")
def nation_page_clamped(spark, d):
    """TK03: page 999 of ten rows is the last one."""
    return lookup.page(table(spark, d, "nation").select("n_name"), ["n_name"], 999, 10)


@query("SELECT n_name, CAST((n_nationkey % 12 - 5 + 12) % 12 AS BIGINT) AS distance FROM nation ORDER BY distance, n_name")
def nation_upcoming(spark, d):
    """TK04: modular distance from the month 5."""
    return table(spark, d, "nation").select("n_name", F.pmod(F.col("n_nationkey") % 12 - 5, F.lit(12)).cast("long").alias("distance")).orderBy("distance", "n_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name || ' ' || n_regionkey), '1') AND lower(n_name) <> lower('CANADA')")
def nation_search(spark, d):
    """FLT10, FLT12."""
    n = table(spark, d, "nation")
    text = F.lower(F.concat_ws(" ", "n_name", F.col("n_regionkey").cast("string")))
    return n.where(text.contains("1") & (F.lower("n_name") != "canada")).select("n_nationkey", "n_name")


@query("SELECT r_name, array_to_string(list(n_name ORDER BY n_name), ',') AS members, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING list_contains(list(lower(n_name)), 'france') OR count(*) > 0")
def region_listing(spark, d):
    """AG03, FLT11."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = j.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("m"), F.count("*").alias("n"))
    return g.where(F.exists("m", lambda x: F.lower(x) == "france") | (F.col("n") > 0)).select("r_name", F.array_join("m", ",").alias("members"), "n")


@query("SELECT coalesce(n.k, o.k) AS k, coalesce(n.balance, o.balance) AS balance, coalesce(n.segment, o.segment) AS segment FROM (SELECT c_custkey AS k, c_acctbal AS balance, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal + 1 END AS balance, CAST(NULL AS VARCHAR) AS segment FROM customer WHERE c_custkey % 5 = 0) n ON o.k = n.k")
def customer_upsert(spark, d):
    """SNK03, SNK04, FLT16: nulls leave what is there."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    new = c.where("k % 5 = 0").select("k", F.when(F.col("k") % 2 == 0, F.col("balance") + 1).alias("balance"), F.lit(None).cast("string").alias("segment"))
    return lookup.upsert(c.where("k % 3 <> 0"), new, "k")


@query("SELECT i, j FROM range(1, 13) a(i), range(1, 13) b(j) WHERE j >= i + 2 AND i % 2 = 0 AND j % 3 = 0")
def config_grid(spark, d):
    """FLT18: valid pairs of a small grid, generated, not joined over data."""
    i = spark.range(1, 13).select(F.col("id").alias("i")).where("i % 2 = 0")
    return i.select("i", F.explode(F.sequence(F.lit(3).cast("long"), F.lit(12).cast("long"), F.lit(3).cast("long"))).alias("j")).where("j >= i + 2")


VALUES_P = ", ".join(f"('{a}', '{b}')" for a, b, _ in morphology.PRONOUNS)
VALUES_T = ", ".join(f"('{a}', '{b}')" for a, b in morphology.TENSES)


@query(
    f"""SELECT verb, tense, person, CASE WHEN tense = 'imperative' THEN verb ELSE pronoun || ' ' || particle || ' ' || verb END AS form
  FROM (SELECT DISTINCT lower(split_part(p_type, ' ', 1)) AS verb FROM part), (VALUES {VALUES_P}) p(person, pronoun), (VALUES {VALUES_T}) t(tense, particle) WHERE tense <> 'imperative' OR person IN ('2sg', '2pl')"""
)
def dim_paradigm_cross(spark, d):
    """JN09, MOR06."""
    verbs = table(spark, d, "part").select(F.lower(F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))).alias("verb")).distinct()
    return morphology.paradigm(spark, verbs, "verb")


_P = "^(la|ma|na)?(.{2,}?)((?:" + "|".join(sorted(morphology.SUFFIXES, key=lambda x: (-len(x), x))) + ")?)$"


@query(f"SELECT w, regexp_extract(w, '{_P}', 1) AS prefix, regexp_extract(w, '{_P}', 2) AS root, regexp_extract(w, '{_P}', 3) AS suffix, CASE WHEN suffix(w, 'baga') THEN 'agent' WHEN suffix(w, 'ya') THEN 'abstract' WHEN suffix(w, 'nin') THEN 'diminutive' WHEN suffix(w, 'ba') THEN 'augmentative' WHEN suffix(w, 'lu') THEN 'plural' ELSE 'common' END AS noun_class FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)")
def word_decomposition(spark, d):
    """MOR02, MOR03, MOR04: affixes by one anchored pattern, over distinct words."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w")).distinct()
    return w.select("w", morphology.decompose(F.col("w")).alias("m"), morphology.noun_class(F.col("w")).alias("noun_class")).select("w", "m.*", "noun_class")


_GLOSS = sql_map({k: v[0] for k, v in morphology.COMPOUND_ROOTS.items()})
_KIND = sql_map({k: v[1] for k, v in morphology.COMPOUND_ROOTS.items()})
_KNOWN = [sql_map({k: v[i] for k, v in morphology.KNOWN_COMPOUNDS.items()}) for i in range(3)]
_R = morphology.ROOT_PATTERN
_DIMS = f"r AS (SELECT unnest(map_keys({_GLOSS})) AS root, unnest(map_values({_GLOSS})) AS gloss, unnest(map_values({_KIND})) AS kind)"
_ALL_WORDS = f"WITH {_DIMS}, w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents UNION SELECT a.root || b.root FROM r a, r b UNION SELECT unnest(map_keys({_KNOWN[0]})))"


@query(
    f"""{_ALL_WORDS}, p AS (SELECT w, regexp_extract(w, '^((?:{_R})*)', 1) AS taken, {_KNOWN[0]}[w] AS kp, {_KNOWN[1]}[w] AS km, {_KNOWN[2]}[w] AS kh FROM w),
  q AS (SELECT *, regexp_extract_all(taken, '({_R})') AS roots FROM p),
  s AS (SELECT *, CASE WHEN len(roots) = 0 THEN []::VARCHAR[] WHEN length(taken) = length(w) THEN roots ELSE list_append(roots, w[length(taken) + 1:]) END AS parts FROM q),
  t AS (SELECT *, array_to_string(list_transform(CASE WHEN kp IS NOT NULL THEN string_split(kp, '+') ELSE parts END, lambda x: coalesce({_GLOSS}[x], '?')), '-') AS literal FROM s WHERE kp IS NOT NULL OR len(parts) >= 2)
  SELECT w, coalesce(kp, array_to_string(parts, '+')) AS parts, CASE WHEN kp IS NOT NULL THEN kh ELSE list_filter(roots, lambda x: {_KIND}[x] = 'noun')[-1] END AS head, literal, coalesce(km, '(' || literal || ')') AS meaning, CASE WHEN kp IS NOT NULL THEN 1.0::DOUBLE ELSE 0.7 END AS confidence FROM t"""
)
def word_compounds(spark, d):
    """MOR07: known and greedily split compounds among all words and all pairs of roots."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("w"))
    known = spark.createDataFrame([(k,) for k in morphology.KNOWN_COMPOUNDS], "w string")
    w = w.union(morphology.generated(spark).select("word")).union(known).distinct()
    return w.select("w", morphology.compound(F.col("w")).alias("c")).where("c is not null").select("w", "c.*")


@query(f"WITH {_DIMS} SELECT a.root AS first, b.root AS second, a.root || b.root AS word, a.gloss || '-' || b.gloss AS literal, CASE WHEN a.kind || '-' || b.kind IN ('noun-verb', 'verb-noun', 'adj-noun', 'noun-adj', 'verb-verb') THEN a.kind || '-' || b.kind ELSE 'noun-noun' END AS kind, 0.5::DOUBLE AS confidence FROM r a, r b WHERE a.root = 'so' OR b.root = 'so'")
def compounds_with_root(spark, d):
    """MOR07: hypothetical compounds that hold a root."""
    return morphology.generated(spark).where("first = 'so' OR second = 'so'")


_AFFIXES = ", ".join(f"({quoted(k)}, {quoted(v[0])}, {quoted(v[2])}, {quoted(v[3])})" for k, v in morphology.affix_forms().items())


@query(f"SELECT form, kind, latin, gloss, count(*) AS n FROM (SELECT regexp_extract(w, '.{{1,4}}$') AS e FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{{2,}}')) AS w FROM documents) UNION ALL SELECT unnest(['ߟߎ', 'ߟߊ', 'ߞߊ߲', 'LA', 'ߓߟߏ'])) JOIN (VALUES {_AFFIXES}) v(form, kind, latin, gloss) ON form = lower(e) GROUP BY form, kind, latin, gloss")
def affix_lookup(spark, d):
    """MOR08: the affix that a form stands for, in either script: words' last letters and some forms of the script."""
    w = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), F.lit(1))).alias("w"))
    e = w.select(F.regexp_extract("w", ".{1,4}$", 0).alias("e")).union(spark.createDataFrame([(x,) for x in ("ߟߎ", "ߟߊ", "ߞߊ߲", "LA", "ߓߟߏ")], "e string"))
    found = e.groupBy("e").agg(F.count("*").alias("k")).select(F.lower("e").alias("form"), "k", morphology.affix(F.col("e")).alias("a")).where("a.kind is not null")
    return found.groupBy("form", "a.kind", "a.latin", "a.gloss").agg(F.sum("k").alias("n"))


@query(
    """WITH t AS (SELECT p_name AS text, p_partkey AS ord, list_sort(list_distinct(string_split(p_name, ''))) AS c FROM part WHERE length(p_name) > 0), f AS (SELECT c, min(ord) AS ord FROM t GROUP BY c),
  s AS (SELECT list_reduce(list({'c': c, 'o': ord} ORDER BY ord), lambda s, x: list_append(s, {'c': x.c, 'o': x.o, 'd': coalesce(list_filter(s, lambda q: q.o = q.d AND len(list_intersect(q.c, x.c)) / len(list_distinct(list_concat(q.c, x.c))) >= 0.85)[1].d, x.o)}), []::STRUCT(c VARCHAR[], o BIGINT, d BIGINT)[]) AS s FROM f),
  m AS (SELECT x.c AS c, x.d AS seed FROM (SELECT unnest(s) AS x FROM s))
  SELECT seed, count(*) AS n, arg_max(text, length(text) * 1000000000 - ord) AS canonical, count(DISTINCT text) AS variants FROM t JOIN m USING (c) GROUP BY seed"""
)
def part_fuzzy_clusters(spark, d):
    """JN08, AG05: greedy clusters of part names by character sets, rolled up."""
    p = table(spark, d, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("ord"))
    c = dedup.greedy_clusters(p, "text", "ord")
    return c.groupBy("seed").agg(F.count("*").alias("n"), F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("canonical"), F.countDistinct("text").alias("variants"))


@query("SELECT CAST(count(*) AS BIGINT) AS frames, CAST(sum(CAST(floor(l_quantity * 0.55) AS BIGINT)) AS BIGINT) AS calls, round(sum(floor(l_quantity * 0.55)) * 0.002 + count(*) * 5 * 0.0001, 6) AS cost FROM lineitem")
def lineitem_cost_model(spark, d):
    """AG29: prices times counts cut to integers."""
    calls = F.floor(F.col("l_quantity") * 0.55)
    return table(spark, d, "lineitem").agg(F.count("*").alias("frames"), F.sum(calls).alias("calls"), F.round(F.sum(calls) * 0.002 + F.count("*") * 5 * 0.0001, 6).alias("cost"))


@query("SELECT l_returnflag, l_linestatus, exp(least(sum(l_tax * l_quantity) / sum(l_quantity), 20)) AS perplexity, sum(l_discount * l_quantity) / sum(l_quantity) AS accuracy, exp(least(sum(l_tax * l_quantity) FILTER (l_linenumber = 1) / sum(l_quantity) FILTER (l_linenumber = 1), 20)) / exp(least(sum(l_tax * l_quantity) FILTER (l_linenumber > 1) / sum(l_quantity) FILTER (l_linenumber > 1), 20)) AS tax FROM lineitem GROUP BY l_returnflag, l_linestatus")
def lineitem_perplexity(spark, d):
    """AG06: exponentials of ratios of sums, and the ratio of two filtered ones."""
    loss, tok = F.col("l_tax") * F.col("l_quantity"), F.col("l_quantity")

    def ppl(cond=None):
        a, b = (F.sum(loss), F.sum(tok)) if cond is None else (F.sum(F.when(cond, loss)), F.sum(F.when(cond, tok)))
        return F.exp(F.least(a / b, F.lit(20.0)))

    one = F.col("l_linenumber") == 1
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(ppl().alias("perplexity"), (F.sum(F.col("l_discount") * tok) / F.sum(tok)).alias("accuracy"), (ppl(one) / ppl(~one)).alias("tax"))
