"""Literal cases of column functions and operators."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from scriptorium.catalogue import QUERIES
from scriptorium.functions import alignment, clean, features, fsm, metrics, script, translit
from scriptorium.operators import bpe, decode, dedup, intervals, lookup, morphology, stats
from scriptorium.sources import readers, sinks


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], [*values] or ["x"])
    return row.select(column.alias("out")).first().out


@pytest.mark.parametrize("text, want", [("", "latin"), ("12345", "latin"), ("ߒߞߏ abc", "nko"), ("ߒߞߏ", "nko"), ("سلام", "arabic"), ("hello", "latin")])
def test_vote(spark, text, want):
    assert one(spark, script.detect_vote(F.col("t")), t=text) == want


def test_first_and_mixed(spark):
    assert one(spark, script.detect_first(F.col("t")), t="12 ߒ abc") == "nko"
    assert one(spark, script.detect_mixed(F.col("t")), t="ߒߞabc") == "latin"
    assert one(spark, script.detect_mixed(F.col("t")), t="ߒߞab") == "mixed"


@pytest.mark.parametrize("text, target, want", [("ߒߞߏ", "latin", "nkɔ"), ("hello", "nko", "ߤߍߟߟߋ"), ("nana", "nko", "ߣߊߣߊ"), ("abc", "latin", "abc")])
def test_transliterate(spark, text, target, want):
    assert one(spark, translit.transliterate(F.col("t"), target)["target_text"], t=text) == want


def test_tones(spark):
    assert one(spark, script.strip_tones(F.col("t")), t="ߊ߫ߓ߬ߌ") == "ߊߓߌ"
    assert [(p.position, p.tone) for p in one(spark, script.tone_positions(F.col("t")), t="ߊ߫ߓ߬")] == [(1, "HIGH"), (3, "LOW")]


def test_digits(spark):
    assert one(spark, script.native_digits(F.col("n")), n=2024) == "߂߀߂߄"
    assert one(spark, script.native_digits(F.col("n")), n=-1) is None
    assert one(spark, script.digit_value(F.col("c")), c="߇") == 7


def test_automaton(spark):
    c, v, m = "ߓ", "ߊ", "߫"
    r = random.Random(3)
    for _ in range(60):
        text = "".join(r.choice([c, v, m, " ", "x"]) for _ in range(r.randint(0, 12)))
        state, violations, moves, bare_state = "start", 0, 0, "start"
        for ch in text:
            if ch in (c, v, m):
                if ch != m:
                    moves += 1
                    violations += ch == c and bare_state == "onset"
                    bare_state = "onset" if ch == c else "nucleus"
            if ch in " x":
                state = "start"
            elif ch != m:
                state = "onset" if ch == c else "nucleus"
        violations += bare_state == "onset"
        assert one(spark, fsm.admissible(F.col("t")), t=text) == (state != "onset")
        assert one(spark, fsm.validity_ratio(F.col("t")), t=text) == pytest.approx(1 - violations / moves if moves else 1.0)


def test_cleaning(spark):
    assert one(spark, clean.phrase(F.col("t")), t=" Ab,  c! (d) ") == "Ab c d"
    assert one(spark, clean.strip_wikitext(F.col("t")), t="{{x|{{y}}}}'''Bold''' [[a|b]] [[c]]<!-- n -->\n== T ==\n* i") == "Bold b c\nT\ni"
    assert one(spark, clean.strip_wikitext(F.col("t")), t="#redirect [[x]]") == ""
    assert one(spark, clean.strip_fence(F.col("t")), t="```json\n{}\n```") == "{}"
    assert set(one(spark, clean.candidates(F.col("t")), t="Say 'Word Two' ɲɛ ߒߞߏ no")) == {"word two", "ɲɛ", "ߒߞߏ"}


def test_words_of_blank(spark):
    assert one(spark, clean.words(F.col("t")), t=" \n ") == []


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_error_rates(spark):
    r = random.Random(5)
    for _ in range(25):
        a, b = (" ".join(r.choice("ab cd é".split()) for _ in range(r.randint(0, 6))) for _ in range(2))
        w = _distance(a.split(), b.split()) / len(a.split()) if a.split() else float(bool(b.split()))
        assert one(spark, metrics.word_error(F.col("a"), F.col("b"), False), a=a, b=b) == pytest.approx(w)
        c = _distance(a, b) / len(a) if a else float(bool(b))
        assert one(spark, metrics.char_error(F.col("a"), F.col("b"), False), a=a, b=b) == pytest.approx(c)
        e = one(spark, alignment.edits("a", "b"), a=a, b=b)
        assert e.substituted + e.deleted + e.inserted == _distance(a, b) and e.correct + e.substituted + e.deleted == len(a)


def test_lcs(spark):
    def brute(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(8)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(2))
        assert alignment._lcs(a, b) == brute(a, b)


def test_partial_and_numbers(spark):
    assert one(spark, metrics.partial(F.col("a"), F.col("b")), a="The big cat", b="big") == 1.0
    assert one(spark, metrics.partial(F.col("a"), F.col("b")), a="The big cat", b="cat dog") == 0.5
    assert one(spark, metrics.partial(F.col("a"), F.col("b")), a="The", b="xy zz") == 0.0
    assert one(spark, metrics.numeric_score(F.col("a"), F.lit(10)), a="so 3, then 10.5") == 1.0
    assert one(spark, metrics.numeric_score(F.col("a"), F.lit(10)), a="20") == pytest.approx(math.exp(-5))
    assert one(spark, metrics.numeric_score(F.col("a"), F.lit(0)), a="0.001") == 1.0
    assert one(spark, metrics.numeric_score(F.col("a"), F.lit(0)), a="none") == 0.0


def test_signature_and_density(spark):
    assert len(one(spark, features.signature(F.col("t")), t="ߒߞߏ")) == 16
    assert one(spark, features.operators(F.col("t")), t="ߒߞߏߓ") == [0, 1, 2, 3]
    assert one(spark, features.density(F.lit(50), F.lit(0), F.lit(2))) == 9999
    r = one(spark, features.invariance(F.lit(20), F.lit(0.9), F.lit(0.9), F.lit(0.9)))
    assert r.passed and r.score == pytest.approx(0.6) and r.failure is None
    assert one(spark, features.invariance(F.lit(5), F.lit(0.9), F.lit(0.9), F.lit(0.9))).failure == "insufficient_coverage"


def test_first_wins_keeps_order(spark):
    df = spark.createDataFrame([(3, "a"), (1, "b"), (2, "a"), (4, None), (5, None)], "ord long, k string")
    assert sorted(r.ord for r in dedup.first_wins(df, F.col("k"), "ord").collect()) == [1, 2, 4]


def test_greedy_clusters_are_those_of_a_sequential_pass(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(120)]

    def similar(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.6

    seeds, want = [], {}
    for i, t in enumerate(texts):
        hit = next((s for s in seeds if similar(texts[s], t)), None)
        if hit is None:
            seeds.append(i)
            hit = i
        want[i] = hit
    df = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    assert {x.ord: x.seed for x in dedup.greedy_clusters(df, "text", "ord", 0.6).collect()} == want


def test_intervals_against_nested_loops(spark):
    r = random.Random(4)
    points = [(k, i, r.randint(0, 100)) for i, k in enumerate("ab" * 30)]
    spans = [(k, i, s := r.randint(0, 90), s + r.randint(1, 40)) for i, k in enumerate("ab" * 10)]
    p, s = spark.createDataFrame(points, "k string, pid long, at long"), spark.createDataFrame(spans, "k string, sid long, start long, stop long")
    got = {(x.pid, x.sid) for x in intervals.points_in(p, s, "k", "at", "start", "stop", 7).collect()}
    assert got == {(i, j) for k, i, t in points for q, j, a, b in spans if k == q and a <= t < b}
    left = spark.createDataFrame([(k, i, t, t + 15) for k, i, t in points], "k string, lid long, a long, b long")
    got = {x.lid: (x.sid, x.overlap) for x in intervals.best_overlap(left, s, "k", ("a", "b"), ("start", "stop"), "lid", "sid", 7).collect()}
    want = {}
    for k, i, t in points:
        found = [(min(t + 15, b) - max(t, a), -j) for q, j, a, b in spans if q == k and t < b and a < t + 15]
        if found:
            o, j = max(found)
            want[i] = (-j, o)
    assert got == want


def test_segments(spark):
    df = spark.createDataFrame([("f", 1.0, 4.0), ("f", 4.5, 6.0), ("f", 20.0, 60.0), ("f", 90.0, 90.5)], "k string, s double, e double")
    out = sorted((round(r.s, 3), round(r.e, 3)) for r in intervals.merge_capped(df, "k", "s", "e").collect())
    assert out[0] == (0.7, 6.3) and len(out) == 4 and all(e - s <= 15 for s, e in out)


def test_suppression(spark):
    df = spark.createDataFrame([("u", 1, 0), ("u", 2, 1), ("u", 3, 0x7FFF), ("u", 4, 0x7FFE), ("v", 1, 0)], "k string, ord long, h long")
    assert sorted((r.k, r.ord) for r in intervals.suppress_near(df, "k", "ord", "h").collect()) == [("u", 1), ("u", 3), ("v", 1)]


def test_lookups(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y int")
    new = spark.createDataFrame([(2, None, 5), (3, "c", None)], "k long, x string, y int")
    assert sorted(map(tuple, lookup.upsert(old, new, "k").collect())) == [(1, "a", 1), (2, "b", 5), (3, "c", None)]
    assert [r.k for r in lookup.page(old, ["k"], 999, 1).collect()] == [2]
    assert tuple(lookup.last_wins(spark.createDataFrame([("x", 1), ("x", 2)], "k string, o long"), "k", "o").first()) == ("x", 2)


def test_morphology(spark):
    m = one(spark, morphology.decompose(F.col("w")), w="mogolu")
    assert (m.prefix, m.root, m.suffix) == ("", "mogo", "lu") or (m.prefix, m.root, m.suffix) == ("", "mogo", "lu")
    c = one(spark, morphology.compound(F.col("w")), w="jisox")
    assert (c.parts, c.head, c.literal, c.confidence) == ("ji+so+x", "so", "water-house-?", 0.7)
    assert one(spark, morphology.compound(F.col("w")), w="soda").meaning == "doorway" and one(spark, morphology.compound(F.col("w")), w="xso") is None
    assert one(spark, morphology.affix(F.col("w")), w="LU").gloss == "PL" and one(spark, morphology.affix(F.col("w")), w="ߟߊ").kind == "derivational" and one(spark, morphology.affix(F.col("w")), w="zz").kind is None
    assert morphology.paradigm(spark, spark.createDataFrame([("taa",)], ["v"]), "v").count() == 6 * 6 + 2


def test_average_ranks(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 3, 3, 9, 3)], "v int")
    assert sorted((r.v, r.rank) for r in stats.average_rank(df, "v", "rank").collect()) == [(1, 1.0), (3, 3.0), (3, 3.0), (3, 3.0), (5, 5.0), (9, 6.0)]


def test_merges(spark):
    df = spark.createDataFrame([("ababab ab cd",)] * 5, "t string")
    merges = bpe.train(bpe.word_frequencies(df, "t", 1), 2, 1)
    assert merges[0] == ("a", "b")
    assert bpe.encode(df, "t", merges[:1]).first().tokens == ["ab", "ab", "ab", "ab", "c", "d"]


def test_merges_on_the_driver_equal_those_of_the_loop(spark):
    df = spark.createDataFrame([("ababab ab cd aaaa aaa cdcd bab abab",), ("cdab aab aab bbb",)] * 3, "t string")
    words = bpe.word_frequencies(df, "t", 1)
    assert bpe.train(words, 12, 3) == bpe.train(words, 12, 3, few=0) != []


def test_all_merges_are_learned(spark):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no tables")
    steps = [r.step for r in QUERIES["native_bpe_merges"](spark, data).collect()]
    assert steps == list(range(256))


def test_short_texts_are_one_chunk(spark, tmp_path):
    texts = [(1, "a" * 79), (2, "b" * 80), (3, " c\n\n" + "d" * 597 + " "), (4, "e" * 600), (5, None)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.doc_id, r.pos, r.n) for r in QUERIES["doc_short_chunks"](spark, tmp_path).collect()) == [(2, 0, 80), (3, 0, 599)]
    assert {r.doc_id for r in QUERIES["doc_chunks"](spark, tmp_path).collect()} == {4}


def test_frequency_tables_are_whole(spark, tmp_path):
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in "aeiou" for c in "bdfgklm"]
    spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["doc_all_word_frequencies"](spark, tmp_path).count() == len(words) > 200
    assert {(r.a, r.b, r.n) for r in QUERIES["doc_all_pair_counts"](spark, tmp_path).collect()} == {(a, b, 1) for a, b in zip(words, words[1:], strict=False)}


def test_decoding(spark):
    assert one(spark, decode.collapse(F.array(*map(F.lit, [0, 1, 1, 0, 1, 2, 2])))) == [1, 1, 2]
    frames = [[math.log(p) for p in f] for f in ([0.1, 0.8, 0.1], [0.6, 0.3, 0.1], [0.1, 0.1, 0.8])]
    assert decode.beam(frames, ["", "a", "b"])[0] == "ab"
    df = spark.createDataFrame([(1, frames)], "i long, f array<array<double>>")
    assert decode.beam_search(df, "f", ["", "a", "b"]).first().text == "ab"


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nbad\n{"x": 2}\n')
    assert sorted(r.x for r in readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    (tmp_path / "p.txt").write_text("a\tb\nc\n\td\ne\tf\tg\n")
    assert sorted(map(tuple, readers.tsv_pairs(spark, str(tmp_path / "p.txt")).collect())) == [("a", "b"), ("e", "f")]
    (tmp_path / "m.json").write_text('{"words": {"so": {"n": 1}, "ji": {"n": 2}}, "items": [{"n": 7}]}')
    assert sorted((r.key, r.n) for r in readers.json_map(spark, str(tmp_path / "m.json"), "words", "struct<n:int>").collect()) == [("ji", 2), ("so", 1)]
    assert [r.n for r in readers.json_items(spark, str(tmp_path / "m.json"), "items array<struct<n:int>>", "items").collect()] == [7]
    (tmp_path / "l1").write_text("x\ny\n")
    (tmp_path / "l2").write_text("X\nY\n")
    assert sorted((r.line, r.a, r.b) for r in readers.aligned(spark, {"a": str(tmp_path / "l1"), "b": str(tmp_path / "l2")}).collect()) == [(0, "x", "X"), (1, "y", "Y")]
    (tmp_path / "t.tsv").write_text("NKO text\tEN text\nߒ\tI\n")
    assert readers.parallel(spark, str(tmp_path / "t.tsv")).first().asDict() == {"nko": "ߒ", "en": "I"}
    assert readers.options({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert readers.listing(spark, str(tmp_path), "*.json").count() == 1


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("s", 1, True, [("a", 0.5)]), ("s", 2, False, [])], "source string, frame int, has_text boolean, detections array<struct<text:string,confidence:double>>")
    t = sinks.fan_out(f, "source", str(tmp_path / "f"))
    assert tuple(t["sources"].first()) == ("s", 2, 1) and spark.read.parquet(str(tmp_path / "f/detections")).count() == 1
    sinks.manifests(spark.createDataFrame([("é", "train"), ("b", "val")], "t string, split string"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    assert "| a |" in sinks.markdown(spark.createDataFrame([(1,)], ["a"]), "T")
    assert sinks.triples(spark.createDataFrame([("w", "x", None)], "s string, p string, q string"), "s", ["p", "q"]).count() == 1


def test_stream_equals_batch(spark):
    from scriptorium.catalogue import QUERIES

    d = "/root/testdata/sf0.001"
    a, b = ({tuple(r) for r in QUERIES[q](spark, d).collect()} for q in ("stream_hash_suppress", "event_hash_suppress"))
    assert {(u, e) for u, e in a} == {(u, e) for u, e in b}
