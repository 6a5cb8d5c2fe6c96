"""The pipeline against brute force on a small corpus, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from scriptorium.llm import _text, decontaminate, ngram_join, pieces, secrets, toxicity

from .test_operators import WORDISH, LOW, brute_components, brute_contamination, vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    r = random.Random(12)
    v = vocabulary(r, 80)
    items = [(i, " ".join(r.choice(v) for _ in range(20))) for i in range(5)]
    rows = []
    for i in range(120):
        w = [r.choice(v) for _ in range(r.randint(3, 80))]
        kind = i % 8
        if kind == 1:
            w.insert(len(w) // 2, "idiot")
        elif kind == 2:
            w[len(w) // 2 : len(w) // 2] = r.choice(items)[1].split()
        elif kind == 3:
            w.insert(1, 'token = "%s"' % "".join(r.choice("0123456789abcdef") for _ in range(40)))
        elif kind == 4 and rows:
            w = (rows[-4][1] or "").split()
            w[0:1] = [r.choice(v)]
        text = " ".join(w)
        rows.append((i, text, "en", "s", len(text)))
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, "one", "en", "s", 3), (None, "no id here", "en", "s", 10), (503, "again again", "en", "s", 11), (503, "again again", "en", "s", 11)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows, items


def test_pipeline_against_brute_force(spark, corpus):
    d, rows, items = corpus
    labels = spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{d}/documents.parquet"), labels.where(corpus_pipeline.remainder("doc_id", 5) != 0))
    flat, offsets, _ = _text.buffers(pa.array([t for _, t, *_ in rows], pa.large_string()))
    kept = [x for x, s in zip(rows, model.scores(flat, offsets), strict=True) if s < 0.5]
    assert {x[0] for x in rows} - {x[0] for x in kept} >= {i for i in range(1, 120, 8)} - {x[0] for x in kept}
    assert sum(i % 8 == 1 for i, *_ in kept if i is not None and i < 120) <= 1
    component = brute_components([(x[0], x[1]) for x in kept if x[0] is not None], 5, 80)
    joined = [x for x in {(x[0], x[1]): x for x in kept}.values() if x[0] is None or component[x[0]][1] == x[0]]
    dirty = {x[0] for x in brute_contamination([(x[0], x[1]) for x in joined], items) if x[-1]}
    codec = pieces.Codec(pieces.vocabulary())
    want = []
    for i, t, lang, source, n in joined:
        if i in dirty:
            continue
        _, found, clean = secrets.brute(t)
        ids = np.frombuffer(codec.encode(clean or ""), np.int32).tolist()
        want.append((i, clean, lang, source, len(clean) if found else n, ids, len(ids)))
    df = corpus_pipeline.run(spark, d)
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "n_tokens"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
    assert len(dirty) > 3 and any(secrets.MASK in (x[1] or "") for x in want) and len(joined) < len(kept)


def test_stages_keep_columns_that_clash(spark, corpus):
    d, rows, _ = corpus
    own = [(i, f"plain text number {i} of some words", "x", 3, "mine", 0.5, "k", 7) for i in range(200, 204)]
    names = ["doc_id", "text", "source", "n_words", "secrets", "score", "node", "n_tokens"]
    docs = spark.createDataFrame(own, "doc_id long, text string, source string, n_words int, secrets string, score double, node string, n_tokens int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == names
        assert sorted(map(tuple, docs.collect())) == sorted(own)
    docs = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert docs.columns == [*names[:-1], "input_n_tokens", "token_ids", "n_tokens"]
    assert sorted(tuple(r)[:8] for r in docs.collect()) == sorted(own) and all(r.n_tokens == len(r.token_ids) > 0 for r in docs.collect())


def test_texts_that_share_an_id_stay(spark, corpus):
    rows = [(1, "one text of some words here", "a"), (1, "quite another text with words", "b"), (1, "one text of some words here", "c"), (2, "one text of some words here", "d"), (3, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = corpus_pipeline.stage_ngram_join(spark, docs, corpus[0]).collect()
    assert sorted((r.doc_id, r.text) for r in got if r.text) == [(1, "one text of some words here"), (1, "quite another text with words")] and len(got) == 3


def test_run_removes_its_tables(spark, corpus):
    from scriptorium.llm._spark import made

    before = len(made())
    corpus_pipeline.run(spark, corpus[0]).count()
    assert len(made()) - before <= 2


def test_stages_take_very_long_texts(spark, corpus):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300_000)), "en", "s", 0)], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus[0])
    assert docs.first().n_tokens > 300_000


def test_stages_take_empty_tables(spark, corpus):
    d, *_ = corpus
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d)
        assert docs.count() == 0
    assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]


def test_words_of_contract():
    assert WORDISH.findall("A-b".translate(LOW)) == ["a", "b"] and decontaminate.WINDOW == 13 and ngram_join.SMALL_BLOCK > ngram_join.CHUNK
