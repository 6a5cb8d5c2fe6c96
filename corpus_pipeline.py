"""Cleaning of a training corpus: STAGES are applied to documents in order.

Each stage takes all rows its predecessor kept and returns the columns of
documents, the last one token ids besides. Columns of documents that are named as
an operator's own output are carried around it.

toxicity           documents predicted toxic go
ngram_join         of documents linked by 5-word shingles (similarity of 0.8 or
                   more, directly or over others) the one with the least doc_id stays
decontamination    documents contaminated with benchmark windows go
secrets            secrets in texts are masked, n_chars follows the text
sentencepiece      token_ids and n_tokens are added; columns of these names stay as
                   input_token_ids and input_n_tokens

Documents with a null doc_id are linked with nothing and stay. Rows that share a
doc_id are one node of the join; of those with one text one row stays, and rows with
other texts stay beside it, as they are no copies. Null texts stay null. Empty tables
give empty ones; very long texts are handled whole. Null labels and items count as
none; so toxicity without labels of both kinds lets all documents pass. run() removes a stage's own tables and its
input once its result has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import decontaminate, ngram_join, pieces, secrets, toxicity
from scriptorium.llm._spark import made, remainder, remove, saved, table

#: SentencePiece, random forests and recurrent networks are beyond SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None
BROADCAST_IDS = 1_000_000


def _around(docs: DataFrame, apply, own: tuple[str, ...]) -> DataFrame:
    """apply(docs) with the columns of docs back, even where they are named as the operator's own."""
    if not {c.lower() for c in docs.columns} & set(own):
        return apply(docs).select(*docs.columns)
    packed = docs.select(F.struct("*").alias("__row"), "doc_id", "text")
    return apply(packed).select("__row.*")


def stage_toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return _around(docs, lambda d: toxicity.score(d, model).where("predicted = 0"), ("score", "predicted"))


def stage_ngram_join(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = saved(ngram_join.link(docs.select("doc_id", "text"), n=5, percent=80))
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    kept = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("doc_id is not null and component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    few = repeated.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    again = F.broadcast(repeated) if few else repeated
    order = F.xxhash64(F.to_json(F.struct(*docs.columns)))
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("row.*"))


def stage_decontamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    own = ("n_words", "hit_ranges", "item_ids", "n_hit", "contaminated")
    return _around(docs, lambda d: decontaminate.contamination(d, items).where("not contaminated"), own)


def stage_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    if {c.lower() for c in docs.columns} & {"n_candidates", "secrets", "__found"}:
        masked = secrets.redact(docs.select(F.struct("*").alias("__row"), "text"))
        others = [F.col(f"__row.{c}").alias(c) if c.lower() != "text" else F.col("text") for c in docs.columns]
        masked = masked.withColumn("__n", F.size("secrets")).select(*others, "__n")
    else:
        masked = secrets.redact(docs).withColumn("__n", F.size("secrets"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def stage_sentencepiece(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = {"token_ids", "n_tokens", "decoded_ok"}
    if not {c.lower() for c in docs.columns} & own:
        return pieces.encode(docs, pieces.vocabulary()).drop("decoded_ok")
    coded = pieces.encode(docs.select(F.struct("*").alias("__row"), "text"), pieces.vocabulary())
    kept = [F.col(f"__row.{c}").alias(c if c.lower() not in own else f"input_{c}") for c in docs.columns]
    return coded.select(*kept, "token_ids", "n_tokens")


STAGES = [
    ("toxicity", stage_toxicity),
    ("ngram_join", stage_ngram_join),
    ("decontamination", stage_decontamination),
    ("secrets", stage_secrets),
    ("sentencepiece", stage_sentencepiece),
]


def run(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = set(made())
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
            *gone, _ = [p for p in made() if p not in old]  # the last one is this stage's result
            remove(spark, gone)
    return docs
