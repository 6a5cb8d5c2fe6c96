"""Document fingerprints: canonical exact digests.

A text is put into Unicode form NFKC, case-folded, put into NFKC again, and its
white space folded to single spaces; the fingerprint is the 128-bit xxHash of the
UTF-8 bytes, with their number. Equal texts have equal fingerprints; texts that
differ only in what is folded have too. ``groups`` compares the bytes within each
bucket of one digest, so different texts are never put together.

``next_documents`` pairs each row with the next one of a global order without one
large window: rows go to ranges of ids, each range is sorted and paired by its task,
and the first and last rows of ranges, two for each, are paired by a small join. One
shuffle of the texts; neither plan nor row expressions grow with the ranges.

Null texts are empty. Rows are ordered by descending doc_id (null last), then by
text, and ranges follow both, so that rows of one id or none spread over them; repeated
rows follow each other. An empty table gives an empty result. Very long texts are one row
each. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import append, column, partitions, saved


def canonical(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split())


def digest(text: str | None) -> str:
    raw = canonical(text or "").encode("utf-8", "surrogatepass")
    return f"{xxhash.xxh3_128_hexdigest(raw)}-{len(raw):x}"


def fingerprints(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with fingerprint and canonical_bytes (the canonical text)."""

    def compute(batch):
        folded = [canonical(t or "").encode("utf-8", "surrogatepass") for t in column(batch, text).to_pylist()]
        return [f"{xxhash.xxh3_128_hexdigest(b)}-{len(b):x}" for b in folded], folded

    return append(docs, compute, "fingerprint string, canonical_bytes binary")


def groups(marked: DataFrame, docs: DataFrame, *, broadcast_rows: int = 300_000) -> DataFrame:
    """marked (doc_id, fingerprint, ...) with group_id: the least doc_id of the rows
    whose canonical bytes are equal.

    Buckets are found on digests alone. Only texts of buckets with more than one row
    are compared byte by byte, pre-aggregated before the shuffle; their digests are
    broadcast up to ``broadcast_rows``, joined by a shuffle beyond."""
    buckets = saved(marked.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("group_id")))
    shared = buckets.where("n > 1").select("fingerprint")
    if shared.limit(broadcast_rows + 1).count() <= broadcast_rows:
        shared = F.broadcast(shared)
    equal = saved(fingerprints(docs.select("doc_id", "text")).drop("text").join(shared, "fingerprint", "left_semi").groupBy("fingerprint", "canonical_bytes").agg(F.min("doc_id").alias("group_id")).select("fingerprint", F.sha2("canonical_bytes", 512).alias("bytes"), "group_id"))
    collided = equal.groupBy("fingerprint").agg(F.count("*").alias("texts")).where("texts > 1").select("fingerprint")
    plain = marked.join(buckets.drop("n"), "fingerprint", "left")
    if not collided.limit(1).count():
        return plain
    own = fingerprints(docs.select("doc_id", "text")).drop("text").join(collided, "fingerprint", "left_semi").withColumn("bytes", F.sha2("canonical_bytes", 512)).drop("canonical_bytes")
    exact = own.join(equal, ["fingerprint", "bytes"]).select("doc_id", "fingerprint", F.col("group_id").alias("exact")).distinct()
    return plain.join(exact, ["doc_id", "fingerprint"], "left").withColumn("group_id", F.coalesce("exact", "group_id")).drop("exact")


def _paired(batches, compute):
    """Rows of a range in order: results of all but the last, which have their next row
    here; the range's first and last row themselves, for the ranges beside it."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    first = held = None

    def table(rows, edges):
        columns = compute(*(list(c) for c in zip(*rows, strict=True))) if rows else [[]] * (len(names))
        n = len(edges)
        arrays = [pa.array([*c, *[None] * n], t) for c, t in zip(columns, types, strict=True)]
        m = len(rows)
        arrays += [pa.array([None] * m + [e[i] for e in edges], t) for i, t in enumerate((pa.int32(), pa.bool_(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[*names, *EDGE])

    names, types = compute.names, compute.types
    for batch in batches:
        rows = []
        for row in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if held is None:
                first = row
            else:
                rows.append((*held, row[1]))
            held = row
        yield table(rows, [])
    if held is not None:
        yield table([], [(part, True, *first), (part, False, *held)])


EDGE = ("__part", "__first", "__id", "__text")


class _Compute:
    """A function with the Arrow names and types of its result."""

    def __init__(self, function, fields: str):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        schema = to_arrow_schema(_parse_datatype_string(fields))
        self.function, self.names, self.types = function, schema.names, schema.types

    def __call__(self, *columns):
        return self.function(*columns)


def next_documents(docs: DataFrame, compute, fields: str) -> DataFrame:
    """Results over rows in descending doc_id with the next row's text (after the
    last: the first's): compute(ids, texts, next_texts) -> list of arrays."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    compute = _Compute(compute, fields)
    by = F.col("doc_id").desc_nulls_last()
    placed = docs.repartitionByRange(2 * partitions(docs), by, F.substring("text", 1, 24)).sortWithinPartitions(by, "text")
    done = saved(placed.mapInArrow(lambda batches: _paired(batches, compute), f"{fields}, __part int, __first boolean, __id long, __text string"))
    # two rows for each range; the order of ranges is a number for each of them
    edges = done.where("__part is not null").select(*EDGE)
    order = sorted(r["__part"] for r in edges.where("__first").select("__part").collect())
    follow = docs.sparkSession.createDataFrame([(p, order[(i + 1) % len(order)]) for i, p in enumerate(order)], "__part int, after int")
    firsts = edges.where("__first").select(F.col("__part").alias("after"), F.col("__text").alias("next"))
    lasts = edges.where("not __first").join(F.broadcast(follow), "__part").join(firsts, "after").select(F.col("__id").alias("doc_id"), F.col("__text").alias("text"), "next")

    def run(batches):
        for batch in batches:
            columns = compute(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next")))
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(columns, compute.types, strict=True)], names=compute.names)

    return done.where("__part is null").drop(*EDGE).union(lasts.mapInArrow(run, fields))


def edited(text: str, other: str) -> str:
    """Its last floor(n / 2) code points replaced by as many (or all) of the other's first."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _report(ids, texts, nexts):
    marks, after, edits, hashes = [], [], [], []
    for text, other in zip(texts, nexts, strict=True):
        new = edited(text, other)
        marks.append(digest(text))
        edits.append(digest(new))
        after.append(digest(other))
        hashes.append(hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest())
    return ids, [len(t) for t in texts], hashes, marks, edits, [float(a == b) for a, b in zip(marks, edits, strict=True)], [float(a == b) for a, b in zip(marks, after, strict=True)]


def report(docs: DataFrame) -> DataFrame:
    """The columns of contract 7, and group_id. Likeness of exact digests is 1 if equal, else 0."""
    marked = next_documents(docs.select("doc_id", "text"), _report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return groups(saved(marked), docs.select("doc_id", "text"))
