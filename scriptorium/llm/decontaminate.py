"""Benchmark decontamination by winnowing.

A text's words are hashed; of each eight consecutive 6-gram hashes the least is
kept as a fingerprint. Any run of 13 = 6 + 8 - 1 words that a document shares
with a benchmark item therefore shares a fingerprint. Fingerprints of documents
are joined with those of the items. Each match is extended to the runs of 13 words
around it: each such run is looked up once among the items' runs, whatever the
number of matches that meet there, and compared word by word with the bytes of the
items' text. Time is so linear in a text's length also where a text repeats a
word or a passage. Items of fewer than 13 words are one run each.

The items' index is a map-side join. Its size is checked: items are taken in
blocks of at most ``block_chars`` characters, one pass over the documents for
each block, so neither broadcast nor memory grows with the benchmark; between
passes documents rest in the shared folder. Documents are never shuffled; a lost
task is simply run again.

Nulls and empty texts have no words: n_words 0, n_hit 0, no items. Empty tables of
documents give empty ones, of items no hits. Repeated documents each give a row;
repeated items count once by their item_id; a null item_id counts as the id
``null``. Ties among hashes are all kept. Very long texts are handled whole, in
memory in proportion to their length. Input columns named as an output are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import append, column, saved

WINDOW = 13
GRAM = 6
FIELDS = "n_words long, hit_ranges array<long>, item_ids array<string>"


def _running(a: np.ndarray, n: int, best) -> np.ndarray:
    """best of each n (a power of two) consecutive entries."""
    step = 1
    while step < n and len(a):
        a = best(a[:-step], a[step:])
        step *= 2
    return a


def winnow(grams: np.ndarray, span: int = WINDOW - GRAM + 1) -> np.ndarray:
    """Positions of the least gram of every window of ``span`` grams, ties included."""
    if len(grams) <= span:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)
    least = _running(grams, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(grams == _running(np.concatenate([edge, least, edge]), span, np.maximum))


def _at(value: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The hashes of _text.ngrams at some starts."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + value[starts + i]
    return _text.mix(out)


class Runs:
    """Runs of n words of the items: sorted hashes, each with its item and place."""

    def __init__(self, n: int, rows: list[tuple[np.ndarray, int]], words):
        self.n = n
        keys = np.concatenate([k for k, _ in rows])
        item = np.repeat([i for _, i in rows], [len(k) for k, _ in rows]).astype(np.int32)
        place = np.concatenate([np.arange(len(k), dtype=np.int32) for k, _ in rows])
        order = np.lexsort((place, item, keys))
        keys, item, place = keys[order], item[order], place[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (item[1:] != item[:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        for j in np.flatnonzero(~new).tolist():  # a run that an item repeats counts once, unless only its hash is the same
            new[j] = words(item[j], place[j], n) != words(item[j], place[first[j]], n)
        self.keys, self.item, self.place = keys[new], item[new], place[new]


class Index:
    """Fingerprints and runs of a block of items."""

    def __init__(self, rows: list[tuple[str, str]]):
        items = {}
        for item_id, text in rows:
            raw = np.frombuffer((text or "").encode(), np.uint8)
            begins, ends, value, _ = _text.words(raw, np.array([0, len(raw)]), _text.WORDISH)
            if len(value):
                low = _text._ASCII_LOWER[raw].tobytes()
                words = [low[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                items.setdefault((item_id, b" ".join(words)), (value, np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])))
        self.ids = [k for k, _ in items]
        self.bytes = [t for _, t in items]
        self.cuts = [c for _, c in items.values()]
        prints, by_size = [np.zeros(0, np.uint64)], {}
        for i, (value, _) in enumerate(items.values()):
            n = min(len(value), WINDOW)
            by_size.setdefault(n, []).append((_text.ngrams(value, n), i))
            if n == WINDOW:
                grams = _text.ngrams(value, GRAM)
                prints.append(grams[winnow(grams)])
        self.keys = np.unique(np.concatenate(prints))
        self.runs = {n: Runs(n, rows, self._words) for n, rows in by_size.items()}

    def _words(self, item: int, place: int, n: int) -> bytes:
        cuts = self.cuts[item]
        return self.bytes[item][cuts[place] : cuts[place + n] - 1]

    @staticmethod
    def _among(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Positions of the values that are among the sorted keys."""
        if not len(keys) or not len(values):
            return np.zeros(0, np.int64)
        near = np.zeros(1 << 16, bool)
        near[keys & np.uint64(0xFFFF)] = True
        maybe = np.flatnonzero(near[values & np.uint64(0xFFFF)])
        v = values[maybe]
        return maybe[keys[np.minimum(np.searchsorted(keys, v), len(keys) - 1)] == v]

    def _items(self, runs: Runs, key: int, words: bytes) -> list[int]:
        """The items that have this run, compared byte by byte."""
        a, b = np.searchsorted(runs.keys, np.uint64(key), "left"), np.searchsorted(runs.keys, np.uint64(key), "right")
        out = []
        for i, q in zip(runs.item[a:b].tolist(), runs.place[a:b].tolist(), strict=True):
            if i not in out[-1:] and self._words(i, q, runs.n) == words:
                out.append(i)
        return out

    def matches(self, flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: ranges of words that are hit, and the ids of the items."""
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        for n, runs in self.runs.items():
            if n == WINDOW:
                grams = _text.ngrams(value, GRAM)
                chosen = winnow(grams)
                hits = chosen[self._among(grams[chosen], self.keys)]
                near = np.zeros(len(value) + 1, bool)
                for back in range(WINDOW - GRAM + 1):
                    near[np.maximum(hits - back, 0)] = True
                starts = np.flatnonzero(near)
                keys = _at(value, starts := starts[starts + n <= len(value)], n)
            else:
                keys, starts = _text.ngrams(value, n), np.arange(max(0, len(value) - n + 1))
            hit = self._among(keys, runs.keys)
            starts, keys = starts[hit], keys[hit]
            docs = np.searchsorted(bounds, starts, "right") - 1
            whole = starts + n <= bounds[docs + 1]
            known: dict[tuple[int, int], tuple[bytes, list[int]]] = {}
            for p, key, doc in zip(starts[whole].tolist(), keys[whole].tolist(), docs[whole].tolist(), strict=True):
                words = b" ".join(_text._ASCII_LOWER[flat[a:b]].tobytes() for a, b in zip(begins[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True))
                before = known.get((doc, key))
                if before is None or before[0] != words:
                    own = self._items(runs, key, words)
                    known[(doc, key)] = words, own
                    if own:
                        found.setdefault(doc, ([], set()))[1].update(self.ids[i] for i in own)
                else:
                    own = before[1]
                if own:
                    found[doc][0].append((p - int(bounds[doc]), p - int(bounds[doc]) + n))
        return found


def _merge(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _pass(index: Index, text: str, first: bool):
    def compute(batch):
        counts, ranges, ids = [], [], []
        for part in _text.pieces(batch, batch.schema.names[[x.lower() for x in batch.schema.names].index(text.lower())]):
            flat, offsets, _ = _text.buffers(column(part, text))
            begins, ends, value, bounds = _text.words(flat, offsets, _text.WORDISH)
            found = index.matches(flat, begins, ends, value, bounds)
            counts.extend(np.diff(bounds).tolist())
            for d in range(part.num_rows):
                here, items = found.get(d, ((), ()))
                if not first:
                    flat_before = column(part, "hit_ranges")[d].as_py()
                    here = [*here, *zip(flat_before[::2], flat_before[1::2], strict=True)]
                    items = {*items, *column(part, "item_ids")[d].as_py()}
                ranges.append([x for pair in _merge(here) for x in pair])
                ids.append(sorted(items))
        return counts, ranges, ids

    return compute


def blocks(items: DataFrame, item_id: str, text: str, block_chars: int):
    """Lists of (id, text), each of about block_chars characters or one item."""
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // block_chars) or 1
    for k in range(n):
        yield [tuple(r) for r in (items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else items).collect()]


def contamination(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """docs with n_words, hit_ranges (flat list of word ranges, disjoint and in
    order), item_ids (of the items found, sorted as strings), n_hit, contaminated."""
    out, first = docs, True
    for rows in blocks(items, item_id, item_text, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Index(rows))
        out = out if first else saved(out)
        out, first = append(out, lambda batch, b=shared, f=first: _pass(b.value, text, f)(batch), FIELDS), False
    pairs = F.expr("transform(sequence(0, size(hit_ranges) div 2 - 1), i -> hit_ranges[2 * i + 1] - hit_ranges[2 * i])")
    n_hit = F.when(F.size("hit_ranges") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    return out.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of contract 5."""
    out = contamination(docs.select("doc_id", "text"), items)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
