"""Language identification by hyperdimensional profiles.

Each letter has a fixed random vector of +1 and -1. The vectors of three
consecutive letters, rotated by 2, 1 and 0 places, are bound by multiplication into
the vector of a 3-gram (anything between letters is one more letter). A text's
3-gram vectors are bundled by addition, a language's prototype bundles its learning
texts, and a text gets the language of the prototype with the largest cosine.

Learning takes at most ``fit_docs`` labelled texts, a fixed hash sample; that is the
bound. Prediction is one pass without a shuffle over whole texts; memory follows
the batch. Ties go to the language that sorts first. A text that is null or has no
letter is ``und`` with score 0; so is every text if nothing was learned. Rows with a
null language are predicted but not learned from.
"""

from __future__ import annotations

import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import append, column, hashed_sample, remainder

DIMENSION = 512
_ROWS = 40_000


def _letter_vector(code_point: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([20, code_point])).integers(0, 2, DIMENSION).astype(np.int8) * 2 - 1


class Encoder:
    """Bundled vectors of texts. Letters and 3-gram vectors met before are kept, up to _ROWS of them."""

    def __init__(self):
        self.letter: dict[int, bool] = {}
        self.vectors: dict[int, np.ndarray] = {0: _letter_vector(0)}
        self.rows: dict[tuple[int, int, int], int] = {}
        self.table = np.zeros((1024, DIMENSION), np.float32)

    def _is_letter(self, c: int) -> bool:
        if c not in self.letter:
            self.letter[c] = unicodedata.category(chr(c))[0] == "L"
        return self.letter[c]

    def _row(self, gram: tuple[int, int, int]) -> int:
        row = self.rows.get(gram)
        if row is None:
            row = self.rows[gram] = len(self.rows)
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            a, b, c = (self.vectors[x] if x in self.vectors else self.vectors.setdefault(x, _letter_vector(x)) for x in gram)
            self.table[row] = np.roll(a, 2) * np.roll(b, 1) * c
        return row

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, whether there is a letter)."""
        out = np.zeros((len(texts), DIMENSION), np.float32)
        some = np.zeros(len(texts), bool)
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or (size < 1 << 20 and stop - at < 256)):
                size += len(texts[stop] or "")
                stop += 1
            self._part(texts[at:stop], out[at:stop], some[at:stop])
            at = stop
        return out, some

    def _part(self, texts, out, some) -> None:
        codes = [np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        flat = np.concatenate(codes)
        doc = np.repeat(np.arange(len(texts)), [len(c) for c in codes])
        top = int(flat.max()) + 1
        present = np.flatnonzero(np.bincount(flat, minlength=top))
        letters = [0, *(int(c) for c in present if self._is_letter(int(c)))]
        place = np.zeros(top, np.int64)
        place[letters[1:]] = np.arange(1, len(letters))
        symbol = place[flat]
        first = np.concatenate([[True], doc[1:] != doc[:-1]])
        keep = (symbol > 0) | first | np.concatenate([[True], symbol[:-1] > 0])
        symbol, doc = symbol[keep], doc[keep]
        some[np.unique(doc[symbol > 0])] = True
        if len(symbol) < 3:
            return
        k = len(letters)
        gram = (symbol[:-2] * k + symbol[1:-1]) * k + symbol[2:]
        own = doc[:-2]
        within = (own == doc[2:]) & (symbol[1:-1] > 0)
        gram, own = gram[within], own[within]
        if not len(gram):
            return
        if k**3 <= 1 << 22:
            used = np.flatnonzero(np.bincount(gram, minlength=k**3))
            index = np.zeros(k**3, np.int64)
            index[used] = np.arange(len(used))
            index = index[gram]
        else:
            used, index = np.unique(gram, return_inverse=True)
        if len(self.rows) + len(used) > _ROWS:
            self.rows, self.table = {}, np.zeros((1024, DIMENSION), np.float32)
        names = [(letters[g // (k * k)], letters[g // k % k], letters[g % k]) for g in used.tolist()]
        for s in range(0, len(used), _ROWS // 2):  # blocks, for scripts with very many letters
            rows = np.array([self._row(g) for g in names[s : s + _ROWS // 2]])
            inside = (index >= s) & (index < s + len(rows)) if len(rows) < len(used) else slice(None)
            width = len(rows)
            counts = np.bincount(own[inside] * width + (index[inside] - s), minlength=len(texts) * width).astype(np.float32)
            out += counts.reshape(len(texts), width) @ self.table[rows]
            if len(rows) < len(used):
                self.rows, self.table = {}, np.zeros((1024, DIMENSION), np.float32)


_encoders: list[Encoder] = []


def _kept() -> Encoder:
    """The worker's encoder; what it has met outlives a task."""
    if not _encoders:
        _encoders.append(Encoder())
    return _encoders[0]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-9)


def _bundles(batches):
    import pyarrow as pa

    encoder, sums = Encoder(), {}
    for batch in batches:
        langs = column(batch, "lang").to_pylist()
        vectors = _unit(encoder(column(batch, "text").to_pylist())[0])
        for lang, v in zip(langs, vectors, strict=True):
            sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "vector"])


def fit(docs: DataFrame, *, fit_docs: int = 20_000) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from at most fit_docs texts with lang, one for each
    of as many doc_ids; of rows that share an id the least counts."""
    known = docs.where("text is not null and lang is not null")
    chosen = hashed_sample(known.select("doc_id").distinct(), "doc_id", fit_docs, "language")
    parts = known.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("row.*").mapInArrow(_bundles, "lang string, vector array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for lang, vector in sorted((r.lang, r.vector) for r in parts):
        sums[lang] = sums.get(lang, 0) + np.array(vector)
    langs = sorted(sums)
    return langs, _unit(np.array([sums[x] for x in langs]).reshape(len(langs), DIMENSION)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the cosine (0 if negative)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        encoder = _kept()
        langs, prototypes = shared.value
        vectors, some = encoder(column(batch, text).to_pylist())
        if not langs:
            return ["und"] * len(some), np.zeros(len(some))
        cosine = _unit(vectors) @ prototypes.T
        best = cosine.argmax(1) if len(cosine) else np.zeros(0, np.int64)
        score = np.clip(cosine.max(1) if len(cosine) else np.zeros(0), 0, 1).astype(np.float64)
        return [langs[i] if s else "und" for i, s in zip(best.tolist(), some.tolist(), strict=True)], np.where(some, score, 0.0)

    return append(docs, compute, "lang_pred string, score double")


def report(docs: DataFrame) -> DataFrame:
    """The columns of contract 2: texts with crc32(doc_id) mod 4 = 2 are held out."""
    model = fit(docs.where(remainder("doc_id", 4) != 2))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
