"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Each word enters as word inputs and character inputs: learned embeddings of the word
and of its character 4-grams (hashed tables), and the association with the label of
the word itself, of its strongest character 4-gram and of its strongest 5-gram (a mark
stands for the word's start). The network reads segments of SPAN words with CONTEXT
more on both sides; attention pools the states of every overlapping window of WIDTH
words, one at each word, by running sums. A text's score is that of its worst window,
calibrated to a probability.

Embeddings and network are fitted together in numpy on the driver, from at most
``fit_docs`` labelled documents and ``fit_chars`` characters of them: the bounds on
the sample are those parameters. Associations of a document that is fitted leave out
its own label, so that the network meets inputs like those of other documents; every
CALIBRATE-th document takes no part in fitting the network, and the threshold is set
on those. Labels are of documents, so windows are labelled by multiple-instance
rounds: the worst window of a toxic document is positive, windows of other documents
are negative. The last model is kept by a digest of the rows it was fitted on.

Scoring is one pass without a shuffle; a lost task is run again. Inputs and states are
made for a few segments at a time; of a long text only its words' places, hashes and
two numbers each are held. Texts without words, null ones too, have the share of toxic
ones among those fitted as their score (0.49 at most).
An empty document table gives an empty result. Rows labelled more than once count as
toxic if any label says so; null labels do not count; repeated documents each give a
row, and in fitting one of an id's texts counts. Without labels of both kinds all
scores are 0. Input columns named as an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._spark import append, column, hashed_sample, remainder, tidy

WIDTH, CONTEXT, SPAN, HIDDEN = 24, 12, 96, 8
GRAMS = (4, 5)
#: Rows of the embedding tables of words and of character 4-grams, and their width.
ROWS, DEPTH = 1 << 14, 4
INPUTS = 1 + len(GRAMS) + 1 + 2 * DEPTH
CALIBRATE = 5


def _gram_hashes(flat: np.ndarray, begins: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of the byte n-grams of each word, whose start is marked by one more byte."""
    length = ends - begins
    count = np.maximum(length + 1 - n + 1, 1)
    word = np.repeat(np.arange(len(begins)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    step = np.arange(len(word)) - first[word]
    value = np.full(len(word), n, np.uint64)
    padded = np.concatenate([_text._ASCII_LOWER[flat], np.zeros(8, np.uint8)])
    with np.errstate(over="ignore"):
        for i in range(n):
            at = begins[word] + step + i - 1
            byte = padded[np.maximum(at, 0)].astype(np.uint64)
            byte[(at < begins[word]) | (at >= ends[word])] = 256
            value = value * np.uint64(0x9E3779B97F4A7C15) + byte + np.uint64(1)
    return _text.mix(value), word


class Lookup:
    """Values of sparse 64-bit keys, 0 for others."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.near = np.zeros(1 << 18, bool)
        self.near[self.keys & np.uint64((1 << 18) - 1)] = True

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.float32)
        if len(self.keys):
            maybe = np.flatnonzero(self.near[keys & np.uint64((1 << 18) - 1)])
            k = keys[maybe]
            at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == k, self.values[at], 0)
        return out


class Association:
    """Document frequencies of keys in toxic and other texts; parts yields (keys,
    documents), each document in one part only."""

    def __init__(self, parts, toxic: np.ndarray):
        keys, p, q = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        for own, docs in parts:
            if len(own):
                pairs = np.unique(np.stack([own, docs.astype(np.uint64)], 1), axis=0)
                weight = toxic[pairs[:, 1].astype(np.int64)].astype(float)
                keys, at = np.unique(np.concatenate([keys, pairs[:, 0]]), return_inverse=True)
                p, q = (np.bincount(at, np.concatenate([c, w]), len(keys)) for c, w in ((p, weight), (q, 1 - weight)))
        self.keys, self.p, self.q, self.share = keys, p, q, toxic.sum() / max(1, (1 - toxic).sum())

    def value(self, p, q) -> np.ndarray:
        """Smoothed log ratio; 0 where it is small."""
        out = np.log((p + 1) / (q * self.share + 1))
        return np.where(np.abs(out) > 0.5, np.clip(out, -2, 4), 0).astype(np.float32)

    def lookup(self) -> Lookup:
        found = self.value(self.p, self.q)
        return Lookup(self.keys[found != 0], found[found != 0])

    def without(self, keys: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """Values of keys of fitted documents with these labels, each document's own label left out."""
        at = np.searchsorted(self.keys, keys)
        return self.value(self.p[at] - toxic, self.q[at] - (1 - toxic))


def _table(hashes: np.ndarray) -> np.ndarray:
    """Rows of an embedding table."""
    return (hashes >> np.uint64(40)).astype(np.int64) & (ROWS - 1)


class Words:
    """Inputs of words; tables (words, 4-grams) are learned."""

    def __init__(self, words: Lookup, grams: list[Lookup], seed: int = 5):
        self.words, self.grams = words, grams
        r = np.random.default_rng(seed)
        self.tables = [(0.05 * r.standard_normal((ROWS, DEPTH))).astype(np.float32) for _ in range(2)]

    def embed(self, rows: np.ndarray, grams: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Learned inputs of words, from table rows of the words and of all their grams."""
        first = np.cumsum(count) - count
        own = np.add.reduceat(self.tables[1][grams], first) / count[:, None] if len(count) else np.zeros((0, DEPTH), np.float32)
        return np.concatenate([self.tables[0][rows], own], 1)

    def __call__(self, flat, begins, ends, value) -> np.ndarray:
        x = np.zeros((len(value), INPUTS), np.float32)
        if len(value):
            x[:, 0] = self.words(value)
            for i, (n, lookup) in enumerate(zip(GRAMS, self.grams, strict=True)):
                h, word = _gram_hashes(flat, begins, ends, n)
                x[:, 1 + i] = np.maximum.reduceat(lookup(h), np.flatnonzero(np.diff(word, prepend=-1)))
                if not i:
                    x[:, -2 * DEPTH :] = self.embed(_table(value), _table(h), np.bincount(word, minlength=len(value)))
            x[:, 3] = np.minimum(ends - begins, 20) / 10
        return x


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent cells (one for each direction), attention, a logit."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)

        def w(*shape):
            return (r.standard_normal(shape) * (0.6 / np.sqrt(shape[0]))).astype(np.float32)

        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("W", w(INPUTS, 3 * HIDDEN)), ("U", w(HIDDEN, 3 * HIDDEN)), ("b", np.zeros(3 * HIDDEN, np.float32)))}
        self.p |= {"A": w(2 * HIDDEN, HIDDEN), "v": w(HIDDEN), "w": w(2 * HIDDEN), "c": np.zeros(1, np.float32)}

    def _cell(self, d: str, x: np.ndarray, mask: np.ndarray, keep: list | None):
        """x: (T, B, inputs). Hidden states (T, B, H), in the order of x."""
        W, U, b = self.p["W" + d], self.p["U" + d], self.p["b" + d]
        T, B, _ = x.shape
        entry = (x.reshape(T * B, -1) @ W + b).reshape(T, B, -1)
        h, out = np.zeros((B, HIDDEN), np.float32), np.empty((T, B, HIDDEN), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a, u = entry[t], h @ U
            g = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = g[:, :HIDDEN], g[:, HIDDEN:]
            n = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            m = mask[t][:, None]
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :], m))
            h = np.where(m, new, h)
            out[t] = h
        return out

    def states(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(states, tanh, attention logits) of words; x (T, B, inputs), mask (T, B)."""
        steps = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._cell(d, x, mask, steps[d]) for d in "fb"], 2)
        k = np.tanh(h @ self.p["A"])
        if keep is not None:
            keep.update(x=x, steps=steps, h=h, k=k)
        return h, k, k @ self.p["v"]

    def forward(self, x: np.ndarray, mask: np.ndarray, window: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of sequences, each pooled over its window (T, B)."""
        h, _, e = self.states(x, mask, keep)
        a = np.exp(e) * window  # |e| is at most the sum of |v|
        a = a / np.maximum(a.sum(0), 1e-9)
        c = (a[:, :, None] * h).sum(0)
        if keep is not None:
            keep.update(a=a, c=c)
        return c @ self.p["w"] + self.p["c"][0]

    def words(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weight, weighted evidence) of each word: a window's logit is the ratio of their sums, plus c."""
        h, _, e = self.states(x, mask)
        a = np.exp(e) * mask
        return a, a * (h @ self.p["w"])

    def gradient(self, keep: dict, d_logit: np.ndarray) -> dict:
        p, h, k, a, c = self.p, keep["h"], keep["k"], keep["a"], keep["c"]
        g = {n: np.zeros_like(v) for n, v in p.items()}
        g["x"] = np.zeros_like(keep["x"])
        g["w"], g["c"][0] = c.T @ d_logit, d_logit.sum()
        dc = d_logit[:, None] * p["w"]
        dh = a[:, :, None] * dc
        da = (h * dc).sum(2)
        de = a * (da - (a * da).sum(0))
        g["v"] = np.einsum("tb,tbh->h", de, k)
        dk = de[:, :, None] * p["v"] * (1 - k * k)
        g["A"] = np.einsum("tbi,tbj->ij", h, dk)
        dh = dh + dk @ p["A"].T
        for i, d in enumerate("fb"):
            W, U = p["W" + d], p["U" + d]
            carry = np.zeros_like(h[0, :, :HIDDEN])
            for t, before, z, r, n, un, m in reversed(keep["steps"][d]):
                total = carry + dh[t, :, i * HIDDEN : (i + 1) * HIDDEN]
                new = np.where(m, total, 0)
                dz, dn = new * (before - n), new * (1 - z)
                dan = dn * (1 - n * n)
                dr = dan * un
                daz, dar = dz * z * (1 - z), dr * r * (1 - r)
                d_a = np.concatenate([daz, dar, dan], 1)
                d_u = np.concatenate([daz, dar, dan * r], 1)
                g["W" + d] += keep["x"][t].T @ d_a
                g["b" + d] += d_a.sum(0)
                g["U" + d] += before.T @ d_u
                g["x"][t] += d_a @ W.T
                carry = np.where(m, new * z + d_u @ U.T, total)
        return g



class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.step = rate, {}, {}, 0

    def __call__(self, values: dict, gradients: dict) -> None:
        """Changes the values (arrays) in place."""
        self.step += 1
        for n, d in gradients.items():
            self.m[n] = 0.9 * self.m.get(n, 0) + 0.1 * d
            self.v[n] = 0.99 * self.v.get(n, 0) + 0.01 * d * d
            values[n] -= (self.rate * (self.m[n] / (1 - 0.9**self.step)) / (np.sqrt(self.v[n] / (1 - 0.99**self.step)) + 1e-6)).astype(np.float32)


def sequences(bounds: np.ndarray, starts: np.ndarray, docs: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers (B, T) of spans with CONTEXT on both sides, which are in the text, and which of those are in the span."""
    at = starts[:, None] + np.arange(-CONTEXT, span + CONTEXT)
    mask = (at >= bounds[docs][:, None]) & (at < bounds[docs + 1][:, None])
    window = mask & (at >= starts[:, None]) & (at < starts[:, None] + span)
    return np.where(mask, at, 0), mask, window


def worst(weight: np.ndarray, evidence: np.ndarray, bounds: np.ndarray, some: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """(first word, ratio of sums) of the worst window of each text, over windows of
    WIDTH words at every word of the text; a text without words has the ratio 0. Texts are
    taken in runs of about ``some`` words."""
    parts, at = [(np.zeros(0, np.int64), np.zeros(0))], 0
    while at + 1 < len(bounds):
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + some, "right")) - 1)
        a, b = int(bounds[at]), int(bounds[stop])
        first, best = _worst(weight[a:b], evidence[a:b], bounds[at : stop + 1] - a)
        parts.append((first + a, best))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _worst(weight: np.ndarray, evidence: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(bounds)
    first, best = bounds[:-1].copy(), np.zeros(len(size))
    some = np.flatnonzero(size > 0)
    if len(some):
        count = np.maximum(1, size[some] - WIDTH + 1)
        doc = np.repeat(some, count)
        start = bounds[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        end = np.minimum(start + WIDTH, bounds[doc + 1])
        sums = [np.concatenate([[0.0], np.cumsum(c, dtype=np.float64)]) for c in (weight, evidence)]
        ratio = (sums[1][end] - sums[1][start]) / np.maximum(sums[0][end] - sums[0][start], 1e-30)
        begin = np.cumsum(count) - count
        best[some] = np.maximum.reduceat(ratio, begin)
        at = np.flatnonzero(ratio == np.repeat(best[some], count))
        first[doc[at][::-1]] = start[at][::-1]  # the first of equal ones
    return first, best


class Model:
    #: Segments that are read at once.
    BLOCK = 512

    def __init__(self, words: Words, network: Network, slope: float, shift: float, prior: float = 0.0):
        self.words, self.network, self.slope, self.shift, self.prior = words, network, slope, shift, prior

    def evidence(self, bounds: np.ndarray, inputs) -> tuple[np.ndarray, np.ndarray]:
        """(weight, evidence) of all words; inputs(a, b) gives those of a range of words."""
        size = np.diff(bounds)
        count = -(-size // SPAN)
        docs = np.repeat(np.arange(len(size)), count)
        starts = bounds[docs] + SPAN * (np.arange(len(docs)) - np.repeat(np.cumsum(count) - count, count))
        weight, evidence = (np.zeros(int(bounds[-1]) if len(bounds) else 0, np.float32) for _ in range(2))
        for s in range(0, len(docs), self.BLOCK):
            at, mask, span = sequences(bounds, starts[s : s + self.BLOCK], docs[s : s + self.BLOCK], SPAN)
            low, high = int(at[mask].min()), int(at[mask].max()) + 1
            x = inputs(low, high)[np.where(mask, at - low, 0)] * mask[:, :, None]
            a, e = self.network.words(np.ascontiguousarray(x.transpose(1, 0, 2)), np.ascontiguousarray(mask.T))
            weight[at[span]], evidence[at[span]] = a.T[span], e.T[span]
        return weight, evidence

    def scores(self, flat, offsets) -> np.ndarray:
        """The worst window's logit of each text, calibrated; without words the prior, less than 0.5."""
        begins, ends, value, bounds = _text.words(flat, offsets, _text.WORDISH)
        found = self.evidence(bounds, lambda a, b: self.words(flat, begins[a:b], ends[a:b], value[a:b]))
        logit = worst(*found, bounds)[1] + float(self.network.p["c"][0])
        return np.where(np.diff(bounds) > 0, _sigmoid(self.slope * logit + self.shift), min(self.prior, 0.49))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and shift: 0.5 falls where fewest texts are on the wrong side, midway in the widest gap."""
    order = np.argsort(z)
    s, t = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(t)]) + (1 - t).sum() - np.concatenate([[0], np.cumsum(1 - t)])
    edge = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    width = np.concatenate([[0], np.diff(s), [0]])
    best = np.flatnonzero(wrong == wrong.min())
    cut = edge[best[np.argmax(width[best])]]
    return 1.0, float(-cut)


def train(texts: list[str], toxic: np.ndarray, rounds: int = 2, epochs: int = 6) -> Model | None:
    toxic = np.asarray(toxic, np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return None
    flat, offsets, _ = _text.buffers(pa.array(texts, pa.large_string()))
    begins, ends, value, bounds = _text.words(flat, offsets, _text.WORDISH)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(bounds))
    cuts = [(int(bounds[i]), int(bounds[min(i + 250, len(texts))])) for i in range(0, len(texts), 250)]

    def grams(n: int):
        for a, b in cuts:
            h, word = _gram_hashes(flat, begins[a:b], ends[a:b], n)
            yield h, owner[a:b][word]

    of_words, of_grams = Association(((value[a:b], owner[a:b]) for a, b in cuts), toxic), [Association(grams(n), toxic) for n in GRAMS]
    words = Words(of_words.lookup(), [x.lookup() for x in of_grams])
    fixed = np.zeros((len(value), INPUTS - 2 * DEPTH), np.float32)
    label = toxic[owner].astype(np.int8)
    gram_rows, gram_count = [], []
    for a, b in cuts:
        if a == b:
            continue
        fixed[a:b, 0] = of_words.without(value[a:b], label[a:b])
        for i, (n, found) in enumerate(zip(GRAMS, of_grams, strict=True)):
            h, word = _gram_hashes(flat, begins[a:b], ends[a:b], n)
            fixed[a:b, 1 + i] = np.maximum.reduceat(found.without(h, label[a:b][word]), np.flatnonzero(np.diff(word, prepend=-1)))
            if not i:
                gram_rows.append(_table(h).astype(np.int32))
                gram_count.append(np.bincount(word, minlength=b - a))
    fixed[:, 3] = np.minimum(ends - begins, 20) / 10
    rows = _table(value).astype(np.int32)
    count = np.concatenate([*gram_count, np.zeros(0, np.int64)]).astype(np.int32)
    gram_rows = np.concatenate([*gram_rows, np.zeros(0, np.int32)])
    gram_first = np.cumsum(count, dtype=np.int64) - count

    def own_grams(at: np.ndarray) -> np.ndarray:
        n = count[at]
        return gram_rows[np.repeat(gram_first[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def inputs(at: np.ndarray) -> np.ndarray:
        return np.concatenate([fixed[at], words.embed(rows[at], own_grams(at), count[at])], 1)

    del begins, ends, value, of_words, of_grams
    r = np.random.default_rng(11)
    model = Model(words, Network(), 1.0, 0.0, float(toxic.mean()))
    held = np.arange(len(toxic)) % CALIBRATE == CALIBRATE - 1
    if min(toxic[held].sum(), (1 - toxic[held]).sum()) < 10:
        held[:] = False
    weight = np.where(toxic > 0, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean())).astype(np.float32)
    network, fit_network, fit_tables = model.network, Adam(0.02), Adam(0.005)
    clean = np.flatnonzero((label == 0) & ~held[owner]) if len(owner) else np.zeros(0, np.int64)
    found = np.ones(len(fixed), np.float32), fixed[:, :3].sum(1)
    del label
    for _ in range(rounds):
        first, _ = worst(*found, bounds)
        docs = np.flatnonzero(~held)
        random = np.sort(r.choice(clean, min(3000, len(clean)), replace=False))
        starts, docs = np.concatenate([first[docs], random]), np.concatenate([docs, owner[random]])
        for _ in range(epochs):
            order = r.permutation(len(starts))
            for s in range(0, len(order), 256):
                i = order[s : s + 256]
                at, mask, window = sequences(bounds, starts[i], docs[i], WIDTH)
                x = np.zeros((*at.shape, INPUTS), np.float32)
                x[mask] = inputs(at[mask])
                keep: dict = {}
                logit = network.forward(np.ascontiguousarray(x.transpose(1, 0, 2)), np.ascontiguousarray(mask.T), window.T, keep)
                y = toxic[docs[i]]
                g = network.gradient(keep, (weight[docs[i]] * (_sigmoid(logit) - y) / len(i)).astype(np.float32))
                d = g.pop("x").transpose(1, 0, 2)[mask]
                fit_network(network.p, g)
                n = count[at[mask]]
                to, of, share = rows[at[mask]], own_grams(at[mask]), np.repeat(1 / np.maximum(n, 1), n)
                step = [np.stack([np.bincount(k, w[:, j], ROWS) for j in range(DEPTH)], 1) for k, w in ((to, d[:, -2 * DEPTH : -DEPTH]), (of, np.repeat(d[:, -DEPTH:], n, 0) * share[:, None]))]
                fit_tables(dict(enumerate(words.tables)), dict(enumerate(step)))
        found = model.evidence(bounds, lambda a, b: inputs(np.arange(a, b)))
    z = worst(*found, bounds)[1] + float(network.p["c"][0])
    use = held if held.any() else np.ones(len(toxic), bool)
    model.slope, model.shift = _calibrate(z[use].astype(float), toxic[use])
    del fixed, rows, count, gram_rows, gram_first, found, owner
    tidy()
    return model


_last: dict[str, Model | None] = {}


def fit(docs: DataFrame, labels: DataFrame, *, fit_docs: int = 4000, fit_chars: int = 40_000_000) -> Model | None:
    """A model from at most fit_docs rows of labels (doc_id, toxic), a fixed hash
    sample, and of those the first by hash whose texts have at most fit_chars characters together."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hashed_sample(labels, "doc_id", fit_docs, "toxicity").withColumn("place", F.xxhash64(F.lit("toxicity"), "doc_id"))
    whole = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    sizes = whole.groupBy("doc_id", "place").agg(F.max(F.length("text")).alias("n")).orderBy("place", "doc_id").toPandas()  # a row for each of fit_docs
    most = sizes["place"][sizes["n"].cumsum() <= fit_chars].max() if len(sizes) else None
    if most is None or most != most:
        return None
    rows = whole.where(F.col("place") <= int(most)).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    texts, toxic = rows["text"].tolist(), (rows["toxic"] > 0).to_numpy().astype(int)
    key = xxhash.xxh3_128()
    for t, y in zip(texts, toxic.tolist(), strict=True):
        key.update(f"{y}{len(t)} {t}".encode("utf-8", "surrogatepass"))
    if key.hexdigest() not in _last:
        found = train(texts, toxic)
        _last.clear()
        _last[key.hexdigest()] = found
    return _last[key.hexdigest()]


def score(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5)."""
    if model is None:
        return docs.drop("score", "predicted").withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch):
        s = shared.value.scores(*_text.buffers(column(batch, text))[:2])
        return s, (s >= 0.5).astype(np.int32)

    return append(docs, compute, "score double, predicted int", text)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of contract 8: labels with crc32(doc_id) mod 5 = 0 are held out."""
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text"), model).select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
