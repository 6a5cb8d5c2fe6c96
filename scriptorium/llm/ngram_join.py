"""N-gram Jaccard self-join by prefix trees.

Each document is its set of distinct word n-grams (64-bit hashes, whose numeric
order is the order inside a trie). Sets that may reach the threshold are brought
together losslessly, stored in a trie, and joined by traversing it: members below
a node share the overlap found so far, and a subtree goes when that overlap and
the remaining lengths cannot reach what is needed.

Bringing sets together. Two sets that reach the threshold differ in at most k
n-grams, k depending on their size. The hash space is cut into clearly more than k
parts, so all but k of a set's parts hold the same n-grams in both (pigeonhole). A
signature is the hash of the n-grams of one part. Sizes fall in classes a threshold
apart, and a set has signatures for its own class and the next smaller one. Parts
that are empty do not count; a set with too few occupied parts is signed again with
other cuts until it has enough, so no pair is lost.

Prefixes by frequency. A first exchange counts how many sets have each signature.
Only signatures of two sets or more go back to their owners, where a set keeps, in
ascending order of that count, just as many as the pigeonhole needs: those of no
other set come first and are free. A set with enough signatures of its own is out,
and common passages, last in the order, bring together only sets made of little
else. A second exchange groups the kept signatures.

Scale. Equal sets become one class before anything is compared. Signatures travel
packed, as a binary row for each batch and bucket, to buckets whose number follows the
size of the input: with several for each of very many partitions, rows would hold
hardly more than one signature. A task that gathers buckets unpacks one at a time. The
least member of a kept signature's group is its pivot, so a group of n gives n - 1
rows, never all pairs; a group whose members all have the same signature before it in
their lists met there and gives none. Blocks of a pivot
are joined whole if small; large ones are cut by size class and hash into chunks
that all hold the pivot, components are found, and only members outside the block's
largest component are compared with the chunks of near size classes, a chunk of
them with a chunk at a time. Before any text is fetched, members of blocks go that
have no possible partner there: a set's sketch has a parity bit for each of as many
buckets as the set has n-grams, and the bits in which two sketches differ never
outnumber the n-grams in which the sets differ. Node texts are fetched by a
broadcast of ids only up to ``broadcast_ids`` of them (8 bytes each, and a few times
that as a hash table), by a shuffle join beyond. Intermediate tables go to the
shared folder. What stays quadratic: a large block whose members are made of the
same frequent parts and yet not linked, in rows of sketches, by a factor of CHUNK
less than pairs.

Nulls and empty texts have an empty set and are linked with nothing; an empty table
gives an empty one. A null doc_id is linked with nothing. Rows of one doc_id are one
node, whatever their texts. Ties do not arise: components are named by their least
doc_id. Very long texts are one set in one task. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._spark import column, partitions, saved, tidy
from .components import components

DOC, LINK, EQUAL, SHARED, FAMILIES, SIGNATURES, DIGESTS = range(7)
SMALL_BLOCK = 400
CHUNK = 256
ROW_CHARS = 1024
#: Bytes of text whose n-grams are made at once, and n-grams whose signatures are; a set at least.
AT_ONCE = 3 << 16


def sets_of(batch, text: str, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of a record batch."""
    flat, offsets, _ = _text.buffers(column(batch, text))
    _, _, value, bounds = _text.words(flat, offsets, _text.NOT_SPACE)
    grams, out = _text.ngrams(value, n), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(np.array([_text.whole(value[a:b])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


@lru_cache(maxsize=None)
def _class_bounds(percent: int) -> np.ndarray:
    low = [1]
    while low[-1] < 1 << 40:
        low.append(100 * low[-1] // percent + 1)
    return np.array(low, np.int64)


@lru_cache(maxsize=None)
def _cut(percent: int, label: int) -> tuple[int, int]:
    """(most differing n-grams k, number of parts) for a size class."""
    low = _class_bounds(percent)
    top = int(low[label + 1]) - 1
    k = (100 - percent) * (top + 100 * top // percent) // (100 + percent)
    if k == 0:
        return 0, 1
    least = parts = k + 2 + k // 4  # a fourth more than k need agree: counting tells passages from copies
    for _ in range(8):  # room for the parts expected to be empty
        parts = least + int(1.5 * parts * np.exp(-float(low[label]) / parts))
    return k, parts


def signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, set number, family) of all sets, and the families as rows (set
    number, family, spare). A family is one cut of a set, spare the number of its
    signatures beyond those that the pigeonhole needs. Sets are taken in runs of about
    AT_ONCE n-grams."""
    bounds, at, parts = np.cumsum([0, *map(len, sets)]), 0, []
    while at < len(sets) or not parts:
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + AT_ONCE, "right")) - 1)
        value, number, family, families = _signatures(sets[at:stop], percent)
        parts.append((value, number + at, family, families + np.array([at, 0, 0])))
        at = stop
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _class_bounds(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    label0 = np.searchsorted(low, sizes, "right") - 1
    found, families = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))], [np.zeros((0, 3), np.int64)]
    for shift in (0, 1):
        todo = np.flatnonzero((sizes > 0) & (label0 >= shift))
        seed = 0
        while len(todo):
            label = label0[todo] - shift
            cut = np.array([_cut(percent, int(x)) for x in label], np.int64).reshape(-1, 2)
            base = np.concatenate([[0], np.cumsum(cut[:, 1])])
            which = np.repeat(np.arange(len(todo)), sizes[todo])
            tokens = np.concatenate([sets[i] for i in todo])
            with np.errstate(over="ignore"):
                salted = _text.mix(tokens + np.uint64(0x632BE59BD9B4E019) * (label[which].astype(np.uint64) + np.uint64(1)) + np.uint64(seed) * np.uint64(0xD1342543DE82EF95))
                part = base[which] + ((salted >> np.uint64(32)) * cut[which, 1].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                again = _text.mix(salted)
            total = int(base[-1])
            low_sum = np.bincount(part, (again & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
            high_sum = np.bincount(part, (again >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
            full = np.bincount(part, minlength=total) > 0
            owner = np.repeat(np.arange(len(todo)), cut[:, 1])
            number = np.arange(total) - base[owner]
            with np.errstate(over="ignore"):
                value = _text.mix(low_sum + high_sum * np.uint64(0x9E3779B97F4A7C15) + _text.mix((label[owner] * 1_000_003 + seed).astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + number.astype(np.uint64)))
            family = 2 * seed + shift
            found.append((value[full], todo[owner[full]], np.full(int(full.sum()), family)))
            occupied = np.bincount(owner[full], minlength=len(todo))
            families.append(np.stack([todo, np.full(len(todo), family), occupied - cut[:, 0] - 1], 1))
            todo = todo[occupied <= cut[:, 0]]
            seed += 1
            if seed > 64:
                raise RuntimeError("a set could not be cut into enough parts")
    return *(np.concatenate(c) for c in zip(*found, strict=True)), np.concatenate(families)


def digests(sets: list[np.ndarray]) -> np.ndarray:
    """128-bit digests of sets, as rows of two words."""
    out = np.zeros((len(sets), 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, s in enumerate(sets):
            m = _text.mix(s ^ np.uint64(0x94D049BB133111EB))
            out[i] = (m.sum(), (m * (s | np.uint64(1))).sum() + np.uint64(len(s)))
    return out


def sketch(s: np.ndarray) -> bytes:
    """A parity bit for each bucket of n-grams; a power of two of buckets, at least the set's size."""
    bits = 1 << max(6, int(len(s)).bit_length())
    place = (_text.mix(s ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(sketches: list[bytes], size: int) -> np.ndarray:
    """Sketches as rows of ``size`` bytes: buckets that fall together are added by exclusive or."""
    out = np.zeros((len(sketches), size), np.uint8)
    for i, s in enumerate(sketches):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(s, np.uint8).reshape(-1, size), 0)
    return out


def partnered(sizes: np.ndarray, sketches: list[bytes], percent: int, target: np.ndarray | None = None, query: np.ndarray | None = None) -> np.ndarray:
    """Which targets and queries may reach the threshold with another one, by sizes and sketches."""
    every = np.ones(len(sizes), bool)
    target, query = every if target is None else target, every if query is None else query
    out = np.zeros(len(sizes), bool)
    rows = folded(sketches, min(len(s) for s in sketches))
    for i in np.flatnonzero(query).tolist():
        total = sizes + sizes[i]
        near = target & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i])) & (np.bitwise_count(rows ^ rows[i]).sum(1) * (100 + percent) <= (100 - percent) * total)
        near[i] = False
        if near.any():
            out |= near
            out[i] = True
    return out


_OUT = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64()), ("packed", pa.binary())])
_OUT_DDL = "bucket int, kind tinyint, a long, b long, packed binary"


def _rows(bucket, kind, a, b, packed=None) -> pa.RecordBatch:
    n = len(bucket)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(bucket, np.int32)), pa.array(np.full(n, kind, np.int8)), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(packed if packed is not None else [None] * n, pa.binary())], schema=_OUT)


def _planes(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit words with their bytes transposed, so that equal high bytes compress."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns)


def _unplanes(packed: bytes, columns: int) -> list[np.ndarray]:
    n = len(packed) // (8 * columns)
    raw = np.frombuffer(packed, np.uint8).reshape(columns, 8, n)
    return [np.ascontiguousarray(raw[c].T).view(np.uint64).reshape(-1) for c in range(columns)]


#: Number of packed columns of each kind.
_WIDTH = {SHARED: 4, FAMILIES: 4, SIGNATURES: 3, DIGESTS: 3}


def deal(chars: int, partitions: int, bucket_chars: int) -> tuple[int, int]:
    """(buckets, tasks that gather them) for texts of so many characters. A task packs a
    row for each bucket, so buckets are few enough that tasks times buckets stay near a
    row for ROW_CHARS characters, unless more are needed to keep a bucket in memory."""
    buckets = min(1 << 30, max(16, min(4 * partitions, isqrt(chars // ROW_CHARS)), chars // bucket_chars))
    return buckets, max(partitions, buckets // 2)


def _spread(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _home(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    return _spread(_text.mix(ids.view(np.uint64)), buckets)


def _dealt(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Columns of 64-bit words as one packed row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order].view(np.uint64) for c in columns]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(starts[1:], len(bucket))
    packed = [_planes(*(c[s:e] for c in columns)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    del columns, order
    none = [None] * len(packed)
    return _rows(bucket[starts], kind, none, none, packed)


def _emit(batches, doc_id: str, text: str, n: int, percent: int, buckets: int):
    for whole_batch in batches:
        for batch in _text.pieces(whole_batch, text, 1 << 22):
            sets = [s for part in _text.pieces(batch, text, AT_ONCE) for s in sets_of(part, text, n)]
            ids = column(batch, doc_id)
            known = np.asarray(ids.is_valid())
            ids_np = np.asarray(ids.fill_null(0)).astype(np.int64)
            yield _rows(_home(ids_np, buckets), DOC, ids, pa.array([len(s) for s in sets], pa.int64()), [sketch(s) for s in sets])
            first: dict[bytes, int] = {}
            use, link_a, link_b = [], [], []
            digest = digests(sets)
            for i in np.flatnonzero(known).tolist():
                if len(sets[i]):
                    j = first.setdefault(digest[i].tobytes(), i)
                    if j == i:
                        use.append(i)
                    else:
                        link_a.append(ids_np[j])
                        link_b.append(ids_np[i])
            if link_a:
                yield _rows(_home(np.array(link_b), buckets), LINK, link_a, link_b)
            if not use:
                continue
            use = np.array(use)
            owners = ids_np[use]
            sig, number, family, families = signatures([sets[i] for i in use], percent)
            del sets
            yield _dealt(SIGNATURES, _spread(sig, buckets), sig, owners[number], family)
            del sig, number, family
            yield _dealt(DIGESTS, _spread(digest[use, 0], buckets), digest[use, 0], digest[use, 1], owners)
            own = owners[families[:, 0]]
            yield _dealt(FAMILIES, _home(own, buckets), own, np.ascontiguousarray(families[:, 1]), np.ascontiguousarray(families[:, 2]), digest[use, 0][families[:, 0]])
            del families
    tidy()


def _gather(batches, kinds: tuple[int, ...], rest):
    """Packed rows of these kinds by bucket and kind, for _buckets(); rows of others go to rest(batch) one batch at a time."""
    found: dict[int, dict[int, list]] = {}
    for batch in batches:
        kind = np.asarray(batch.column("kind"))
        packed = np.isin(kind, kinds)
        if not packed.all():
            yield from rest(batch.take(pa.array(np.flatnonzero(~packed))))
        of, rows = np.asarray(batch.column("bucket")), batch.column("packed")
        for i in np.flatnonzero(packed).tolist():
            found.setdefault(int(of[i]), {k: [] for k in kinds})[int(kind[i])].append(rows[i].as_buffer())
    return found


def _buckets(found: dict[int, dict[int, list]]):
    """All columns of each kind, a bucket at a time; rows that belong together are in one bucket."""
    while found:
        _, parts = found.popitem()
        yield {k: [np.concatenate(c) for c in zip(*(_unplanes(x, _WIDTH[k]) for x in p), strict=True)] if p else [np.zeros(0, np.uint64)] * _WIDTH[k] for k, p in parts.items()}


def _numbers(*columns: np.ndarray) -> np.ndarray:
    """A number for each different row of the columns, ascending in their order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    for c in columns:
        new[1:] |= np.diff(c[order].view(np.int64)) != 0
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shared(sig: np.ndarray, owner: np.ndarray, family: np.ndarray) -> list[np.ndarray]:
    """(owner, family, signature, count of its owners) where these are two or more."""
    owner = owner.view(np.int64)
    order = np.lexsort((owner, sig))
    sig, owner, family = sig[order], owner[order], family[order]
    start = np.concatenate([[True], sig[1:] != sig[:-1]])
    other = start | np.concatenate([[True], owner[1:] != owner[:-1]])
    group = np.cumsum(start) - 1
    count = np.bincount(group[other])[group]
    two = count > 1
    return [owner[two], family[two], sig[two], count[two]]


def _equal(high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Rows (least owner of a digest, another one)."""
    number, owner = _numbers(high, low), owner.view(np.int64)
    order = np.lexsort((owner, number))
    number, owner = number[order], owner[order]
    start = np.concatenate([[True], number[1:] != number[:-1]])
    least = owner[np.maximum.accumulate(np.where(start, np.arange(len(owner)), 0))]
    return np.unique(np.stack([least, owner], 1)[least != owner], axis=0)


def _meet(batches, buckets: int):
    """Where whole buckets are together: signatures of two sets or more with their
    counts, to their owners, and the least owner of each digest."""
    shared, copies = [], []
    for parts in _buckets((yield from _gather(batches, (SIGNATURES, DIGESTS), lambda plain: [plain]))):
        if len(parts[SIGNATURES][0]):
            shared.append(_shared(*parts.pop(SIGNATURES)))
        if len(parts[DIGESTS][0]):
            copies.append(_equal(*parts.pop(DIGESTS)))
    owner, family, sig, count = (np.concatenate(c) for c in zip(*shared, strict=True)) if shared else [np.zeros(0, np.int64)] * 4
    del shared
    if len(owner):
        yield _dealt(SHARED, _home(owner, buckets), owner, family, sig, count)
    copy = np.concatenate([np.zeros((0, 2), np.int64), *copies])
    if len(copy):
        yield _rows(_home(np.ascontiguousarray(copy[:, 1]), buckets), EQUAL, copy[:, 0], copy[:, 1])
    tidy()


def _kept(shared: list[np.ndarray], families: list[np.ndarray], copies: np.ndarray) -> list[np.ndarray]:
    """(signature, owner, the one before it) of the signatures that owners keep."""
    owner, family, sig, count = shared
    of, kind, spare, tag = families
    m = len(owner)
    sets = np.unique(np.stack([of, tag], 1), axis=0)[:, 0]
    several = sets[1:][sets[1:] == sets[:-1]]  # owners of different texts keep all
    single = ~np.isin(owner, several)
    here = ~(single & np.isin(owner, copies))
    number = _numbers(np.concatenate([owner, of]), np.concatenate([family, kind]))
    spares = np.zeros(int(number.max()) + 1, np.int64)
    spares[number[m:]] = spare.view(np.int64)
    number = number[:m]
    order = np.lexsort((sig, count, number))
    order = order[np.concatenate([[True], (np.diff(number[order]) != 0) | (sig[order][1:] != sig[order][:-1])])]  # rows repeated in other batches
    number, sig, owner, single, here = number[order], sig[order], owner[order], single[order], here[order]
    start = np.concatenate([[True], number[1:] != number[:-1]])
    place = np.arange(len(number)) - np.maximum.accumulate(np.where(start, np.arange(len(number)), 0))
    total = np.bincount(number)[number]
    keep = here & (~single | (place < total - spares[number]))
    before = np.where(start | ~single, np.uint64(0), np.concatenate([[np.uint64(0)], sig[:-1]]))
    return [sig[keep], owner[keep], before[keep]]


def _prefix(batches, buckets: int):
    """Where all of an owner is together: the kept signatures of each family, in
    ascending order of count, each with the one before it in that list."""
    copies, kept = [np.zeros(0, np.int64)], []

    def rest(batch):
        copies.append(np.asarray(batch.column("b")))
        return ()

    found = yield from _gather(batches, (SHARED, FAMILIES), rest)
    copies = np.concatenate(copies).view(np.uint64)
    for parts in _buckets(found):
        if len(parts[SHARED][0]):
            kept.append(_kept(parts.pop(SHARED), parts.pop(FAMILIES), copies))
    sig, owner, before = (np.concatenate(c) for c in zip(*kept, strict=True)) if kept else [np.zeros(0, np.uint64)] * 3
    if len(sig):
        yield _dealt(SIGNATURES, _spread(sig, buckets), sig, owner, before)
    tidy()


def _met(sig: np.ndarray, owner: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Rows (least owner of a signature, another one)."""
    owner = owner.view(np.int64)
    order = np.lexsort((before, owner, sig))
    sig, owner, before = sig[order], owner[order], before[order]
    start = np.concatenate([[True], sig[1:] != sig[:-1]])
    group = np.cumsum(start) - 1
    first = np.flatnonzero(start)[group]
    new = (before == 0) | (before != before[first])
    differ = (owner != owner[first]) & (np.bincount(group, new)[group] > 0)
    return np.unique(np.stack([owner[first], owner], 1)[differ], axis=0)


def _pair(batches):
    """(p, node): the least owner of each kept signature with each other one, unless
    all of them met at the signature before it."""
    found = yield from _gather(batches, (SIGNATURES,), lambda plain: ())
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *(_met(*parts[SIGNATURES]) for parts in _buckets(found))]), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["p", "node"])
    tidy()


class Trie:
    """A compressed prefix tree of sorted sets."""

    __slots__ = ("edge", "end", "shortest", "longest", "children", "item")

    def __init__(self, sets: list[np.ndarray], order: list[int], depth: int = 0):
        sizes = [len(sets[i]) for i in order]
        self.shortest, self.longest, self.item, self.children = min(sizes), max(sizes), -1, []
        first, last = sets[order[0]], sets[order[-1]]
        m = min(len(first), len(last))
        if len(order) == 1:
            stop = m
            self.item = order[0]
        else:
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            stop = depth + int(differ[0]) if len(differ) else m
        self.edge, self.end = first[depth:stop], stop
        if len(order) > 1:
            at = 0
            while at < len(order):
                s = sets[order[at]]
                to = at + 1
                if len(s) > stop:
                    while to < len(order) and sets[order[to]][stop] == s[stop]:
                        to += 1
                self.children.append(Trie(sets, order[at:to], stop))
                at = to

    @staticmethod
    def of(sets: list[np.ndarray]) -> Trie | None:
        order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())
        return Trie(sets, order) if order else None

    def search(self, query: np.ndarray, percent: int, skip):
        """Items whose Jaccard similarity with the query is at least percent / 100.
        skip(item): whether an item need not be looked at."""
        n, stack = len(query), [(self, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if node.item >= 0 and skip(node.item):
                continue
            if 100 * min(n, node.longest) < percent * max(n, node.shortest):
                continue
            need = -(-percent * (n + node.shortest) // (100 + percent))
            if overlap + min(n - at, node.longest - node.end + len(node.edge)) < need:
                continue
            if len(node.edge):
                place = np.searchsorted(query[at:], node.edge) + at
                inside = place < n
                overlap += int((query[place[inside]] == node.edge[inside]).sum())
                at = int(np.searchsorted(query, node.edge[-1], "right"))
            if overlap + min(n - at, node.longest - node.end) < need:
                continue
            if node.item >= 0:
                if 100 * overlap >= percent * (n + node.longest - overlap):
                    yield node.item
            else:
                stack.extend((c, overlap, at) for c in node.children)


def link_block(targets: list[tuple[int, np.ndarray]], queries: list[tuple[int, np.ndarray]], percent: int, root: dict[int, int]) -> list[tuple[int, int]]:
    """Links that join the components of queries and targets; root holds known components."""
    sets = [s for _, s in targets]
    trie = Trie.of(sets)

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root.setdefault(root[x], root[x])
            x = root[x]
        return x

    out = []
    for node, query in queries if trie and len(sets) else ():
        for i in trie.search(query, percent, lambda i, node=node: find(targets[i][0]) == find(node)):
            a, b = find(node), find(targets[i][0])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((node, targets[i][0]))
    return out


def _blocks(batches, n: int, percent: int):
    """Rows sorted by (p, chunk, other): members of one block follow each other."""
    key, rows = None, []

    def done():
        targets = [(r[0], r[1]) for r in rows if r[3]]
        queries = [(r[0], r[1]) for r in rows if r[4]]
        root = {}
        for node, _, label, *_ in rows:
            if label is not None and label != node:
                root[node] = label
        return link_block(targets, queries, percent, root)

    for whole_batch in batches:
        for batch in _text.pieces(whole_batch, "text"):
            sets = sets_of(batch, "text", n)
            links = []
            for i, (p, chunk, other, node, label, target, query) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("p", "chunk", "other", "node", "label", "target", "query")), strict=True)):
                if (p, chunk, other) != key:
                    if rows:
                        links += done()
                    key, rows = (p, chunk, other), []
                rows.append((node, sets[i], label, target, query))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])
    links = done() if rows else []
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["u", "v"])
    tidy()


_BLOCK = ("p", "chunk", "other", "node", "label", "target", "query")
_BLOCK_DDL = "p long, chunk int, other int, node long, label long, target boolean, query boolean"


def _prune(batches, percent: int):
    """Rows sorted by block: the members of each block that have a possible partner in it."""
    key, rows = None, []

    def done():
        if len({r[3] for r in rows}) < 2:
            return []
        ok = partnered(np.array([r[7] for r in rows], np.int64), [r[8] for r in rows], percent, np.array([r[5] for r in rows]), np.array([r[6] for r in rows]))
        return list(dict.fromkeys(r[:7] for r, y in zip(rows, ok.tolist(), strict=True) if y))

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()), strict=True)], names=list(_BLOCK))

    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in (*_BLOCK, "n_shingles", "sketch")), strict=True):
            if row[:3] != key:
                out += done() if rows else []
                key, rows = row[:3], []
            rows.append(row)
        yield table(out)
    yield table(done() if rows else [])
    tidy()


def _joined(blocks: DataFrame, sketches: DataFrame, docs: DataFrame, n: int, percent: int, broadcast_ids: int) -> DataFrame:
    """Links (u, v) inside blocks (columns _BLOCK): members by sketches, then the tries of their texts."""
    by = ("p", "chunk", "other")
    rows = blocks.join(sketches, "node").repartition(partitions(docs), *by).sortWithinPartitions(*by, "node")
    blocks = saved(rows.select(*_BLOCK, "n_shingles", "sketch").mapInArrow(lambda batches: _prune(batches, percent), _BLOCK_DDL))
    nodes = blocks.select("node").distinct()
    few = nodes.limit(broadcast_ids + 1).count() <= broadcast_ids
    texts = docs.withColumnRenamed("doc_id", "node").join(F.broadcast(nodes) if few else nodes, "node", "left_semi").distinct()
    rows = blocks.join(texts, "node").repartition(4 * partitions(docs), *by).sortWithinPartitions(*by, "node")
    return rows.mapInArrow(lambda batches: _blocks(batches, n, percent), "u long, v long")


def link(docs: DataFrame, *, n: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", bucket_chars: int = 1 << 22, broadcast_ids: int = 200_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs, by its links. A percent
    under 65 would allow more differences than small sets have n-grams, and is an error."""
    if not 65 <= percent <= 100:
        raise ValueError("percent must be from 65 to 100")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets, dealt = deal(int(chars), partitions(docs), bucket_chars)
    packed = docs.mapInArrow(lambda batches: _emit(batches, "doc_id", "text", n, percent, buckets), _OUT_DDL)
    met = saved(packed.repartition(dealt, "bucket").mapInArrow(lambda batches: _meet(batches, buckets), _OUT_DDL))

    shingles = met.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"))
    equal = met.where(F.col("kind").isin(LINK, EQUAL)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    sketches = met.where(F.col("kind") == DOC).select(F.col("a").alias("node"), F.col("b").alias("n_shingles"), F.col("packed").alias("sketch"))
    kept = met.where(F.col("kind").isin(SHARED, FAMILIES, EQUAL)).repartition(dealt, "bucket").mapInArrow(lambda batches: _prefix(batches, buckets), _OUT_DDL)
    pairs = saved(kept.repartition(dealt, "bucket").mapInArrow(_pair, "p long, node long").distinct())

    sizes = saved(pairs.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") > SMALL_BLOCK))
    large = bool(sizes.limit(1).count())
    few = sizes.limit(broadcast_ids + 1).count() <= broadcast_ids
    sizes = F.broadcast(sizes) if few else sizes
    zero, yes, no = F.lit(0), F.lit(True), F.lit(False)
    label = F.lit(None).cast("long").alias("label")
    small = pairs.join(sizes, "p", "left_anti").select("p", "node") if large else pairs
    small = small.union(small.select("p", F.col("p").alias("node")).distinct())
    blocks = small.select("p", zero.alias("chunk"), zero.alias("other"), "node", label, yes.alias("target"), yes.alias("query"))
    if not large:
        return _named(shingles, components(_joined(blocks, sketches, docs, n, percent, broadcast_ids).union(equal)))

    # Members of linked sets are at most a size class apart.
    size_class = F.floor(F.log("n_shingles") / F.log(F.lit(max(100 / percent, 1.001) * 1.0001))).cast("int")
    members = pairs.join(sizes, "p").select("p", "node").join(sketches.select("node", "n_shingles").distinct(), "node").select("p", "node", size_class.alias("class")).distinct()
    counts = members.groupBy("p", "class").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    counts = counts.withColumn("base", F.sum("chunks").over(Window.partitionBy("p").orderBy("class")) - F.col("chunks"))
    members = saved(members.join(counts, ["p", "class"]).select("p", "node", "class", (F.col("base") + F.pmod(F.xxhash64("node"), F.col("chunks"))).cast("int").alias("chunk")))
    pivots = members.select("p", "chunk").distinct().withColumn("node", F.col("p"))
    whole = members.select("p", "chunk", "node").union(pivots.select("p", "chunk", "node"))
    blocks = blocks.union(whole.select("p", "chunk", F.lit(-1), "node", label, yes, yes))
    links = saved(_joined(blocks, sketches, docs, n, percent, broadcast_ids).union(equal))

    labels = saved(components(links))
    members = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    most = members.groupBy("p", "label").agg(F.count("*").alias("c")).groupBy("p").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    members = saved(members.join(most, "p"))
    asking = members.where("label <> main")
    to = members.groupBy("p", "class", "chunk").agg(F.lit(1).alias("one")).select("p", "class", "chunk")
    of = asking.groupBy("p", "class", "chunk").agg(F.lit(1).alias("one")).select("p", F.explode(F.array(F.col("class") - 1, "class", F.col("class") + 1)).alias("class"), F.col("chunk").alias("other"))
    met_chunks = to.join(of, ["p", "class"]).select("p", "chunk", "other")
    both = members.join(met_chunks, ["p", "chunk"]).select("p", "chunk", "other", "node", "label", yes, no)
    both = both.union(asking.withColumnRenamed("chunk", "other").join(met_chunks, ["p", "other"]).select("p", "chunk", "other", "node", "label", no, yes)).toDF(*_BLOCK)
    more = _joined(both, sketches, docs, n, percent, broadcast_ids)
    return _named(shingles, components(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)))


def _named(shingles: DataFrame, found: DataFrame) -> DataFrame:
    found = found.withColumnRenamed("node", "doc_id")
    return shingles.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
