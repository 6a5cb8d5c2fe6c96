"""Main text of web pages by nearest-URL page differencing.

Every page is cut into text lines (one for each block of markup). The pages of a
host are put in the order of their URL paths; each page is compared with the
neighbour, before or after it, whose path has the longest common beginning. Their
lines are aligned by a longest common subsequence (lines that markup rules out take no
part, and lines inside a content container are aligned with such lines), and lines that
both have in common are boilerplate and go. A neighbour that has all of a page's plain lines is
a copy and tells nothing; the other one takes its place.

Markup is the second evidence. Inside the page's own content container (article or
main) pages may carry copies of one article or share passages, so lines there stay
though a neighbour has them. With ``inside`` differencing decides there too, with more
care: only what the neighbours on both sides have in common with the page goes, only at
the container's beginning and end, where templates are, and only if such lines are fewer
than half of the container's, as a copied article is more than half repeated. Menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles go by their markup also where
no neighbour has the same words there.

The global order of URLs is made without one large window: range partitioning,
positions within partitions, and offsets of partitions (a number for each, a table
of as many rows); neighbours meet in blocks of BLOCK positions whose edge rows are
given to both blocks. Only line hashes travel for that; whole pages are shuffled
once, to meet their decisions by a 128-bit key.

Null or empty html gives empty text, an empty table an empty one. A page without a
host is compared with none. Repeated rows are one page for comparison and each give
a row. The order of pages with equal URLs is by page_id and content, so ties are
fixed. Very long pages take memory in proportion to their lines. Other columns are
not read, so their names cannot clash.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import append, column, partitions, saved

BLOCK = 4096
#: Elements that end a line and begin another. Fixed values of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is not text of a page. Fixed values.
RAW = frozenset("script style template textarea title iframe noembed noframes xmp svg object canvas select button".split())
#: Elements that hold boilerplate. Fixed values.
OUTSIDE = frozenset("nav header footer aside form menu dialog head search".split())
CONTAINERS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end is implied where another of the row begins, up to their list or table. Fixed values of the HTML standard.
IMPLIED = {name: (frozenset(row.split()), frozenset(upto.split())) for row, upto in (("li", "ul ol menu dir"), ("dt dd", "dl"), ("td th", "tr table"), ("tr", "tbody thead tfoot table"), ("tbody thead tfoot", "table"), ("option", "")) for name in row.split()}
#: Words in class, id or role that mark boilerplate, and words that may stand beside them in one name. Fixed values.
HINT = re.compile(r"ads?|advert\w*|banners?|sponsor\w*|promo\w*|nav\w*|menus?|breadcrumbs?|sidebars?|side|widgets?|footer|header|masthead|cookies?|consent|notices?|notifications?|alerts?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommend\w*|comments?|replies|reply|respond|disqus|pagination|pager|complementary|contentinfo|search")
BESIDE = frozenset("reader user visitor site page global main top bottom left right upper lower inner outer primary secondary box bar buttons button posts post articles stories links link list items item section block container wrapper wrap area slot unit panel col column thread form content icons media row group holder placeholder module text inline sticky fixed mobile desktop".split())
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(?:!|\?)[^>]*(?:>|$)|<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|$)|(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WHITE = re.compile(r"\s+")


def hinted(value: str) -> bool:
    """Whether a name in a class, id or role attribute is made of boilerplate words
    (``ad``, ``reader-comments``), not merely with one (``side-effects``)."""
    for name in value.lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x]
        hints = [bool(HINT.fullmatch(x)) for x in parts]
        if any(hints) and all(h or x in BESIDE or x.isdigit() for h, x in zip(hints, parts, strict=True)):
            return True
    return False


def lines(source: str | None) -> list[tuple[str, int]]:
    """(text, zone) of each line; zone 2 is inside the content container, 1 is plain,
    0 is boilerplate by its markup. White space is folded and lines are not empty."""
    out: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements that matter, with the zone outside them
    zone, at, n = 1, 0, len(source or "")

    def end() -> None:
        if held:
            text = WHITE.sub(" ", _html.unescape("".join(held))).strip()
            if text:
                out.append((text, zone))
            held.clear()

    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            held.append(source[at:])
            break
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        name = (name or "").lower()
        if not name:
            continue
        if closing:
            if name in BLOCKS:
                end()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        zone = stack[i][1]
                        del stack[i:]
                        break
            continue
        if name in RAW:
            if not attributes.rstrip().endswith("/") or name in ("script", "style"):
                if name == "title":
                    end()
                close = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else n
                held.append(" ")
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            end()
            if name in VOID:
                continue
            if stack and stack[-1][0] == "p":  # an open p ends where another block begins
                zone = stack.pop()[1]
            row, upto = IMPLIED.get(name, ((), ()))
            for i in range(len(stack) - 1, -1, -1) if row else ():
                if stack[i][0] in upto:
                    break
                if stack[i][0] in row:
                    zone = stack[i][1]
                    del stack[i:]
                    break
            inner, names = zone, [(a[1].lower(), (a[2] or "").strip("\"'")) for a in ATTRIBUTE.finditer(attributes)]
            if name in OUTSIDE and not (zone == 2 and (name == "header" or name == "aside" and any("quote" in v.lower() for _, v in names))):
                inner = 0  # but an article's own header has its title, and a pull quote is its text
            elif zone and name not in ("body", "html") and any(k == "hidden" or k == "aria-hidden" and v == "true" or hinted(v) for k, v in names):
                inner = 0
            if inner and name in CONTAINERS:
                inner = 2
            stack.append((name, zone))
            zone = inner
    end()
    return out


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which entries of a are in a longest common subsequence of a and b.

    Equal beginnings and ends are taken first; between them only entries of both
    sides take part. Where few pairs of entries are equal, the longest ascending
    chain of pairs is taken; else two rows of the classic table at a time, halving a
    (Hirschberg). Memory follows the lengths, not their product."""
    n, m = len(a), len(b)
    out = np.zeros(n, bool)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out[:head] = True
    out[n - tail :] = tail > 0
    left = head + np.flatnonzero(np.isin(a[head : n - tail], b[head : m - tail]))
    right = b[head : m - tail]
    right = right[np.isin(right, a[head : n - tail])]
    if len(left) and len(right):
        _, number = np.unique(np.concatenate([a[left], right]), return_inverse=True)
        x, y = number[: len(left)], number[len(left) :]
        pairs = int((np.bincount(x, minlength=len(number)) * np.bincount(y, minlength=len(number))).sum())
        out[left[_chain(x, y) if pairs <= 8 * (len(x) + len(y)) else _halves(x, y)]] = True
    return out


def _chain(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence: the longest ascending chain of equal pairs."""
    places: dict[int, list[int]] = {}
    for j, v in enumerate(y.tolist()):
        places.setdefault(v, []).append(j)
    tops, ends, back, own = [], [], [], []
    for i, v in enumerate(x.tolist()):
        for j in reversed(places.get(v, ())):
            k = bisect_left(tops, j)
            back.append(ends[k - 1] if k else -1)
            own.append(i)
            if k == len(tops):
                tops.append(j)
                ends.append(len(own) - 1)
            else:
                tops[k], ends[k] = j, len(own) - 1
    out, at = [], ends[-1] if ends else -1
    while at >= 0:
        out.append(own[at])
        at = back[at]
    return out[::-1]


def _row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of x and every beginning of y."""
    row = np.zeros(len(y) + 1, np.int32)
    for v in x.tolist():
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == v, row[:-1] + 1, 0)))
    return row


def _halves(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Places in x of a longest common subsequence, by Hirschberg's halving of x."""
    out, todo = [], [(0, len(x), 0, len(y))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        if j - i == 1:
            if (y[k:m] == x[i]).any():
                out.append(i)
            continue
        mid = (i + j) // 2
        cut = k + int(np.argmax(_row(x[i:mid], y[k:m]) + _row(x[mid:j][::-1], y[k:m][::-1])[::-1]))
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return out


def keep(zones: np.ndarray, shared: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Which lines are the article's, from their zones, what the nearest neighbour
    shares, and what the neighbours on both sides share (for lines in a container)."""
    inside = np.flatnonzero(zones == 2)
    own = np.flatnonzero(~both[inside])
    out = (zones == 1) & ~shared
    if 2 * len(own) > len(inside):  # else a copied article
        out[inside[own[0] : own[-1] + 1]] = True
    else:
        out[inside] = True
    return out


def _hashes(batch) -> list[list]:
    found = [[(t, z) for t, z in lines(source) if z] for source in column(batch, "html").to_pylist()]
    return [[[xxhash.xxh3_64_intdigest(t, seed=z) - (1 << 63) for t, z in own] for own in found], [[i for i, (_, z) in enumerate(own) if z == 1] for own in found]]


def _place(batches):
    from pyspark import TaskContext

    at, part = 0, TaskContext.get().partitionId()
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))], names=[*batch.schema.names, "part", "place"])
        at += n


def _beginning(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def _decide(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            hits = []
            own = np.array(r["hashes"], np.int64)
            for other in (r["before"], r["after"]):
                if other is not None and r["host"] and other["host"] == r["host"]:
                    hit = common(own, np.array(other["hashes"], np.int64))
                    copy = bool(r["plain"]) and bool(hit[r["plain"]].all())
                    hits.append((copy, -_beginning(r["path"], other["path"]), len(hits), hit))
            if hits:
                copy, _, _, hit = min(hits)
                if copy:
                    hit = hit.copy()
                    hit[r["plain"]] = False
                both = hits[0][3] & hits[1][3] if len(hits) == 2 else np.zeros(len(own), bool)
                out.append((r["uid"], r["uid2"], np.flatnonzero(hit).tolist(), np.flatnonzero(both).tolist()))
        columns = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())), strict=True)], names=["uid", "uid2", "shared", "both"])


def shared_lines(pages: DataFrame) -> DataFrame:
    """(uid, uid2, shared, both): positions of the lines that a page has in common
    with its nearest neighbour, and with the neighbours on both sides."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[?#].*$", "")
    narrow = append(pages.withColumns({"host": host, "path": path}), _hashes, "hashes array<long>, plain array<int>").select("uid", "uid2", "host", "path", "page_id", "hashes", "plain").dropDuplicates(["uid", "uid2"])
    by = ("host", "path", "page_id", "uid", "uid2")
    placed = saved(narrow.repartitionByRange(partitions(pages), *by).sortWithinPartitions(*by).mapInArrow(_place, "uid long, uid2 long, host string, path string, page_id long, hashes array<long>, plain array<int>, part int, place long"))
    offset, total = [], 0
    for part, k in sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        offset.append((part, total))
        total += k
    offsets = F.broadcast(pages.sparkSession.createDataFrame(offset, "part int, offset long"))
    rank = placed.join(offsets, "part").withColumn("rank", F.col("place") + F.col("offset")).drop("part", "place", "page_id", "offset")
    block = F.expr(f"rank div {BLOCK}")
    edge = F.pmod("rank", F.lit(BLOCK))
    at = F.when(edge == 0, F.array(block, block - 1)).when(edge == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))
    spread = rank.withColumn("block", F.explode(at))
    w = Window.partitionBy("block").orderBy("rank")
    other = F.struct("host", "path", "hashes")
    met = spread.withColumns({"before": F.lag(other).over(w), "after": F.lead(other).over(w)}).where(F.col("block") == block)
    return met.select("uid", "uid2", "host", "path", "hashes", "plain", "before", "after").mapInArrow(_decide, "uid long, uid2 long, shared array<int>, both array<int>")


def _texts(batch) -> tuple[list[str], list[int]]:
    texts = []
    for source, *found in zip(*(column(batch, c).to_pylist() for c in ("html", "shared", "both")), strict=True):
        own = [(t, z) for t, z in lines(source) if z]
        shared, both = np.zeros((2, len(own)), bool)
        shared[found[0] or []] = True
        both[found[1] or []] = True
        kept = keep(np.array([z for _, z in own], np.int8), shared, both)
        texts.append("\n\n".join(own[i][0] for i in np.flatnonzero(kept)))
    return texts, [len(t) for t in texts]


def extract(pages: DataFrame, *, inside: bool = False) -> DataFrame:
    """pages (page_id, url, html) as (page_id, url, text, n_chars). inside: whether
    templates are also looked for inside content containers."""
    whole = (F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    rows = pages.select("page_id", "url", F.col("html")).withColumns({"uid": F.xxhash64(*whole), "uid2": F.xxhash64(F.lit(2), *whole)})
    decisions = shared_lines(rows.withColumn("page_id", F.col("page_id").cast("long")))
    if not inside:
        decisions = decisions.withColumn("both", F.array().cast("array<int>"))
    return append(rows.join(decisions, ["uid", "uid2"], "left"), _texts, "text string, n_chars long").select("page_id", "url", "text", "n_chars")
