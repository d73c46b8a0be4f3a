"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and other non-ASCII characters, lower-cased.  Windows
of `seed` words are named by a running Karp-Rabin hash; a document and an item that share
one are a candidate pair.  Tiling then marks the longest match of unmarked words, and
again, until no match of `seed` words is left.  Marked words over an item's words is the
coverage, so that an item whose passages stand in another order is still found.  Windows
that share a hash are compared word by word.  A pair with very many common windows, as
repeated words give, is tiled by length instead, in memory linear in both texts.

An item of fewer words than `seed` is one window: it is found where all of it stands.

The benchmark is the stated query set: it is read in blocks of at most `block_words`
words, and each block is one pass over all documents with a bounded index.

Defined results: items without words match nothing, and neither do null and empty texts.
Repeated items and documents are reported each.  Ties between tiles go to the first
position in the item, then in the document.  `clean` goes by items of at least `seed`
words, as a few common words are no leak.  Columns other than item_id, doc_id and text are
not read by `leaks`, and pass through `clean`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .text import plain, slices, words

SEED = 5
COVERAGE = 0.8
BLOCK_WORDS = 1_000_000
#: Common windows of a pair up to this number are listed at once.
MOST_WINDOWS = 1 << 20
_B = np.uint64(0xD1342543DE82EF95)


def karp_rabin(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k words: sum of h[i + j] * B**(k - 1 - j), kept running by one step a word."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = out * _B + h[j : len(h) - k + 1 + j]
    return out


def _same(item: np.ndarray, doc: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Whether n words from i on and from j on are the same."""
    ok = np.ones(len(i), bool)
    for k in range(n):
        ok &= item[i + k] == doc[j + k]
    return ok


def tiles(item: np.ndarray, doc: np.ndarray, seed: int, most: int = MOST_WINDOWS) -> list[tuple[int, int, int]]:
    """Greedy tiles (item position, document position, length), longest first; ties by positions.

    Matches are taken from common windows, run out as far as the words agree, and kept in
    a queue by length; one that meets marked words is cut down to its unmarked runs.
    """
    a, b = karp_rabin(item, seed), karp_rabin(doc, seed)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    count = hi - lo
    if count.sum() > most:
        return tiles_by_length(item, doc, seed)
    i = np.repeat(np.arange(len(a)), count)
    j = order[np.repeat(lo - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())] if count.sum() else np.zeros(0, np.int64)
    ok = _same(item, doc, i, j, seed)
    i, j = i[ok], j[ok]
    # windows next to each other on one diagonal are one match
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (np.diff(j - i) != 0) | (np.diff(i) != 1)
    at = np.flatnonzero(new)
    queue = [(-(n + seed - 1), int(i[s]), int(j[s])) for s, n in zip(at, np.diff(np.append(at, len(i))), strict=True)]
    queue = [(int(n), x, y) for n, x, y in queue]
    heapq.heapify(queue)
    own, other = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out = []
    while queue:
        n, x, y = heapq.heappop(queue)
        n = -n
        taken = own[x : x + n] | other[y : y + n]
        if not taken.any():
            own[x : x + n] = True
            other[y : y + n] = True
            out.append((x, y, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for s, e in zip(edge[::2], edge[1::2], strict=True):
            if e - s >= seed:
                heapq.heappush(queue, (-int(e - s), x + int(s), y + int(s)))
    return out


class Windows:
    """Hashes of all windows of a text, of any one length, off a running sum."""

    def __init__(self, h: np.ndarray, last: int) -> None:
        power = np.full(last + 1, _B, np.uint64)
        power[0] = 1
        self.h, self.last, self.power = h, last, np.multiply.accumulate(power)
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * self.power[: len(h)])))

    def open(self, n: int, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of n words without a marked one, brought to one power."""
        free = np.concatenate(([0], np.cumsum(marked)))
        at = np.flatnonzero(free[n:] == free[: len(free) - n]) if n <= len(self.h) else np.zeros(0, np.int64)
        return at, (self.sum[at + n] - self.sum[at]) * self.power[self.last - at]


def tiles_by_length(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same tiles, found by the greatest length that still matches, then the next: memory is linear, and so are the steps of a length."""
    a, b = (Windows(x, max(len(item), len(doc))) for x in (item, doc))
    own, other = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    out: list[tuple[int, int, int]] = []

    def common(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and hashes of both sides' windows of n words that the other side has too."""
        (i, g), (j, h) = a.open(n, own), b.open(n, other)
        x, y = np.isin(g, h), np.isin(h, g)
        return i[x], g[x], j[y], h[y]

    top = min(len(item), len(doc))
    while top >= seed:
        # a longer match holds shorter ones, so the greatest length is found by halving
        low, high = seed - 1, top
        while low < high:
            mid = (low + high + 1) // 2
            if len(common(mid)[0]):
                low = mid
            else:
                high = mid - 1
        if low < seed:
            break
        i, g, j, h = common(low)
        order = np.argsort(h, kind="stable")
        j, h = j[order], h[order]
        # each hash's document positions in order; marked ones never come back
        at, end = (dict(zip(g.tolist(), np.searchsorted(h, g, side).tolist(), strict=True)) for side in ("left", "right"))
        for x, key in zip(i.tolist(), g.tolist(), strict=True):
            if own[x : x + low].any():
                continue
            k = at[key]
            while k < end[key] and other[j[k] : j[k] + low].any():
                k += 1
            at[key] = k
            while k < end[key]:
                y = int(j[k])
                if not other[y : y + low].any() and (item[x : x + low] == doc[y : y + low]).all():
                    own[x : x + low] = True
                    other[y : y + low] = True
                    out.append((x, y, low))
                    break
                k += 1
        top = low - 1
    return out


class Block:
    """Items of one pass: their words, and a sorted table from windows to items; items shorter than a seed are a window each."""

    def __init__(self, rows: list[tuple[int, str]], seed: int) -> None:
        self.seed, self.ids = seed, [r[0] for r in rows]
        h, off = words(pc.utf8_lower(plain(pa.array([r[1] for r in rows], pa.string()))), True)
        self.items = np.split(h, off[1:-1])
        self.tables = {}
        for n in sorted({min(len(x), seed) for x in self.items} - {0}):
            keys = [np.unique(karp_rabin(x, n)) if min(len(x), seed) == n else np.zeros(0, np.uint64) for x in self.items]
            key, item = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            order = np.argsort(key, kind="stable")
            self.tables[n] = key[order], item[order]

    def _pairs(self, h: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
        """Distinct (row, item) that share a window of n words."""
        key, item = self.tables[n]
        g = karp_rabin(h, n)
        lo = np.searchsorted(key, g)
        hit = lo < len(key)
        hit[hit] = key[lo[hit]] == g[hit]
        at = np.flatnonzero(hit)
        row = np.searchsorted(off, at, "right") - 1
        inside = at + n <= off[row + 1]
        # a window that a text repeats counts once
        row, lo = np.unique(np.stack((row[inside], lo[at[inside]])), axis=1) if inside.any() else np.zeros((2, 0), np.int64)
        many = np.searchsorted(key, key[lo], "right") - lo
        if not len(row):
            return np.zeros((2, 0), np.int64)
        return np.unique(np.stack((np.repeat(row, many), item[np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())])), axis=1)

    def matches(self, texts: pa.Array, short: bool = True) -> Iterator[tuple[int, int, int]]:
        """(row, item, marked words of the item) for every pair that shares a window."""
        h, off = words(pc.utf8_lower(texts), True)
        for n in self.tables:
            if n < self.seed and not short:
                continue
            for r, x in self._pairs(h, off, n).T.tolist():
                yield r, x, sum(t[2] for t in tiles(self.items[x], h[off[r] : off[r + 1]], n))


def blocks(benchmark: DataFrame, seed: int = SEED, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in parts of at most about `block_words` words; one part is held at a time."""
    rows, n = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        rows.append((r[0], r[1] or ""))
        n += len(rows[-1][1].split())
        if n >= block_words:
            yield Block(rows, seed)
            rows, n = [], 0
    if rows:
        yield Block(rows, seed)


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_marked, coverage) for each pair with at least that coverage."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, n_words long, n_marked long, coverage double"
    scratch = Scratch(docs.sparkSession, "leaks")
    out = None
    for k, block in enumerate(blocks(benchmark, seed, block_words)):

        def work(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for first, part in slices(plain(b.column(1))):
                    got = [(r, x, n) for r, x, n in block.matches(part) if n >= coverage * len(block.items[x])]
                    ids = b.column(0).slice(first, len(part)).take(pa.array([x[0] for x in got], pa.int64()))
                    size = [len(block.items[x[1]]) for x in got]
                    yield pa.record_batch([ids, pa.array([block.ids[x[1]] for x in got], pa.int64()), pa.array(size, pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array([x[2] / s for x, s in zip(got, size, strict=True)], pa.float64())], ["doc_id", "item_id", "n_words", "n_marked", "coverage"])

        found = rows.mapInArrow(work, schema)
        if out is not None or k:
            found = scratch.write(found, f"block-{k}")
        out = found if out is None else out.union(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """`docs` without the documents that cover an item; a pass over the rows a block, no shuffle."""
    at = docs.columns.index("text")
    scratch = Scratch(docs.sparkSession, "clean")
    for k, block in enumerate(blocks(benchmark, seed, block_words)):

        def work(batches: Iterator[pa.RecordBatch], block: Block = block) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, part in slices(plain(b.column(at))):
                    for r, x, n in block.matches(part, short=False):
                        keep[first + r] &= n < coverage * len(block.items[x])
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(work, docs.schema) if not k else scratch.write(docs, f"pass-{k}").mapInArrow(work, docs.schema)
    return docs


def op8(spark, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
