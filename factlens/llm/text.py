"""Word spans and 64-bit word identities of whole text columns, over Arrow buffers.

A batch of texts is one byte buffer with offsets.  A word's identity is a polynomial
hash over its bytes, read off one running sum over the buffer, so the cost is a few
vector passes over the bytes and no Python object per word.  Identities are 64 bits
wide: two different words share one with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in slices of about this many bytes, so that memory stays level: a slice takes some 60 times its size.
SLICE_BYTES = 1 << 19

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the word (the 64-bit finaliser of murmur3)."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h = h ^ (h >> _S33)
    h = h * _M2
    return h ^ (h >> _S33)


def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * _P)
    if lower:
        v[65:91] = v[97:123]
    return v


_LOWER = _byte_values(True)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For words of letters and digits: ASCII punctuation and space divide, other bytes are part of words.
_PUNCT = np.ones(256, bool)
_PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, _P_INV)):
            x = np.full(n, p, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one array of large strings, null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each starts; one more offset ends the last."""
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) so that each part has about `most` bytes; a longer text stands alone."""
    _, off = buffers(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, texts.slice(at, end - at)
        at = end


def words(texts: pa.Array, punctuation: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(identity of each word, offsets of each text's words), A-Z taken as a-z.

    Words are runs of `[^\\x20\\x09-\\x0D]`, or with `punctuation` runs without ASCII
    punctuation too.
    """
    data, off = buffers(texts)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = ~(_PUNCT if punctuation else _SPACE)[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[:-1][off[:-1] < n]
    before[cut] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    cut = off[1:] - 1
    after[cut[cut >= 0]] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_LOWER[data] * power, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    h = mix(h ^ (end - start).astype(np.uint64) * _M2)
    return h, np.searchsorted(start, off).astype(np.int64)


def shingles(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle identities sorted within each text and distinct, offsets of each text's).

    A text of fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    count = np.diff(off)
    n = len(h)
    doc = np.repeat(np.arange(len(count)), count)
    if n >= k:
        g = mix(h[: n - k + 1] + np.uint64(k))
        for j in range(1, k):
            g = mix(g * _P + h[j : n - k + 1 + j])
        ok = doc[: n - k + 1] == doc[k - 1 :]
        g, d = g[ok], doc[: n - k + 1][ok]
    else:
        g, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for i in np.flatnonzero((count > 0) & (count < k)):
        x = mix(h[off[i] : off[i] + 1] + count[i : i + 1].astype(np.uint64))
        for j in range(1, int(count[i])):
            x = mix(x * _P + h[off[i] + j : off[i] + j + 1])
        g, d = np.append(g, x), np.append(d, i)
    order = np.lexsort((g, d))
    g, d = g[order], d[order]
    if len(g):
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, d = g[first], d[first]
    return g, np.concatenate(([0], np.cumsum(np.bincount(d, minlength=len(count))))).astype(np.int64)


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the segments that the offsets bound; empty segments give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def longs(h: np.ndarray) -> pa.Array:
    """Unsigned identities as Spark's signed longs, bit for bit."""
    return pa.array(np.ascontiguousarray(h).view(np.int64))
