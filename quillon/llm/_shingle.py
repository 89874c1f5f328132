"""Vectorised word shingles over Arrow text columns (numpy, no per-row Python)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd multiplier of the prefix polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
#: Words are the maximal runs of bytes other than space and \t..\r.
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix style)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random 64-bit code for each byte value, so that equal sums need equal texts.
CODE = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))


class Powers:
    """Powers of BASE and of its inverse, grown on demand (bounded by the largest batch)."""

    up = np.ones(1, _U)
    down = np.ones(1, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            for name, b in (("up", BASE), ("down", BASE_INV)):
                a = np.full(size, b, _U)
                a[0] = 1
                setattr(cls, name, np.cumprod(a, dtype=_U))
        return cls.up, cls.down


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum over j < i of code(data[j]) * BASE**-j; see span_hash."""
    _, down = Powers.of(len(data) + 1)
    s = np.zeros(len(data) + 1, _U)
    np.take(CODE, data, out=s[1:], mode="clip")
    s[1:] *= down[: len(data)]
    np.cumsum(s[1:], dtype=_U, out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of data[start:end]: equal for equal bytes wherever they stand."""
    up, _ = Powers.of(len(s))
    return (s[end] - s[start]) * up[start]


def all_spans(s: np.ndarray, size: int) -> np.ndarray:
    """span_hash() of every span of so many bytes, in order."""
    up, _ = Powers.of(len(s))
    out = s[size:] - s[: len(s) - size]
    out *= up[: len(out)]
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column laid end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    buf = column.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def shingles(data: np.ndarray, off: np.ndarray, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text, as (hashes sorted within a text, n + 1 offsets).

    A-Z is lower-cased; a text of fewer words gives its whole sequence as one shingle, a text
    without words gives none. Word hashes depend on the words alone, not on the space between.
    """
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    low = _LOWER[data]
    gap = _IS_SPACE[data]
    first = np.ones(len(data), bool)
    first[1:] = gap[:-1]
    first[off[:-1][off[:-1] < len(data)]] = True
    last = np.ones(len(data), bool)
    last[:-1] = gap[1:]
    ends = off[1:] - 1
    last[ends[ends >= 0]] = True
    word = ~gap
    start, end = np.flatnonzero(first & word), np.flatnonzero(last & word) + 1
    if not len(start):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64)
    h = mix(span_hash(prefix_hash(low), start, end) + (end - start).astype(_U) * _U(0xA24BAED4963EE407))
    at = np.searchsorted(start, off)  # words before each text
    count = np.diff(at)
    total = len(h)
    grams = np.zeros(total, _U)
    # A shingle is an ordered sum of its words' hashes; short texts end early.
    doc = np.repeat(np.arange(n), count)
    stop = at[1:][doc]
    p = 1
    for k in range(words):
        idx = np.arange(total) + k
        ok = idx < stop
        np.add(grams, np.where(ok, h[np.minimum(idx, total - 1)] * _U(p), _U(0)), out=grams)
        p = p * BASE & (1 << 64) - 1
    keep = np.arange(total) + words <= stop
    head = at[:-1][count > 0]
    keep[head] = True  # the first word's shingle always counts: it is the whole of a short text
    grams, doc = mix(grams + np.minimum(words, stop - np.arange(total)).astype(_U))[keep], doc[keep]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(n + 1))


def by_bytes(batch: pa.RecordBatch, column: int, limit: int) -> list[pa.RecordBatch]:
    """Slices of a batch whose texts have about `limit` bytes; a longer text stands alone."""
    _, off = utf8(batch.column(column))
    cut = np.flatnonzero(np.diff(off[1:] // limit, prepend=0)) if len(batch) else np.zeros(0, int)
    ends = np.unique(np.concatenate([[0], cut, cut + 1, [len(batch)]]))
    return [batch.slice(a, b - a) for a, b in zip(ends, ends[1:])]
