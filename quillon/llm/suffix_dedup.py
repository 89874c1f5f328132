"""Exact repeats across documents by a sparse, hash-compared suffix sort (operator 7).

A byte goes if a string of `least` bytes covers it that also starts in a document with a smaller
doc_id. Each such window of a document has an anchor: the position of its smallest hashed
q-gram, which equal windows choose alike. Neighbouring windows with one anchor travel together
as one stretch of text, dealt by the anchor's q-gram, so that equal windows meet in a bucket.
Blocks of documents first offer only the hashes of their q-grams and learn which of them other
documents have; the other stretches stay where they are.

In a bucket the stretches' prefix polynomial hashes give the hash of any substring at once, and a
binary search over them the common extension of two suffixes. Stretches that are equal in whole
collapse first. Of the rest, the texts from the anchor on, and those before it read backwards,
are sorted by mergesort with that comparison; neighbours' common extensions, verified on the
bytes, say which windows are equal. What is removed returns to the documents as spans, in blocks of documents.

A stretch that repeats within a block of documents is sent once and its copies are dealt by their
blocks, so of text that very many documents share a bucket gets one copy for each block.

What a block has for a bucket is one piece, so the number of pieces grows with the square of the
data. Blocks and buckets are therefore as large as a worker's memory allows, and are worked off in
chunks and turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import parts, texts_columns, trim
from quillon.llm._shingle import BASE, Powers, all_spans, by_bytes, mix, prefix_hash, span_hash, utf8

_U = np.uint64
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
#: Bytes of text in a chunk, in a block of documents, and for each bucket of stretches; bytes of a
#: bucket's stretches, and windows, that are compared at a time (a group of windows is never split).
#: Each byte in a turn, or looked up by its place, takes dozens of bytes of memory for a while.
BATCH, BLOCK, BUCKET, TURN, WINDOWS = 250_000, 16_000_000, 32_000_000, 500_000, 250_000
#: Bytes of a q-gram, where the strings looked for are three times as long at least.
GRAM = 16


def gram(least: int) -> int:
    return max(1, min(GRAM, least // 3))


def narrow(most: int) -> type:
    """The smallest type of numbers from 0 to most."""
    return next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if most <= np.iinfo(t).max)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block."""
    head = np.array([x for a in arrays for x in (ord(a.dtype.char), len(a))], "<i8")
    return _ZSTD.compress(np.int64(len(arrays)).tobytes() + head.tobytes() + b"".join(a.tobytes() for a in arrays))


def unpacked(block: bytes) -> list[np.ndarray]:
    raw = _UNZSTD.decompress(block)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head, at, out = np.frombuffer(raw, "<i8", 2 * n, 8), 8 + 16 * n, []
    for kind, size in head.reshape(-1, 2):
        a = np.frombuffer(raw, chr(kind), size, at)
        at += a.nbytes
        out.append(a)
    return out


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for size[0] numbers, then from start[1] on, and so forth."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(size.sum())


def _by_size(size: np.ndarray) -> Iterator[slice]:
    """Slices of entries that have about BATCH bytes together."""
    turn = (np.cumsum(size, dtype=np.int64) - size) // BATCH
    edges = np.flatnonzero(np.diff(turn, prepend=-1))
    yield from map(slice, edges, np.append(edges[1:], len(size)))


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start+size] of each entry, laid end to end."""
    out, at = np.empty(int(size.sum()), data.dtype), 0
    for i in _by_size(size):
        part = data[ranges(start[i], size[i])]
        out[at : at + len(part)] = part
        at += len(part)
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a+size] equals data[b:b+size], for each entry."""
    out = np.ones(len(a), bool)
    some = np.flatnonzero(size > 0)
    for part in _by_size(size[some].astype(np.int64)):
        i = some[part]
        n = size[i].astype(np.int64)
        wrong = data[ranges(a[i], n)] != data[ranges(b[i], n)]
        out[i] = ~np.logical_or.reduceat(wrong, np.cumsum(n) - n)
    return out


def stretches(data: np.ndarray, off: np.ndarray, least: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and anchor of the stretches of all texts laid end to end; s is prefix_hash(data)."""
    n, q = len(data), gram(least)
    if n < least:
        return (np.zeros(0, np.int64),) * 3
    bits = _U(max(24, int(n).bit_length()))
    low = (_U(1) << bits) - _U(1)
    m = mix(all_spans(s, q))
    m &= ~low
    m |= np.arange(n - q + 1, dtype=_U)
    span, width = least - q + 1, 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < span:
        m = np.minimum(m[: len(m) - (span - width)], m[span - width :])
    # m's low bits are the anchor of the window that starts here, so equal ones have one anchor.
    size = np.diff(off)
    windows = np.maximum(size - least + 1, 0)
    ok = np.repeat(np.tile([True, False], len(size)), np.stack([windows, size - windows], 1).ravel())[: len(m)]
    first = np.ones(len(m), bool)
    np.not_equal(m[1:], m[:-1], out=first[1:])
    first[off[:-1][off[:-1] < len(m)]] = True
    first &= ok
    start = np.flatnonzero(first)
    stop = (off[:-1] + windows)[np.searchsorted(off, start, "right") - 1]  # of its text's windows
    return start, np.minimum(np.append(start[1:], n), stop) - 1 + least, (m[start] & low).astype(np.int64)


def _pieces(column: pa.Array, least: int) -> Iterator[tuple]:
    """Texts laid end to end as (data, offsets, document numbers, start in the document); a very
    long text comes in pieces that overlap by a window, so that no window is lost."""
    data, off = utf8(column)
    if len(data) <= 2 * BATCH:
        yield data, off, np.arange(len(off) - 1), np.zeros(len(off) - 1, np.int64)
        return
    for i in range(len(off) - 1):
        for at in range(off[i], max(off[i] + 1, off[i + 1] - least + 1), BATCH):
            part = data[at : min(off[i + 1], at + BATCH + least - 1)]
            yield part, np.array([0, len(part)]), np.array([i]), np.array([at - off[i]])


def text_key(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A hash of each text, which tells apart rows that repeat a doc_id."""
    s = prefix_hash(data)
    return mix(span_hash(s, off[:-1], off[1:]) + np.diff(off).astype(_U)).view(np.int64)


def _slices(t: pa.Table) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A table's doc_ids and texts, BATCH bytes at a time, each with its first row's number."""
    at = 0
    for batch in t.select(["doc_id", "text"]).to_batches():
        for b in by_bytes(batch, 1, BATCH):
            yield at, b
            at += len(b)


def _ranks(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Each row's place among the block's distinct doc_ids and texts, by doc_id (-1 for a null one),
    and its doc_id: the same whatever the rows' order."""
    known, ids = t.column("doc_id").is_valid().to_numpy(), t.column("doc_id").fill_null(0).to_numpy()
    order = np.sort(ids)
    again = np.flatnonzero(np.isin(ids, order[1:][order[1:] == order[:-1]]) & known)
    keys = np.zeros(len(ids), np.int64)  # only rows that repeat a doc_id need one
    if len(again):
        keys[again] = np.concatenate([text_key(*utf8(b.column(1))) for _, b in _slices(t.take(pa.array(again)))])
    by = np.lexsort((keys, ids, ~known))
    new = np.zeros(len(by), bool)
    new[1:] = (ids[by][1:] != ids[by][:-1]) | (keys[by][1:] != keys[by][:-1])
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(new)
    return np.where(known, rank, -1), ids


def _chunks(t: pa.Table, least: int) -> Iterator[tuple]:
    """The stretches of a table of documents, chunk by chunk: bytes, their prefix hashes, and each
    one's start, end and anchor in them, row, and place in its document."""
    for base, b in _slices(t):
        known = b.column(0).is_valid().to_numpy(zero_copy_only=False)
        for data, off, number, begins in _pieces(b.column(1), least):
            s = prefix_hash(data)
            start, end, anchor = stretches(data, off, least, s)
            row = np.searchsorted(off, start, "right") - 1
            ok = known[number[row]]
            start, end, anchor, row = (x[ok] for x in (start, end, anchor, row))
            yield data, s, start, end, anchor, base + number[row], begins[row] + start - off[row]


def _grams(s: np.ndarray, anchor: np.ndarray, bits: int, q: int) -> np.ndarray:
    """The anchors' q-grams as hashes of so many bits: other hashes than those that anchors are the
    smallest of, which would crowd the first buckets."""
    return mix(mix(span_hash(s, anchor, anchor + q)) + _U(0x632BE59BD9B4E019)) >> _U(64 - bits)


def _block_grams(t: pa.Table, least: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct q-gram hashes of a block, sorted, and whether several documents have them."""
    found, last = [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    ids = t.column("doc_id").fill_null(0).to_numpy()
    for _, s, _, _, anchor, row, _ in _chunks(t, least):
        found.append(_grams(s, anchor, bits, gram(least)))
        last.append(ids[row])
    g, d = np.concatenate(found), np.concatenate(last)
    by = np.argsort(g)
    g, d = g[by], d[by]
    edges = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, int)
    several = np.minimum.reduceat(d, edges) < np.maximum.reduceat(d, edges) if len(g) else np.zeros(0, bool)
    return g[edges], several


def _bucket(g: np.ndarray, deal: int, bits: int) -> np.ndarray:
    """Each hash's bucket, in the hashes' order."""
    high = g >> _U(bits - 32) if bits > 32 else g << _U(32 - bits)
    return (high * _U(deal) >> _U(32)).astype(np.int64)


def _offer(least: int, bits: int, deal: int):
    """Each block's q-gram hashes, dealt by their size."""

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        g, several = _block_grams(t, least, bits)
        of = _bucket(g, deal, bits)
        at = np.flatnonzero(np.diff(of, prepend=-1))
        out = [(of[a], packed(*_steps(g[a:z]), np.packbits(several[a:z]))) for a, z in zip(at, np.append(at[1:], len(g)))]
        trim()
        return pa.table({"bucket": pa.array([i for i, _ in out], pa.int32()), "block": pa.array([block] * len(out), pa.int32()), "data": pa.array([x for _, x in out], pa.binary())})

    return run


def _steps(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted numbers as the first one and the steps, as narrow as they allow."""
    d = np.diff(g)
    return g[:1], d.astype(narrow(int(d.max(initial=0))))


def _from_steps(first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return np.concatenate([first, first[0] + np.cumsum(steps, dtype=first.dtype)])


def _answer(t: pa.Table) -> pa.Table:
    """Which of each block's hashes other documents have too, as bits in the hashes' order."""
    blocks, grams, bits = t.column("block"), [], []
    for b in t.column("data"):
        first, steps, several = unpacked(b.as_py())
        grams.append(_from_steps(first, steps))
        bits.append(np.unpackbits(several)[: len(grams[-1])])
    g = np.concatenate(grams)
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    shared = (count > 1)[inverse] | np.concatenate(bits).astype(bool)
    parts = np.split(shared, np.cumsum([len(x) for x in grams])[:-1])
    return pa.table({"block": blocks.cast(pa.int32()), "bucket": t.column("bucket").cast(pa.int32()), "data": pa.array([np.packbits(x).tobytes() for x in parts], pa.binary())})


def _cut(least: int, bits: int, deal: int):
    """The stretches of a block whose q-gram other documents have too, dealt by it."""

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        nothing = pa.table({"bucket": pa.array([], pa.int32()), "data": pa.array([], pa.binary())})
        if not t.num_rows:
            return nothing
        block = t.column("block")[0].as_py()
        rank, ids = _ranks(t)
        held, found = [], [np.zeros(0, _U)]
        for data, s, start, end, anchor, row, place in _chunks(t, least):
            size, g = end - start, _grams(s, anchor, bits, gram(least))
            same = mix(span_hash(s, start, end) + size.astype(_U))
            held.append((data, g, same, start.astype(np.int32), size.astype(narrow(2 * least)), (anchor - start).astype(narrow(least)), row.astype(np.int32), place.astype(narrow(int(place.max(initial=0))))))
            found.append(g)
        grams = np.concatenate(found)
        by = np.argsort(grams)
        new = np.append(True, np.diff(grams[by]) != 0)[: len(by)]
        number = np.empty(len(by), np.int32)  # of each stretch's gram, among the distinct ones
        number[by] = np.cumsum(new) - 1
        grams = grams[by[new]]
        shared, of = np.zeros(len(grams), bool), _bucket(grams, deal, bits)
        for i, b in zip(answers.column("bucket").to_pylist(), answers.column("data")):
            a, z = np.searchsorted(of, [i, i + 1])
            shared[a:z] = np.unpackbits(np.frombuffer(b.as_py(), np.uint8))[: z - a]
        parts: list[tuple] = []
        contents: list[np.ndarray] = []
        del found, by, new
        held.reverse()
        at = 0
        while held:
            data, g, same, start, size, anchor, row, place = held.pop()
            use = np.flatnonzero(shared[number[at : at + len(g)]])
            at += len(g)
            g, same, start, size, anchor, row, place = (x[use] for x in (g, same, start, size, anchor, row, place))
            twin = _twins(data, start, size, same, ids[row])
            parts.append((g, row, place, size, anchor, same, twin))
            contents.append(data[ranges(start[~twin].astype(np.int64), size[~twin].astype(np.int64))])
        if not parts:
            return nothing
        g, row, place, size, anchor, same, twin = (np.concatenate(c) for c in zip(*parts))
        del parts
        text = np.concatenate(contents)
        del contents
        length = np.where(twin, 0, size).astype(np.int64)
        begin = np.cumsum(length) - length
        # The chunks of the block hold equal stretches, too.
        rest = np.flatnonzero(~twin)
        twin[rest] = _twins(text, begin[rest], size[rest], same[rest], ids[row[rest]])
        length[twin] = 0
        bucket = np.where(twin, block % deal, _bucket(g, deal, bits))
        del g, same, rest
        by = np.lexsort((rank[row], bucket))
        bucket = bucket[by]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        out = []
        for a, z in zip(edges, np.append(edges[1:], len(by))):
            x = by[a:z]
            numbers = place[x].astype(narrow(int(place[x].max()))), size[x], anchor[x], twin[x]
            out.append(packed(np.full(1, block), *_steps(rank[row[x]]), *_steps(ids[row[x]]), *numbers, gathered(text, begin[x], length[x])))
        trim()
        return pa.table({"bucket": pa.array(bucket[edges], pa.int32()), "data": pa.array(out, pa.binary())})

    return run


def _twins(data: np.ndarray, start: np.ndarray, size: np.ndarray, same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of stretches of data, those whose bytes a stretch of a smaller doc_id has (same: their hashes):
    the smallest doc_id's goes on, later ones' bytes go at once."""
    twin = np.zeros(len(start), bool)
    order = np.sort(same)
    again = np.flatnonzero(np.isin(same, order[1:][order[1:] == order[:-1]]))
    if len(again):
        order = again[np.lexsort((start[again], ids[again], same[again]))]
        head = np.ones(len(order), bool)
        head[1:] = same[order][1:] != same[order][:-1]
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        later = (ids[order] > ids[lead]) & (size[order] == size[lead])
        o, led = order[later], lead[later]
        twin[o[same_bytes(data, start[o], start[led], size[o])]] = True
    return twin


class Suffixes:
    """Suffixes at the places `at`, of `size` characters each, compared by prefix hashes."""

    def __init__(self, data: np.ndarray, s: np.ndarray, at: np.ndarray, size: np.ndarray):
        self.data, self.s, self.at, self.size = data, s, at, size

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes i and j, by binary search."""
        a, b = self.at[i], self.at[j]
        lo, hi = np.zeros(len(a), np.int64), np.minimum(self.size[i], self.size[j])
        s, (up, _) = self.s, Powers.of(len(self.s))
        sa, sb, ua, ub = s[a], s[b], up[a], up[b]
        while len(lo) and (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            eq = (s[a + mid] - sa) * ua == (s[b + mid] - sb) * ub  # span_hash()
            lo, hi = np.where(eq, mid, lo), np.where(eq, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before j; one that j continues does."""
        n = self.extension(i, j)
        a, b = self.size[i], self.size[j]
        at_end = n == np.minimum(a, b)
        last = len(self.data) - 1
        differ = self.data[np.minimum(self.at[i] + n, last)] < self.data[np.minimum(self.at[j] + n, last)]
        return np.where(at_end, np.where(a == b, or_equal, a < b), differ)

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes' order within the (sorted) groups, and each one's verified extension in
        common with the one before it (-1 for a group's first).

        A bottom-up mergesort of all groups at once: an element's place in a merge is its place
        in its own run and the number of the other run's elements before it.
        """
        n = len(self.at)
        order = np.arange(n)
        head = np.searchsorted(group, group, "left")
        tail = np.searchsorted(group, group, "right")
        largest = int((tail - head).max()) if n else 0
        width = 1
        while width < largest:
            todo = np.flatnonzero(tail - head > width)  # groups that are one run already stay
            h, t = head[todo], tail[todo]
            run = (todo - h) // width
            left = run % 2 == 0
            base = h + (run - run % 2) * width
            lo = np.minimum(np.where(left, base + width, base), t)
            hi = np.minimum(lo + width, t)
            first, mine = lo.copy(), order[todo]
            while (open_ := lo < hi).any():
                i = np.flatnonzero(open_)
                mid = (lo[i] + hi[i]) // 2
                before = self.less(order[mid], mine[i], ~left[i])
                lo[i[before]] = mid[before] + 1
                hi[i[~before]] = mid[~before]
            new = order.copy()
            new[base + (todo - h - run * width) + (lo - first)] = order[todo]
            order = new
            width *= 2
        common = np.full(n, -1, np.int64)
        inside = np.flatnonzero(head < np.arange(n))
        i, j = order[inside], order[inside - 1]
        found = self.extension(i, j)
        wrong = np.flatnonzero(~same_bytes(self.data, self.at[i], self.at[j], found))
        for k in wrong:  # a collision of hashes: count the bytes themselves
            x, y = (self.data[self.at[m] : self.at[m] + found[k]] for m in (i[k], j[k]))
            found[k] = int((x != y).argmax())
        common[inside] = found
        return order, common


def repeats(data: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a smaller doc_id has too, of stretches that lie in data: (stretch, from, to) in it."""
    s = prefix_hash(data)
    g = span_hash(s, start + anchor, start + anchor + gram(least))
    order = np.argsort(g, kind="stable")
    edges = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])) if len(order) else np.zeros(0, int)
    shared = np.minimum.reduceat(ids[order], edges) < np.maximum.reduceat(ids[order], edges) if len(order) else np.zeros(0, bool)
    use = np.sort(order[np.repeat(shared, np.diff(np.append(edges, len(order))))])
    # Whole stretches that are equal: all but the smallest document's are repeats.
    same = mix(span_hash(s, start[use], start[use] + size[use]) + size[use].astype(_U))
    o = use[np.lexsort((ids[use], same))]
    same = np.sort(same)
    head = np.ones(len(o), bool)
    head[1:] = same[1:] != same[:-1]
    lead = o[np.maximum.accumulate(np.where(head, np.arange(len(o)), 0))] if len(o) else o
    equal = size[o] == size[lead]
    equal[equal] = same_bytes(data, start[o[equal]], start[lead[equal]], size[o[equal]])
    whole = equal & (ids[o] > ids[lead])
    found = [(o[whole], np.zeros(whole.sum(), np.int64), size[o[whole]])]
    # Equal stretches within one document share their leader's fate.
    follow = equal & (ids[o] == ids[lead]) & (o != lead)
    rest = o[~whole & ~follow]
    rest = rest[np.argsort(g[rest], kind="stable")]
    own = g[rest]
    edges = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    several = np.minimum.reduceat(ids[rest], edges) < np.maximum.reduceat(ids[rest], edges) if len(own) else np.zeros(0, bool)
    rest = rest[np.repeat(several, np.diff(np.append(edges, len(own))))]
    led, followers = lead[follow], o[follow]
    backward = data[::-1].copy()
    sb = prefix_hash(backward)
    count = size[rest] - least + 1
    # Slices of about WINDOWS windows, cut between groups.
    starts = np.flatnonzero(np.append(True, g[rest][1:] != g[rest][:-1])) if len(rest) else np.zeros(0, int)
    turn = (np.cumsum(count) - count)[starts] // WINDOWS if len(rest) else starts
    cuts = starts[np.flatnonzero(np.append(True, turn[1:] != turn[:-1]))] if len(rest) else starts
    for lo, hi in zip(cuts, np.append(cuts[1:], len(rest))):
        x = rest[lo:hi]
        at = start[x] + anchor[x]
        forth = Suffixes(data, s, at, size[x] - anchor[x])
        back = Suffixes(backward, sb, len(data) - at, anchor[x].astype(np.int64))
        k, a, z = _windows(forth, back, count[lo:hi], anchor[x].astype(np.int64), g[x], ids[x], least)
        of = x[k]
        found.append((of, a, z))
        by = np.argsort(of, kind="stable")
        lo, hi = np.searchsorted(of[by], led), np.searchsorted(of[by], led, "right")
        pick = by[ranges(lo, hi - lo)]
        found.append((np.repeat(followers, hi - lo), a[pick], z[pick]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _windows(forth: Suffixes, back: Suffixes, count: np.ndarray, anchor: np.ndarray, gram: np.ndarray, ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that a smaller doc_id has too: (stretch, from, to).

    `forth` are the stretches' texts from their anchors on, `back` those before, read backwards;
    both are sorted within a gram. A window reaches `rel` bytes back and the rest forth; so two
    are equal if no neighbours between them share less, in one order and in the other.
    """
    n = len(count)
    one, two = forth.sorted(gram), back.sorted(gram)
    own = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for rel in range(int(anchor.max(initial=-1)) + 1):
        x = anchor - rel
        use = np.flatnonzero((x >= 0) & (x < count))
        if not len(use):
            continue
        kind = []
        for (order, common), size in ((one, least - rel), (two, rel)):
            k = np.empty(n, np.int64)
            k[order] = np.cumsum(common < size)
            kind.append(k[use])
        key = kind[0] * (n + 1) + kind[1]
        by = np.argsort(key)
        edges = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        smallest = np.repeat(np.minimum.reduceat(ids[use][by], edges), np.diff(np.append(edges, len(by))))
        gone = use[by[ids[use][by] > smallest]]
        found.append((own[gone], x[gone]))
    of, x = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    by = np.lexsort((x, of))
    of, x = of[by], x[by]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1] + 1)
    a = np.flatnonzero(new)
    z = np.append(a[1:], len(of)) - 1 if len(a) else a
    return of[a], x[a], x[z] + least


def _turns(text: np.ndarray, at: np.ndarray, q: int, turns: int) -> np.ndarray:
    """The turn of each stretch: stretches whose anchors, at `at`, have equal q-grams share it."""
    h = np.zeros(len(at), _U)
    for k in range(q if turns > 1 else 0):
        h = h * _U(BASE) + text[at + k].astype(_U)
    return ((mix(h) >> _U(32)) * _U(turns) >> _U(32)).astype(np.int64)


def _reduce(least: int, turn: int):
    def run(t: pa.Table) -> pa.Table:
        got: list[list[np.ndarray]] = [[] for _ in range(7)]
        texts = bytearray()
        for b in t.column("data"):
            block, r, rs, i, more, place, size, anchor, twin, text = unpacked(b.as_py())
            texts += text.data
            # Copies, as a view would keep the whole piece, its text too.
            for out, v in zip(got, (np.repeat(block, len(size)), _from_steps(r, rs), _from_steps(i, more), place.copy(), size.copy(), anchor.copy(), twin.copy())):
                out.append(v)
        columns = []
        while got:
            columns.append(np.concatenate(got.pop(0)))
        blocks, rank, ids, place, size, anchor, twin = columns
        text = np.frombuffer(texts, np.uint8)
        gone = np.flatnonzero(twin)
        spans = [(gone, np.zeros(len(gone), np.int64), size[gone].astype(np.int64))]
        sent = np.flatnonzero(~twin)
        length = size[sent].astype(np.int64)
        begin = np.cumsum(length) - length
        of = _turns(text, begin + anchor[sent], gram(least), -(-len(text) // turn))
        by = np.argsort(of, kind="stable")
        edges = np.flatnonzero(np.diff(of[by], prepend=-1))
        for a, z in zip(edges, np.append(edges[1:], len(by))):
            x = np.sort(by[a:z])
            n, o = length[x], sent[x]
            which, a, z = repeats(gathered(text, begin[x], n), np.cumsum(n) - n, n, anchor[o].astype(np.int64), ids[o], least)
            spans.append((o[which], a, z - a))
        o, a, n = (np.concatenate(v) for v in zip(*spans))
        block, own, at = blocks[o], rank[o], place[o] + a
        by = np.lexsort((at, own, block))
        block, own, at, n = (v[by] for v in (block, own, at, n.astype(narrow(2 * least))))
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        rows = [packed(*_steps(own[a:z]), at[a:z].astype(narrow(int(at[a:z].max()))), n[a:z]) for a, z in zip(edges, np.append(edges[1:], len(by)))]
        trim()
        return pa.table({"block": pa.array(block[edges], pa.int32()), "spans": pa.array(rows, pa.binary())})

    return run


def _keep(texts_too: bool, carried: int):
    def run(t: pa.Table, spans: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        rank, _ = _ranks(t)
        got = [(_from_steps(r, rs), at, n) for r, rs, at, n in (unpacked(b.as_py()) for b in spans.column("spans"))]
        own, at, n = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*got)) if got else (np.zeros(0, np.int64),) * 3
        by = np.argsort(own, kind="stable")
        own, at, n = own[by], at[by], n[by]
        lo, hi = np.searchsorted(own, rank), np.searchsorted(own, rank, "right")
        sizes, removed, runs = ([np.zeros(0, np.int64)] for _ in range(3))
        hashes, left = [], []
        for base, b in _slices(t):
            data, off = utf8(b.column(1))
            mine = slice(base, base + len(b))
            count = hi[mine] - lo[mine]
            k = ranges(lo[mine], count)
            start = np.repeat(off[:-1], count) + at[k]
            change = np.bincount(start, minlength=len(data) + 1) - np.bincount(start + n[k], minlength=len(data) + 1)
            gone = np.cumsum(change[:-1]) > 0
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            first = off[:-1][off[:-1] < len(data)]
            begin[first] = gone[first]
            sizes.append(np.diff(off))
            for out, m in ((removed, gone), (runs, begin)):
                out.append(np.diff(np.concatenate([[0], np.cumsum(m)])[off]))
            for a, z in zip(off, off[1:]):
                kept = data[a:z][~gone[a:z]].tobytes()
                hashes.append(hashlib.sha256(kept).hexdigest())
                if texts_too:
                    left.append(kept.decode("utf-8", "ignore"))
        out = {"doc_id": t.column("doc_id")} | {name: pa.array(np.concatenate(v), pa.int64()) for name, v in (("n_bytes", sizes), ("n_removed", removed), ("n_spans", runs))}
        out["kept_sha256"] = pa.array(hashes, pa.string())
        if texts_too:
            out["kept_text"] = pa.array(left, pa.string())
        trim()
        return pa.table(out | {f"carried_{k}": t.column(f"carried_{k}") for k in range(carried)})

    return run


def remove_repeats(docs: DataFrame, *, least: int = 50, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte covered by a string of `least` bytes that starts in a smaller doc_id too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    remaining bytes), with_text kept_text (without characters that were cut within), and the
    columns of docs named by carry as own_<name>. One row for each input row. A null text is empty; a text shorter than `least` loses nothing; a
    row with a null doc_id neither loses bytes nor takes them from others; rows that repeat a
    doc_id are no smaller than each other. least is 1 at least.
    """
    if least < 1:
        raise ValueError(f"strings of {least} bytes")
    spark = docs.sparkSession
    # By number, as grouped maps take no column with a dot in its name.
    own = [F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(carry)]
    base = docs.select(*texts_columns(docs), *own)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ways, deal = (max(parts(spark), -(-total // each)) for each in (BLOCK, BUCKET))
    bits = min(60, int(total).bit_length() + 12)  # few q-grams share a hash by chance
    base = base.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(ways)).cast("int"))
    offers = base.groupBy("block").applyInArrow(_offer(least, bits, deal), "bucket int, block int, data binary")
    answers = offers.groupBy("bucket").applyInArrow(_answer, "block int, bucket int, data binary")
    sent = base.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_cut(least, bits, deal), "bucket int, data binary")
    spans = sent.groupBy("bucket").applyInArrow(_reduce(least, TURN), "block int, spans binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    schema += "".join(f", carried_{k} {dict(docs.dtypes)[c]}" for k, c in enumerate(carry))
    out = base.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_keep(with_text, len(carry)), schema)
    return out.withColumnsRenamed({f"carried_{k}": f"own_{c}" for k, c in enumerate(carry)})
