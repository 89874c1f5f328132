"""Best-fit packing by length patterns and non-negative least squares (operator 1).

Tokens are counted once, in a pass that keeps a few numbers for each piece. Everything after
that works on the histogram of piece lengths, which has no more entries than a sequence has
tokens: patterns of up to three lengths that fill a sequence exactly are enumerated, their
repeat counts fitted to the histogram by non-negative least squares and rounded to what is
there, and the residual lengths packed best-fit decreasing. The plan then names, for the k-th
piece of each length, its sequence and offset; the plan's size depends on the sequence length
alone, so it is broadcast. Ranks within a length are counted in each partition first, so a
length that a third of all pieces share is no group of any task.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._common import settle, texts, trim
from quillon.llm.bpe import PATTERN, Automaton, Codec, Vocabulary, byte_chars

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def patterns(lengths: np.ndarray, size: int) -> np.ndarray:
    """All multisets of one to three of the given lengths with the sum `size`; 0 fills up rows."""
    have = np.zeros(size + 1, bool)
    have[lengths] = True
    out = [np.array([[size, 0, 0]])] if have[size] else []
    a = lengths[lengths <= size // 2]
    a = a[have[size - a]]
    out.append(np.stack([a, size - a, 0 * a], 1))
    for x in lengths[lengths <= size // 3]:
        b = lengths[(lengths >= x) & (lengths <= (size - x) // 2)]
        b = b[have[size - x - b]]
        out.append(np.stack([np.full(len(b), x), b, size - x - b], 1))
    return np.concatenate(out).astype(np.int64)


def fit(p: np.ndarray, h: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns p that minimise |A x - h|^2, A counting p's lengths.

    Accelerated projected gradient; A is never laid out.
    """
    size = len(h)

    def forward(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(p[:, j], x, size) for j in range(3))
        y[0] = 0
        return y

    def back(y: np.ndarray) -> np.ndarray:
        y = y.copy()
        y[0] = 0
        return y[p[:, 0]] + y[p[:, 1]] + y[p[:, 2]]

    v = np.ones(len(p))
    for _ in range(30):
        w = back(forward(v))
        bound = np.linalg.norm(w)
        v = w / bound
    x = z = np.zeros(len(p))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - back(forward(z) - h) / (1.02 * bound))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        if ((z - new) * (new - x)).sum() > 0:
            s, z = 1.0, new
        else:
            z = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(hist: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, number of such sequences) that hold exactly the pieces of hist."""
    left = np.zeros(size + 1, np.int64)
    for n, c in hist.items():
        left[n] = c
    out: list[tuple[tuple[int, ...], int]] = []
    lengths = np.flatnonzero(left)
    p = patterns(lengths, size) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(p):
        x = fit(p, left.astype(float))
        for i in np.argsort(-x, kind="stable"):
            if (want := round(x[i])) < 1:
                break
            part = [int(v) for v in p[i] if v]
            while want and any(left[v] < want * part.count(v) for v in part):
                want = min(left[v] // part.count(v) for v in part)
            if want:
                np.subtract.at(left, part, want)
                out.append((tuple(part), int(want)))
    # Residuals: best-fit decreasing; bins of one content are handled together.
    free: dict[int, list[list]] = {}
    for n in range(size, 0, -1):
        rest = int(left[n])
        fitting = sorted(f for f in free if f >= n)
        while rest and fitting:
            f = fitting[0]
            group = free[f][-1]
            m = min(rest, group[1])
            group[1] -= m
            if not group[1]:
                free[f].pop()
                if not free[f]:
                    del free[f]
                    fitting.pop(0)
            rest -= m
            g = f - n
            free.setdefault(g, []).append([group[0] + (n,), m])
            if g >= n and g not in fitting:
                fitting = sorted([*fitting, g])
        if rest:
            q = size // n
            full, last = divmod(rest, q)
            for k, m in ((q, full), (last, 1)):
                if k and m:
                    free.setdefault(size - k * n, []).append([(n,) * k, m])
    out += [(tuple(part), m) for groups in free.values() for part, m in groups]
    return out


def slots(packing: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Arrays (length << 44 | first rank, first sequence, offset), sorted: who goes where."""
    used: dict[int, int] = {}
    keys, seqs, offs, seq = [], [], [], 0
    for part, m in packing:
        off = 0
        for n in part:
            keys.append(n << 44 | used.get(n, 0))
            used[n] = used.get(n, 0) + m
            seqs.append(seq)
            offs.append(off)
            off += n
        seq += m
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, seqs, offs))


class Encoder:
    """Token ids of whole texts as little-endian 32-bit numbers."""

    def __init__(self, tokenizer: str):
        import tiktoken

        spec = json.loads(tokenizer)
        to_byte = byte_chars()
        vocab = spec["model"]["vocab"]
        ranks = {bytes(to_byte[c] for c in s): i for s, i in vocab.items()}
        order = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("ids don't follow the merges' order; this vocabulary needs the automaton of quillon.llm.bpe")
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        self.tokenizer, self.codec = tokenizer, None

    def ids(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.coder.encode_to_numpy(text, allowed_special="all"), "<u4")
        except (ValueError, RuntimeError):  # a run of white space beyond its regex engine's stack
            if self.codec is None:
                self.codec = Codec(Automaton(Vocabulary.of(json.loads(self.tokenizer))))
            return np.array(self.codec.encode(text), "<u4")


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, *, size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents, with the partition that made them and their rank there."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(spec.value)
            trim()
        encode, seen, me = _encoders[tokenizer].ids, np.zeros(size + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % size or size
                for k, at in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[at : first if not k else at + size]
                    rank = seen[len(part)]
                    seen[len(part)] += 1
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), me, rank, part.tolist() if with_ids else None))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return texts(docs).mapInArrow(run, PIECE + ", part int, rank long" + ", ids array<long>" * with_ids)


def pack(docs: DataFrame, tokenizer: str, *, size: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Packs all documents into sequences of at most `size` tokens.

    A document is its token ids and then `end`; only longer ones are cut, into pieces of `size`
    tokens, of which the first may be shorter. Returns for each piece doc_id, piece, start,
    length, ids_crc32, sequence_id, offset and, with_ids, the ids. A null or empty text is the
    one token `end`; a row that repeats is packed again; a null doc_id stays null; an empty
    table gives no rows.
    """
    made = settle(pieces(docs, tokenizer, size=size, end=end, with_ids=with_ids))
    each = made.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = each.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    hist = {r.length: r.n for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    where = made.sparkSession.sparkContext.broadcast(slots(plan(hist, size)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, seqs, offs = where.value
        for batch in batches:
            t = pa.Table.from_batches([batch])
            n, rank = (np.asarray(t[c], np.int64) for c in ("length", "rank"))
            want = n << 44 | rank + np.asarray(t["before"], np.int64)
            at = np.searchsorted(keys, want, "right") - 1
            t = t.drop_columns(["rank", "before"]).append_column("sequence_id", pa.array(seqs[at] + want - keys[at])).append_column("offset", pa.array(offs[at]))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
            yield from t.select(names).to_batches()

    joined = made.join(base, ["length", "part"])
    return joined.mapInArrow(place, PIECE + ", sequence_id long, offset long" + ", ids array<long>" * with_ids)
