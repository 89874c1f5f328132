"""Approximate nearest neighbours by a forest of hash prefixes (operator 3).

Each tree is a sorted array of long hash strings (signs of random projections). A query descends
in every tree to its longest prefix match, whatever its length, and all trees then ascend
together, a bit of prefix at a time, until they hold candidates enough. How many that is, as a
share of a block, is fitted on a bounded sample so that its recall against brute force reaches
`recall`. Every row is indexed; the true neighbours among all rows lie closer than those within
a sample, so they are found more surely than in the fit. Candidates are ranked by their exact
cosine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._vectors import asked, met, read, usable

TREES, BITS = 128, 31
#: Rows of the sample that the share of candidates is fitted on, and queries among them.
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: Queries that meet a copy of a block.
ASKS = 16_384


class Forest:
    """Of a block of vectors, for each tree their hash strings in order; built once for all queries."""

    def __init__(self, vectors: np.ndarray):
        self.v, self.norm = vectors, np.sqrt((vectors * vectors).sum(1))
        self.planes = np.random.default_rng(7).standard_normal((vectors.shape[1], TREES * BITS)).astype(np.float32)
        keys = self.strings(vectors, self.norm)
        self.order = np.argsort(keys, 1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, 1)

    def strings(self, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """A hash string for each tree and row, as numbers whose leading bits come first."""
        out = np.zeros((TREES, len(v)), np.uint32)
        weights = np.uint32(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint32)
        for at in range(0, len(v), 1024):
            unit = (v[at : at + 1024] / norm[at : at + 1024, None]).astype(np.float32)
            bits = (unit @ self.planes > 0).reshape(-1, TREES, BITS)
            out[:, at : at + 1024] = (bits * weights).sum(2, dtype=np.uint32).T
        return out

    def ascend(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query, the range in each tree at the longest common level with `want` candidates."""
        keys = self.strings(q, np.sqrt((q * q).sum(1)))
        lo, hi = np.zeros(keys.shape, np.int32), np.full(keys.shape, len(self.v), np.int32)
        open_ = np.ones(len(q), bool)
        for level in range(min(BITS, 2 * int(len(self.v)).bit_length()), -1, -1):
            i = np.flatnonzero(open_)
            if not len(i):
                break
            rest = np.uint32(BITS - level)
            low = keys[:, i] >> rest << rest
            for t in range(TREES):
                lo[t, i] = np.searchsorted(self.keys[t], low[t])
                hi[t, i] = np.searchsorted(self.keys[t], low[t] + (np.uint32(1) << rest))
            open_[i] = (hi[:, i] - lo[:, i]).sum(0) < want
        return lo, hi

    def search(self, q: np.ndarray, k: int, share: float, own: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query, places and cosines of its k nearest candidates with other ids than own's."""
        # `share` counts what the trees hold together, in multiples of the block.
        lo, hi = self.ascend(q, max(int(share * len(self.v)), 4 * k))
        out, met_, self.scored = [], np.zeros(len(self.v), bool), 0
        for i, v in enumerate(q):
            met_[:] = False
            for t, (a, b) in enumerate(zip(lo[:, i].tolist(), hi[:, i].tolist())):
                met_[self.order[t, a:b]] = True
            at = np.flatnonzero(met_)
            self.scored += len(at)
            at = at[ids[at] != own[i]]
            score = (self.v[at] * v).sum(1) / (self.norm[at] * np.sqrt((v * v).sum()))
            if len(at) > 4 * k:
                near = score >= np.partition(score, -k)[-k]
                at, score = at[near], score[near]
            best = np.lexsort((ids[at], -score))[:k]
            out.append((at[best], score[best]))
        return out


def fitted(sample: np.ndarray, k: int, recall: float) -> float:
    """The least share (of a few) at which the forest finds enough of the sample's true neighbours."""
    if len(sample) <= 4 * k:
        return float(TREES)
    ids = np.arange(len(sample))
    q = ids[:SAMPLE_QUERIES]
    unit = sample / np.sqrt((sample * sample).sum(1))[:, None]
    near = unit[q] @ unit.T
    near[q, q] = -2
    true = np.argpartition(-near, k, 1)[:, :k]
    forest = Forest(sample)
    for share in (0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.4, 2.0, 4.0, 8.0):
        found = forest.search(sample[q], k, share, q, ids)
        if np.mean([len(np.intersect1d(a, t)) / k for (a, _), t in zip(found, true)]) >= recall:
            return share
    return float(TREES)


def nearest(vectors: DataFrame, *, k: int = 5, every: int = 50, recall: float = 0.95, rows: int = 32_768) -> DataFrame:
    """The k nearest found of each query row (vec_id divisible by `every`), by cosine.

    Returns query_id, rank (from 1; ties to the smaller vec_id), vec_id, score. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do rows without vec_id;
    vectors of another length than the query's don't either. Rows that repeat a vec_id count
    each, but never for a query of that id. An empty table gives no rows.

    The rows are dealt to blocks of `rows`, each with one forest, and every query goes to every
    block; a block is copied only where there are more than ASKS queries.
    """
    base = usable(vectors)
    take = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    size = len(take[0].v) if take else 1
    share = fitted(np.array([r.v for r in take if len(r.v) == size]).reshape(-1, size), k, recall)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, v = read(left, key[2].as_py())
        own, q = read(right, key[2].as_py())
        out = Forest(v).search(q, k, share, own, ids) if len(ids) and len(own) else []
        n = [len(a) for a, _ in out]
        at = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in out)])
        return pa.table({"query_id": np.repeat(own, n) if len(out) else np.zeros(0, np.int64), "vec_id": ids[at] if len(ids) else at, "score": np.concatenate([np.zeros(0), *(s for _, s in out)])})

    found = met(base, asked(base, every), lambda i, m: m, search, "query_id long, vec_id long, score double", rows=rows, asks=ASKS)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
