"""Exact top-k search over binary codes by incremental multi-index hashing (operator 4).

A code is the signs of a vector's components. Codes fall into segments, each with a table from
segment value to codes. A query searches the tables within growing radii, one segment at a time:
once segments 0..s have been searched within r and the others within r - 1, every code within
m * r + s has been met, since any other differs by more in each segment. The search ends when k
verified codes lie within that distance.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm._vectors import asked, met, read, usable

_U = np.uint64
BITS = 64


def codes(ids: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Bit i of a row's code says whether component i is positive."""
    return ((m > 0).astype(_U) << np.arange(m.shape[1], dtype=_U)).sum(1, dtype=_U)


class MultiIndex:
    def __init__(self, code: np.ndarray, ids: np.ndarray):
        """ids ascending; equal codes are one entry."""
        self.code, first, inverse, self.count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        self.ids = ids[np.argsort(inverse, kind="stable")]
        self.begin = np.cumsum(self.count) - self.count
        n = len(self.code)
        self.m = max(1, min(16, round(BITS / max(1.0, np.log2(max(n, 2))))))
        edges = np.linspace(0, BITS, self.m + 1).astype(int)
        self.cuts = list(zip(edges[:-1], np.diff(edges)))
        self.tables = []
        for at, width in self.cuts:
            v = self._segment(self.code, at, width)
            order = np.argsort(v, kind="stable")
            self.tables.append((order, v[order]))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def _segment(code, at: int, width: int):
        return code >> _U(at) & _U((1 << int(width)) - 1)

    def _within(self, width: int, r: int) -> np.ndarray:
        """The masks of exactly r bits."""
        if (width, r) not in self.masks:
            self.masks[width, r] = np.array([sum(1 << b for b in c) for c in combinations(range(width), r)], _U)
        return self.masks[width, r]

    def search(self, q: int, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest entries of other ids than own, ties to smaller ids."""
        n, q = len(self.code), _U(q)
        met_, seen = [], np.zeros(n, bool)
        within = np.zeros(BITS + 1, np.int64)  # ids at each distance
        covered, r = -1, 0
        while covered < BITS:
            for s, (at, width) in enumerate(self.cuts):
                if r > width:
                    covered = max(covered, self.m * r + s)
                    continue
                masks = self._within(int(width), r)
                if len(masks) >= n:  # as many probes as codes: meet the rest at once
                    new, covered = np.flatnonzero(~seen), BITS
                else:
                    order, v = self.tables[s]
                    keys = self._segment(q, at, width) ^ masks
                    lo, hi = np.searchsorted(v, keys), np.searchsorted(v, keys, "right")
                    hit = hi > lo
                    lo, size = lo[hit], (hi - lo)[hit]
                    new = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
                    new, covered = new[~seen[new]], min(BITS, self.m * r + s)
                seen[new] = True
                far = np.bitwise_count(self.code[new] ^ q)
                met_.append((new, far))
                within += np.bincount(far, self.count[new], BITS + 1).astype(np.int64)
                if within[: covered + 1].sum() > k or covered == BITS:  # one may be the query's own
                    break
            else:
                r += 1
                continue
            break
        at, far = (np.concatenate(c) for c in zip(*met_))
        bound = np.searchsorted(np.cumsum(within), k + 1)
        at, far = at[far <= bound], far[far <= bound].astype(np.int64)
        size = np.minimum(self.count[at], k + 1)  # of equal codes the smallest ids are enough
        places = np.repeat(self.begin[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        ids, far = self.ids[places], np.repeat(far, size)
        ids, far = ids[ids != own], far[ids != own]
        best = np.lexsort((ids, far))[:k]
        return ids[best], far[best]


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, rows: int = 1 << 20) -> DataFrame:
    """The k nearest codes of each query row (vec_id divisible by `every`), by Hamming distance.

    Returns query_id, rank (from 1; ties to the smaller vec_id), vec_id, distance; exact. Codes
    come from vectors of 64 components; others, null or zero vectors, and those with null or
    non-finite components take no part, nor do rows without vec_id. Rows that repeat a vec_id
    count each, but never for a query of that id. An empty table gives no rows.
    """
    base = usable(vectors).where(F.size("v") == BITS)

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, code = read(left, 1)
        own, q = read(right, 1)
        index = MultiIndex(code[:, 0].astype(_U), ids) if len(ids) else None
        out = [index.search(c, o, _most(k, ids, o)) for o, c in zip(own, q[:, 0])] if index else []
        n = [len(a) for a, _ in out]
        empty = np.zeros(0, np.int64)
        return pa.table({"query_id": np.repeat(own, n) if out else empty, "vec_id": np.concatenate([empty, *(a for a, _ in out)]), "distance": np.concatenate([empty, *(d for _, d in out)])})

    found = met(base, asked(base, every), codes, search, "query_id long, vec_id long, distance long", rows=rows, asks=1 << 20)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def _most(k: int, ids: np.ndarray, own: int) -> int:
    """k, and as many more as rows that repeat the query's id could take up."""
    a, b = np.searchsorted(ids, [own, own + 1])
    return k + max(0, int(b - a) - 1)


def top_k_sql(k: int = 5, every: int = 50) -> str:
    """The same in DuckDB SQL, by comparing each query with all rows."""
    return f"""WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE len(embedding) = {BITS}),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(len(list_filter(list_zip(q.bits, c.bits), lambda x: x[1] <> x[2])) AS BIGINT) AS distance
      FROM c AS q, c WHERE q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= {k}"""
