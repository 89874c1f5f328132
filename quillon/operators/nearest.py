"""Exact nearest neighbours by cosine: all pairs as matrices, of which only the best leave a block."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values in a block of rows, and of queries; rows and queries in one; scores held at once.
VALUES, ROWS, ASKS, SCORES = 4 << 20, 16_384, 8192, 4 << 20
#: Farther than the scores of a matrix product lie from sums in order.
ERROR = 1e-10


def half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """What SQL's round(x, digits) gives, times 10**digits, to compare by; NaN is above all numbers.

    SQL rounds the shortest decimal that names x, so values beside a half are rounded as that.
    """
    flat = np.abs(np.ravel(x))
    scaled = flat * 10.0**digits
    out = np.floor(scaled + 0.5)
    with np.errstate(invalid="ignore"):
        beside = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) <= 1e-6 + scaled * 1e-15)
    for i in beside:
        out[i] = float(Decimal(repr(float(flat[i]))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.where(np.isnan(x), np.inf, np.copysign(out.reshape(np.shape(x)), x))


def first_of_groups(k: int, group: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """Places of the k first of each group, by ascending order."""
    at = np.lexsort((*order[::-1], group))
    if not len(at):
        return at
    new = np.flatnonzero(np.r_[True, group[at][1:] != group[at][:-1]])
    return at[np.arange(len(at)) - np.repeat(new, np.diff(np.r_[new, len(at)])) < k]


def whole(v: Column) -> Column:
    """v in double precision, null if any component is."""
    v = v.cast("array<double>")
    return F.when(F.forall(v, lambda x: x.isNotNull()), v)


class Matrix:
    """Vectors as a matrix, each with its size and norm (of a sum in order, as SQL has it)."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.size = np.asarray(lists.value_lengths().fill_null(0), np.int64)
        self.data = np.zeros((len(lists), max(1, self.size.max(initial=0))))
        self.data[np.arange(self.data.shape[1]) < self.size[:, None]] = np.asarray(lists.flatten())
        self.norm = np.sqrt(in_order(self.data, self.data))
        self.dead = ~((self.norm > 0) | np.isnan(self.norm))
        with np.errstate(invalid="ignore"):
            self.unit = self.data / np.where(self.dead, 1.0, self.norm)[:, None]


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    with np.errstate(invalid="ignore"):
        for j in range(min(a.shape[1], b.shape[1])):
            total += a[:, j] * b[:, j]
    return total


def scores_of(q: Matrix, v: Matrix, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The cosines of pairs as functions.vectors.cosine has them: 0 where a norm is or a component is missing; of
    vectors of two sizes none (-inf here)."""
    out = np.empty(len(i))
    step = max(1, SCORES // 4 // q.data.shape[1])
    for lo in range(0, len(i), step):
        x, y = i[lo : lo + step], j[lo : lo + step]
        with np.errstate(invalid="ignore", divide="ignore"):
            got = in_order(q.data[x], v.data[y]) / (q.norm[x] * v.norm[y])
        got[q.size[x] != v.size[y]] = -np.inf
        got[q.dead[x] | v.dead[y]] = 0.0
        out[lo : lo + step] = got
    return out


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 6, by: str | None = None) -> DataFrame:
    """For each query the k rows with other ids nearest by cosine, and more; the final choice is the caller's.

    rows are (vec_id, v, others), queries (query_id, q, others); out come all columns but vectors,
    and `score`. With `by`, the k values of that column with the nearest rows, each with its nearest
    row. Order is by the score rounded to `digits`, then by vec_id, or by `by`.

    All pairs are scored: rows in blocks meet queries in blocks by an equi-join, and a task holds a
    block of each and a part of their scores. Scores near the best are then summed in order, so
    results equal those of sums in SQL. What leaves a pair of blocks is k rows for a query.
    """
    spark = rows.sparkSession
    v = rows.where("vec_id IS NOT NULL").withColumn("v", whole(F.col("v")))
    q = queries.where("query_id IS NOT NULL").withColumn("q", whole(F.col("q")))
    n, width = v.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    asks = q.count()
    most = max(1, VALUES // max(1, width))
    nb = max(-(-n // min(ROWS, most)), min(4 * spark.sparkContext.defaultParallelism, -(-n // 1024)), 1)
    nq = max(1, -(-asks // min(ASKS, most)))
    deal = lambda df, key, name, many: df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(many)).cast("int"))
    copy = lambda df, name, many: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    mine, theirs = [c for c in queries.columns if c != "q"], [c for c in rows.columns if c != "v"]
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *rows.schema)}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*mine, *theirs)) + ", score double"

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        v, q = Matrix(left["v"]), Matrix(right["q"])
        ids, asked = np.asarray(left["vec_id"]), np.asarray(right["query_id"])
        codes = pd.factorize(left[by].to_pandas(), sort=True)[0] if by else np.arange(len(ids))
        at = np.argsort(codes, kind="stable")
        starts = np.flatnonzero(np.r_[True, codes[at][1:] != codes[at][:-1]]) if len(at) else at
        sizes = np.diff(np.r_[starts, len(at)])
        label = np.repeat(np.arange(len(starts)), sizes)
        by_id = np.argsort(ids[at], kind="stable")
        sorted_ids = ids[at][by_id]
        width = min(v.data.shape[1], q.data.shape[1])
        unit, wide = np.ascontiguousarray(v.unit[at, :width].T), not by
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, SCORES // max(1, len(ids)))
        for lo in range(0, len(asked) if len(at) else 0, step):
            part = np.arange(lo, min(len(asked), lo + step))
            with np.errstate(invalid="ignore"):
                s = q.unit[part, :width] @ unit
            s[np.isnan(s)] = np.inf
            if (q.size[part][:, None] != v.size[at]).any():
                s[q.size[part][:, None] != v.size[at]] = -4.0
            s[q.dead[part]] = 0.0
            s[:, v.dead[at]] = 0.0
            a, b = np.searchsorted(sorted_ids, asked[part]), np.searchsorted(sorted_ids, asked[part], "right")
            for i in np.flatnonzero(b > a):
                s[i, by_id[a[i] : b[i]]] = -np.inf
            top = s if wide else np.maximum.reduceat(s, starts, axis=1)
            least = np.partition(top, top.shape[1] - k, axis=1)[:, top.shape[1] - k] if top.shape[1] > k else np.full(len(part), -8.0)
            near = s >= least[:, None] - 10.0**-digits - ERROR
            if not wide:
                near &= s >= top[:, label] - ERROR
            near &= s > -np.inf
            i, j = np.nonzero(near)
            score = scores_of(q, v, part[i], at[j])
            if not wide:
                keep = first_of_groups(1, i * len(starts) + label[j], -score, ids[at[j]])
                i, j, score = i[keep], j[keep], score[keep]
            keep = first_of_groups(k, i, -half_up(score, digits), label[j] if by else ids[at[j]])
            found.append((part[i[keep]], at[j[keep]], score[keep]))
        i, j, score = (np.concatenate([f[x] for f in found]) if found else np.zeros(0, np.int64) for x in range(3))
        columns = [right[c].take(pa.array(i, pa.int64())) for c in mine] + [left[c].take(pa.array(j, pa.int64())) for c in theirs]
        return pa.table([*columns, pa.array(score, pa.float64(), mask=np.isneginf(score))], names=[*mine, *theirs, "score"])

    met = copy(deal(v, "vec_id", "bb", nb), "qb", nq).groupBy("bb", "qb").cogroup(copy(deal(q, "query_id", "qb", nq), "bb", nb).groupBy("bb", "qb"))
    return met.applyInArrow(search, schema)
