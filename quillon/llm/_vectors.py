"""Blocks of vectors as compressed rows, and their meeting with blocks of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import parts
from quillon.llm.suffix_dedup import packed, unpacked


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): without null, empty or zero vectors, null or non-finite components, null ids."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(fine)


def gathered(rows: DataFrame, key: str, make: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(key, data): the rows (vec_id, v, key) of a partition in one block for each key and size of
    vector; make turns the vectors, laid out as a matrix, into what the block carries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            ids, keys = np.array(t["vec_id"], np.int64), np.array(t[key], np.int64)
            size = np.array([len(x) for x in t["v"]])
            ks, ds, out = [], [], []
            for n in np.unique(size):
                m = np.array([x for x, s in zip(t["v"], size) if s == n], np.float64)
                k, i = keys[size == n], ids[size == n]
                made = make(i, m)
                for x in np.unique(k):
                    ks.append(x)
                    ds.append(n)
                    out.append(packed(i[k == x], made[k == x].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ds, pa.int32()), pa.array(out, pa.binary())], names=[key, "size", "data"])

    return rows.mapInArrow(run, f"{key} int, size int, data binary")


def read(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    got = [unpacked(b.as_py()) for b in t.column("data")]
    ids = np.concatenate([np.zeros(0, np.int64), *(g[0] for g in got)])
    rows = [g[1].reshape(-1, width) for g in got]
    data = np.concatenate(rows) if rows else np.zeros((0, width))
    order = np.argsort(ids, kind="stable")
    return ids[order], data[order]


#: Rows of a block at least, where there are cores for more blocks.
LEAST_ROWS = 4096


def met(base: DataFrame, queries: DataFrame, make, search, schema: str, *, rows: int, asks: int) -> DataFrame:
    """search(base, queries) of each block of base rows with each block of `asks` queries.

    A base block has `rows` rows at most, fewer where that keeps all cores busy. The base is copied
    once for each block of queries: once, but for very many; the queries, far fewer, once for each
    base block.
    """
    spark = base.sparkSession
    n, q = base.count(), queries.count()
    nb = max(1, -(-n // rows), min(parts(spark), -(-n // LEAST_ROWS)))
    nq = max(1, -(-q // asks))
    dealt = lambda df, name, k: gathered(df.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(k)).cast("int")), name, make)
    left = dealt(base, "bb", nb).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = dealt(queries, "qb", nq).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    keys = ["bb", "qb", "size"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, schema)


def asked(base: DataFrame, every: int) -> DataFrame:
    """The query rows: vec_id divisible by `every`; of rows that repeat an id the least vector."""
    return base.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
