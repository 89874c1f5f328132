"""Connected components by contracting edges within partitions and jumping to parents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import settle

#: Edges that are contracted in a partition at a time.
EDGES = 200_000


def _hash(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, int(r.h or 0)


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: each node but the smallest it reaches, with that one."""
    got = list(batches)
    if not sum(len(b) for b in got):
        return
    u, v = (pa.chunked_array([b.column(k) for b in got]) for k in (0, 1))
    coded = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    names = coded.dictionary.take(order)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    code = rank[coded.indices.to_numpy()]
    a, b = code[: len(u)], code[len(u) :]
    label = np.arange(len(names))
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not (label == (up := label[label])).all():
            label = up
    child = np.flatnonzero(label != np.arange(len(names)))
    for at in range(0, len(child), 10_000):
        k = child[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(k)), names.take(pa.array(label[k]))], names=["u", "v"])


def stars(edges: DataFrame) -> DataFrame:
    """For edges (u, v), each node that reaches a smaller one with the smallest it reaches: (node, root).

    In turn, all edges of a node as the larger end meet in a partition and contract there, and
    edges jump from their smaller end to that one's parent, until nothing changes. A partition
    holds about EDGES edges, so their number grows with the data; a node is the larger end of no
    more edges than there were partitions, and the join of the jump is one that adaptive execution
    splits where very many nodes have one parent. Nothing but counts reaches the driver. Null nodes
    and loops are left out.
    """
    e = edges.select("u", "v").where("u <> v")
    e, seen = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), None
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    usual = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = edges.count()
    while True:
        ways = max(1, -(-n // EDGES))
        dealt = e.coalesce(1) if ways == 1 else e.repartition("u").coalesce(ways) if ways <= usual else e.repartition(ways, "u")
        e = settle(dealt.mapInArrow(_contracted, kind))
        now = _hash(e)
        if ways == 1 or now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, n = now, now[0]
        parents = e.select(F.col("u").alias("v"), F.col("v").alias("parent"))
        e = e.join(parents, "v", "left").select("u", F.coalesce("parent", "v").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """stars(), and the roots with themselves: each node that has an edge."""
    found = stars(edges)
    return found.unionAll(found.select(F.col("root").alias("node"), "root").distinct())
