"""Results that are computed once and read several times, and sides that may be broadcast."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of what a row's strings and arrays hold, that may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def settle(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut by a checkpoint in the session's spark.checkpoint.dir.

    Where that is unset, on one machine, in a temporary folder; elsewhere it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
        if not at and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> DataFrame:
    """df for broadcast if its counted rows and bytes allow; else as it is, for a shuffled join."""
    size = F.lit(0)
    for f in df.schema:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind == "array":
            size = size + F.coalesce(F.size(f"`{f.name}`"), F.lit(0)) * 16
        elif kind in ("struct", "map"):
            size = size + F.octet_length(F.to_json(f"`{f.name}`"))
        else:
            size = size + 8
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b")).first()
    return F.broadcast(df) if r.n <= BROADCAST_ROWS and (r.b or 0) <= BROADCAST_BYTES else df


def in_blocks(rows: DataFrame, queries: DataFrame, key: str, block: int = 1024) -> DataFrame:
    """Every row with every row of a stated query set, a block of queries at a time.

    An equi-join on the block's number: a row is copied once for each block of `block` queries and
    meets those alone, so no task holds all of either side; queries few enough are broadcast.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    dealt = queries.withColumn("query_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return rows.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(small(dealt), "query_block").drop("query_block")
