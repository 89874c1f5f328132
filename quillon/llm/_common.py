"""What the corpus operators share: input shaping, shared storage, block numbering."""

from __future__ import annotations

import ctypes
import gc
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def texts(docs: DataFrame, *more: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the columns an operator reads: extra columns, whatever their names, cannot clash.

    A missing optional column counts as null; a null text as empty.
    """
    have = set(docs.columns)
    cols = texts_columns(docs, key, text)
    cols += [(F.col(f"`{c}`") if c in have else F.lit(None)).cast("string").alias(c) for c in more]
    return docs.select(*cols)


#: Rows that go to a Python worker at once: whole texts in batches of the default 10,000 take
#: hundreds of megabytes, on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, unless they are smaller already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def texts_columns(docs: DataFrame, key: str = "doc_id", text: str = "text") -> list[Column]:
    small_batches(docs.sparkSession)
    return [F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")]


#: Up to so many rows of a few numbers each, and bytes of a longer column, are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def bounded(small: DataFrame, long: str | None = None) -> DataFrame:
    """small (computed already), marked for broadcast if its counted rows allow, and the bytes of
    its column `long` if it has one of no fixed size."""
    r = small.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.octet_length(long)) if long else F.lit(0)).alias("b")).first()
    return F.broadcast(small) if r.n <= BROADCAST_ROWS and (r.b or 0) <= BROADCAST_BYTES else small


def settle(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage through a checkpoint in shared_folder()."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Where it is unset, on one machine (a local master, as in tests), a temporary folder; elsewhere
    an error, since a driver's own folder is none that executors see.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffles and checkpoints that nothing refers to any more.

    It acts when the driver's JVM collects its garbage, which a driver with little to do puts off
    for half an hour (spark.cleaner.periodicGC.interval), while disks fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have yet, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(*more: Column, text: str = "text") -> Column:
    """With the doc_id, tells rows apart: a hash of the text (null is not empty here) and more."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"), *more)


def without(docs: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """docs without the rows that gone (doc_id, row_key) names; `key` is docs' row_key()."""
    a, b = fresh(docs, "gone_id"), fresh(docs, "gone_key")
    named = bounded(settle(gone.select(F.col("doc_id").cast("long").alias(a), F.col("row_key").alias(b)).distinct()))
    return docs.join(named, (key == F.col(b)) & F.col("doc_id").cast("long").eqNullSafe(F.col(a)), "left_anti")


def trim() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # no such call in this C library
        pass


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, total: int, each: int) -> int:
    """Bucket count so that a bucket holds about `each` of `total` units: grows with the data."""
    return max(4 * parts(spark), -(-int(total) // each))


def bucket_of(col: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(n)).cast("int")
