"""Intervals in time: unions, gaps, concurrency, sessions, arm orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clipped(spans: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """(.., s, e) cut to [lo, hi]; those of no length go."""
    return spans.withColumn("s", F.greatest("s", lo)).withColumn("e", F.least("e", hi)).where("s < e")


def islands(spans: DataFrame, *by: str) -> DataFrame:
    """(by, s, e): unions of spans (by, s, e); spans that touch are one."""
    order = Window.partitionBy(*by).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.where("s < e").withColumn("opens", F.coalesce(F.col("s") > reach, F.lit(True)).cast("int"))
    part = opened.withColumn("island", F.sum("opens").over(order))
    return part.groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def union_length(spans: DataFrame, *by: str) -> DataFrame:
    return islands(spans, *by).groupBy(*by).agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.count(F.lit(1)).alias("islands"))


def gaps(spans: DataFrame, *by: str) -> DataFrame:
    """(by, s, e) of the times between unions."""
    order = Window.partitionBy(*by).orderBy("s")
    return islands(spans, *by).select(*by, F.lag("e").over(order).alias("s"), F.col("s").alias("e")).where("s IS NOT NULL")


def max_concurrency(spans: DataFrame, *by: str) -> DataFrame:
    """(by, most): spans open at once at most; one that ends as another begins doesn't overlap it."""
    steps = spans.select(*by, F.explode(F.array(F.struct(F.col("s").alias("t"), F.lit(1).alias("d")), F.struct(F.col("e").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy(*by, F.col("x.t").alias("t"), F.col("x.d").alias("d")).agg(F.sum("x.d").alias("step"))
    order = Window.partitionBy(*by).orderBy("t", "d").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("open", F.sum("step").over(order)).groupBy(*by).agg(F.max("open").alias("most"))


def sessions(events: DataFrame, by: str, t: str, pause: int) -> DataFrame:
    """(by, s, e, n): runs of events with no more than `pause` between neighbours."""
    order = Window.partitionBy(by).orderBy(t)
    new = (F.col(t) - F.lag(t).over(order) > pause) | F.lag(t).over(order).isNull()
    run = events.withColumn("session", F.sum(new.cast("int")).over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(by, "session").agg(F.min(t).alias("s"), F.max(t).alias("e"), F.count(F.lit(1)).alias("n")).drop("session")


def arm_order(case: Column, place: Column, arms: int) -> Column:
    """The arm at a place of a case: rows of a balanced Latin square (for an odd number, a rotation).

    With an even number the places alternate from both ends, 0, 1, n-1, 2, n-2, .., shifted by
    the case, so that each arm follows each other one once in `arms` cases.
    """
    if arms % 2:
        return (case + place) % arms
    zigzag = F.when(place % 2 == 1, (place + 1) / 2).otherwise((arms - place / 2) % arms).cast("int")
    return (zigzag + case) % arms
