"""Vectors as array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def static_embeddings(tokens: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """(key, vector): of tokens (key, token) the mean of their rows in a table (token, vector), of length one.

    Sums travel by dimension, combined before the shuffle; a text without known tokens has no row.
    """
    each = tokens.join(table, "token").select(key, F.posexplode("vector").alias("i", "x"))
    mean = each.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn("size", size).select(key, F.transform("v", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(0.0)).alias("vector"))
