"""Relational forms that the engine's joins take, on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.catalog import query, table


@query("SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def equi_join(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return o.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F') AS o ON o_custkey = c_custkey")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers without an urgent order that is done."""
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return table(spark, d, "customer").join(done, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT count(*) AS customers FROM customer SEMI JOIN orders ON o_custkey = c_custkey")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    got = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    return got.agg(F.count(F.lit(1)).alias("customers"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    return table(spark, d, "documents").select("doc_id").intersect(labels.select("doc_id")).subtract(labels.where("toxic = 1").select("doc_id"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


BANDS = ((0, 50_000), (50_000, 150_000), (150_000, 1_000_000))


@query("SELECT band, count(*) AS n FROM orders JOIN (VALUES " + ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(BANDS)) + ") AS b(band, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY 1")
def range_assign(spark: SparkSession, d: str) -> DataFrame:
    """Each order's price band: a range join against a few literal bands."""
    bands = spark.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(BANDS)], "band int, lo double, hi double")
    got = table(spark, d, "orders").join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("lo")) & (F.col("o_totalprice") < F.col("hi")))
    return got.groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate FROM orders), e AS (SELECT event_id, user_id, ts FROM events)
SELECT event_id, o_orderkey FROM (SELECT e.event_id, o.o_orderkey, row_number() OVER (PARTITION BY event_id ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM e JOIN o ON o_custkey = user_id AND o_orderdate <= ts) WHERE r = 1""")
def as_of_join(spark: SparkSession, d: str) -> DataFrame:
    """Each event with its user's latest order before it: both in one window, no pair of rows made."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").alias("t"), F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("t"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    w = Window.partitionBy("key").orderBy("t", "side", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    got = e.unionByName(o).withColumn("o_orderkey", F.last("o_orderkey", ignorenulls=True).over(w))
    return got.where("side = 1 AND o_orderkey IS NOT NULL").select("event_id", "o_orderkey")


@query("""SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (WHERE late > 0) AS late FROM (
SELECT o_orderkey, o_orderpriority, count(*) FILTER (WHERE l_shipdate > o_orderdate + INTERVAL 30 DAY) AS late FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1""")
def late_orders(spark: SparkSession, d: str) -> DataFrame:
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")
    got = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_orderpriority").agg(F.max(late).alias("late"))
    return got.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.col("late").cast("long")).alias("late"))
