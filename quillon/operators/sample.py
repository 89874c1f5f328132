"""Sampling by hash, so that any engine draws the same rows, and grids of settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(*cols: Column | str, seed: str = "42") -> Column:
    """A hexadecimal draw for a row: equal columns draw alike, in Spark as in SQL."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.md5(F.concat_ws(":", F.lit(seed), *parts).cast("binary"))


def first_of(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def holdout(rows: DataFrame, group: str, k: int) -> DataFrame:
    """rows with `held`: whether their group is among the k drawn; no group is on both sides."""
    drawn = rows.select(group).distinct().withColumn("d", draw(group)).orderBy("d", group).limit(k).select(group, F.lit(True).alias("held"))
    return rows.join(F.broadcast(drawn), group, "left").withColumn("held", F.coalesce("held", F.lit(False)))  # k rows


def stratified(rows: DataFrame, cells: list[str], key: str, n: int) -> DataFrame:
    """n rows, taken in turn across the cells, each cell in drawn order."""
    w = Window.partitionBy(*cells).orderBy(draw(key), key)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", *cells).limit(n)


def per_label(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(label).orderBy(draw(key), key)
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= k)


#: Perturbations of a text, in the order they are cycled through.
VARIANTS = ("lower", "upper", "dash", "spaces", "nbsp", "line_break", "quotes")


def perturbed(text: Column, turn: Column) -> Column:
    forms = (F.lower(text), F.upper(text), F.concat(F.lit("- "), text), F.replace(text, F.lit(" "), F.lit("  ")), F.replace(text, F.lit(" "), F.lit("\u00a0")), F.regexp_replace(text, " ", "\n"), F.concat(F.lit("«"), text, F.lit("»")))
    return F.element_at(F.array(*forms), (turn % len(VARIANTS) + 1).cast("int"))


def grid(spark, **settings: list) -> DataFrame:
    """Every combination of the settings' values: a few literal rows."""
    out = spark.range(1).select()
    for name, values in settings.items():
        out = out.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    return out
