"""Reports on runs of several arms over the same cases: tables, comparisons, rules, acceptance.

A run has a row for each arm and case: arm, id, gold, label, tokens_in, tokens_out, calls, ms and
whatever it is grouped by. A comparison of arms is one pivot on the case, a report one aggregate.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.metrics import capped, count_if, macro_f1, ratio, sign_test

#: Bounds of acceptance. Growth of tokens, flips, p values.
GROWTH, LOOK_GROWTH, FLIPS, P = 0.03, 0.005, 2, 0.10


def right(label: str | Column = "label") -> Column:
    return F.coalesce((F.col(label) if isinstance(label, str) else label) == F.col("gold"), F.lit(False))


def arm_table(runs: DataFrame, *by: str) -> DataFrame:
    """(arm, by, n, accuracy, macro_f1, evidence, tokens, calls, ms): one line for each arm.

    evidence is the share of cases with a gold label other than neutral whose `hit` is true.
    """
    keys = ("arm", *by)
    told = F.avg(F.when(F.col("gold") != 1, F.col("hit").cast("double")))
    got = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(right().cast("double")).alias("accuracy"), told.alias("evidence"), F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"), F.sum("calls").alias("calls"), F.avg("ms").alias("ms")
    )
    return got.join(macro_f1(runs.withColumnRenamed("label", "pred"), *keys), list(keys))


def grouped(runs: DataFrame, *by: str) -> DataFrame:
    """(by, n, hits, accuracy, tokens)."""
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), count_if(right()).alias("hits"), F.avg(right().cast("double")).alias("accuracy"), F.avg(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"))


def pivoted(runs: DataFrame, arms: Sequence[str], *keep: str, key: str = "id") -> DataFrame:
    """(key, gold, keep, <arm>): cases that every arm has, with each arm's label."""
    each = runs.where(F.col("arm").isin(*arms)).groupBy(key, "gold", *keep).agg(*(F.max(F.when(F.col("arm") == a, F.col("label"))).alias(a) for a in arms), F.countDistinct("arm").alias("arms"))
    return each.where(F.col("arms") == len(arms)).drop("arms")


def against(runs: DataFrame, base: str, *by: str) -> DataFrame:
    """(arm, by, n, fixes, breaks, two_sided, one_sided): every arm against the base arm on shared cases."""
    first = runs.where(F.col("arm") == base).select("id", F.col("label").alias("before"))
    both = runs.where(F.col("arm") != base).join(first, "id")
    got = both.groupBy("arm", *by).agg(F.count(F.lit(1)).alias("n"), count_if(~right("before") & right()).alias("fixes"), count_if(right("before") & ~right()).alias("breaks"))
    two, one = sign_test(F.col("fixes"), F.col("breaks"))
    return got.withColumn("two_sided", two).withColumn("one_sided", one)


def run_pairs(runs: DataFrame) -> DataFrame:
    """(arm, other, n, equal): every two runs, by the cases that both have."""
    other = runs.select("id", F.col("arm").alias("other"), F.col("label").alias("said"))
    both = runs.select("id", "arm", "label").join(other, "id").where("arm < other")
    return both.groupBy("arm", "other").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("label").eqNullSafe(F.col("said"))).alias("equal"))


def shared_ids(runs: DataFrame) -> DataFrame:
    """(id) of the cases that all arms have."""
    arms = runs.select("arm").distinct().count()
    return runs.groupBy("id").agg(F.countDistinct("arm").alias("n")).where(F.col("n") == arms).select("id")


def relative_scores(table: DataFrame, weights: Sequence[float] = (0.7, 0.15, 0.15)) -> DataFrame:
    """arm_table() lines with `score`: macro F1 and capped ratios of the best arm's tokens and time to their own."""
    best = Window.partitionBy()  # a few lines, one for each arm
    tokens, ms = F.min("tokens").over(best), F.min("ms").over(best)
    return table.withColumn("score", weights[0] * F.col("macro_f1") + weights[1] * capped(tokens, F.col("tokens")) + weights[2] * capped(ms, F.col("ms")))


def replayed_rules(a: Column, b: Column, c: Column) -> dict[str, Column]:
    """Labels that rules would give from three saved answers: neutral unless they agree; the first
    unless it is neutral; neutral unless the negation's answer fits; the most frequent, of several
    the one said first."""
    opposite = F.element_at(F.array(F.lit(2), F.lit(1), F.lit(0)), b + 1)
    return {
        "agree": F.when(a == b, a).otherwise(1),
        "side": F.when(a == 1, b).otherwise(a),
        "consistent": F.when(a == opposite, a).otherwise(1),
        "majority": F.when((a == b) | (a == c), a).when(b == c, b).otherwise(a),
    }


def replay(cases: DataFrame, rules: Mapping[str, Column], *by: str) -> DataFrame:
    """(rule, by, macro_f1, hits): each rule's labels on all cases, in one pass."""
    each = cases.select("gold", *by, F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), c.cast("int").alias("pred")) for k, c in rules.items()))).alias("x")).select("gold", *by, "x.rule", "x.pred")
    hits = each.groupBy("rule", *by).agg(count_if(F.col("gold") == F.col("pred")).alias("hits"))
    return macro_f1(each, "rule", *by).join(hits, ["rule", *by])


def accepted(lines: DataFrame) -> DataFrame:
    """lines (arm, fixes, breaks, one_sided, growth, flips) with a boolean for each rule, and all of them."""
    rules = {"gains": F.col("fixes") > F.col("breaks"), "sure": F.col("one_sided") <= P, "cheap": F.col("growth") <= GROWTH, "steady": F.col("flips") <= FLIPS}
    out = lines
    for name, c in rules.items():
        out = out.withColumn(name, F.coalesce(c, F.lit(False)))
    return out.withColumn("accepted", F.forall(F.array(*rules), lambda x: x))


def look_accepted(lines: DataFrame) -> DataFrame:
    """The rule of a second look: more fixes than breaks, no flip on topic, hardly more tokens."""
    return lines.withColumn("accepted", (F.col("fixes") > F.col("breaks")) & (F.col("flips") == 0) & (F.col("growth") <= LOOK_GROWTH))


def first_reason(*reasons: tuple[str, Column], other: str) -> Column:
    """The name of the first condition that holds."""
    out = None
    for name, c in reasons:
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise(other)


def savings(modes: DataFrame, full: str, *by: str) -> DataFrame:
    """(mode, by, mean, saved): modes (mode, by, tokens) against the full mode's mean."""
    mean = modes.groupBy("mode", *by).agg(F.avg("tokens").alias("mean"))
    w = Window.partitionBy(*by)
    return mean.withColumn("saved", 1 - ratio(F.col("mean"), F.max(F.when(F.col("mode") == full, F.col("mean"))).over(w)))


def mismatches(declared: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Declared numbers (keys, value, digits) that the recomputed ones (keys, value) don't round to, or that
    have no counterpart."""
    real = found.select(*keys, F.col("value").alias("real"))
    scale = F.pow(F.lit(10.0), F.col("digits"))
    near = F.abs(F.round(F.col("real") * scale) - F.round(F.col("value") * scale)) < 0.5
    return declared.join(real, keys, "left").where(~F.coalesce(near, F.lit(False)))
