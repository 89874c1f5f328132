"""Evaluation: confusion, precision and recall, percentiles, resampling, tests, sweeps, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.settled import settle

#: Fixed values of the score: weights of F1, evidence, tokens and time; of the tasks; least scores.
WEIGHTS_A, WEIGHTS_B, TASKS, LEAST_A, LEAST_B = (0.5, 0.2, 0.15, 0.15), (0.7, 0.15, 0.15), (0.6, 0.4), 0.60, 0.75


def count_if(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b in double precision, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def cleaned(gold: DataFrame, answers: DataFrame, key: str, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(key, gold, pred): answers repeated for a key, missing or of no class count as null."""
    once = answers.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.first("pred").alias("pred"))
    valid = F.when((F.col("n") == 1) & F.col("pred").isin(*classes), F.col("pred"))
    return gold.join(once, key, "left").select(key, "gold", valid.alias("pred"))


def confusion(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, gold, pred, n): a null prediction is 'invalid'."""
    return pairs.groupBy(*by, F.col("gold").cast("string").alias("gold"), F.coalesce(F.col("pred").cast("string"), F.lit("invalid")).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, class, tp, fp, fn, precision, recall, f1) of each class in gold or predictions."""
    return scores_of(confusion(pairs, *by), *by)


def scores_of(n: DataFrame, *by: str) -> DataFrame:
    """class_scores() of a confusion (by, gold, pred, n)."""
    hit = F.col("gold") == F.col("pred")
    sides = n.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("class"), F.lit(1).alias("side")), F.struct(F.col("pred").alias("class"), F.lit(2).alias("side")))).alias("x"), hit.alias("hit"), "n")
    sides = sides.select(*by, F.col("x.class").alias("class"), F.col("x.side").alias("side"), "hit", "n").where("class <> 'invalid'")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    got = sides.groupBy(*by, "class").agg(total((F.col("side") == 1) & F.col("hit")).alias("tp"), total((F.col("side") == 2) & ~F.col("hit")).alias("fp"), total((F.col("side") == 1) & ~F.col("hit")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return got.withColumn("precision", p).withColumn("recall", r).withColumn("f1", ratio(2 * p * r, p + r))


def macro_f1(pairs: DataFrame, *by: str) -> DataFrame:
    """(by, macro_f1): the mean F1 of the classes present in gold or valid predictions."""
    return class_scores(pairs, *by).groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def macro_f1_fixed(pairs: DataFrame, classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """(macro_f1): over all given classes, absent ones counting 0."""
    g, p = F.col("gold"), F.coalesce(F.col("pred"), F.lit(-1))
    f1 = [ratio(2 * count_if((g == c) & (p == c)), count_if(g == c) + count_if(p == c)) for c in classes]
    return pairs.agg((sum(f1[1:], f1[0]) / len(classes)).alias("macro_f1"))


def at_index(values: DataFrame, group: str, value: str, index: Column, name: str, cells: int = 4096) -> DataFrame:
    """(group, name): the value at a 0-based index of the group's sorted values; nulls don't count.

    index may use `n`, the group's size. Values are counted in cells between the group's least
    and largest; the running count over cells finds the one that holds the index, and only that
    cell's values are sorted. So a group is never sorted as a whole.
    """
    got = values.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    range_ = got.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("n")).withColumn("index", index.cast("long"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * cells), F.lit(cells - 1))).otherwise(0)
    celled = got.join(range_, "g").withColumn("cell", place.cast("int"))
    counts = celled.groupBy("g", "cell", "index").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.partitionBy("g").orderBy("cell")) - F.col("c")
    holds = counts.withColumn("before", before).where((F.col("index") >= F.col("before")) & (F.col("index") < F.col("before") + F.col("c"))).select("g", "cell", "before")
    inside = celled.join(holds, ["g", "cell"])
    w = Window.partitionBy("g").orderBy("v")
    return inside.withColumn("r", F.row_number().over(w) - 1 + F.col("before")).where("r = index").select(F.col("g").alias(group), F.col("v").alias(name))


def nearest_rank(values: DataFrame, group: str, value: str, percent: int, name: str) -> DataFrame:
    """(group, name): the value at rank ceil(percent * n / 100)."""
    return at_index(values, group, value, F.floor((percent * F.col("n") + 99) / 100) - 1, name)


def bootstrap(pairs: DataFrame, rounds: int = 2000, seed: int = 42) -> DataFrame:
    """(low, high): the 95 % interval of Macro-F1 over `rounds` resamples of (gold, pred).

    Each round draws as many rows as there are, with hashed indexes, so that any engine draws the
    same: four draws of 32 bits from the md5 of (seed, round, number). Rows of one gold label and
    prediction are alike, so a draw only finds its cell among their running counts, of which there
    are no more than classes squared; draws are counted where they are made and no row moves.
    """
    cells = sorted((r.gold, r.pred, r.n) for r in confusion(pairs).collect())  # a row for each cell
    n, upto, cell = sum(c[2] for c in cells), 0, F.lit(len(cells) - 1)
    bounds = []
    for _, _, c in cells:
        upto += c
        bounds.append(upto)
    for i in range(len(cells) - 2, -1, -1):
        cell = F.when(F.col("index") < bounds[i], i).otherwise(cell)
    quads = -(-n // 4)
    spark = pairs.sparkSession
    draws = spark.range(quads * rounds).select((F.col("id") % rounds).alias("round"), F.floor(F.col("id") / rounds).alias("quad"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("round").cast("string"), F.col("quad").cast("string")).cast("binary"))
    four = F.array(*(F.struct(F.lit(j).alias("j"), F.conv(F.substring("digest", 1 + 8 * j, 8), 16, 10).cast("long").alias("x")) for j in range(4)))
    each = draws.withColumn("digest", digest).select("round", "quad", F.explode(four).alias("d")).where(F.col("quad") * 4 + F.col("d.j") < n)
    counts = each.select("round", (F.col("d.x") % max(n, 1)).alias("index")).groupBy("round", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(i, g, p) for i, (g, p, _) in enumerate(cells)], "cell int, gold string, pred string")
    scores = scores_of(counts.join(F.broadcast(names), "cell").drop("cell"), "round").groupBy("round").agg(F.avg("f1").alias("m"))
    got = scores.withColumn("r", F.row_number().over(Window.orderBy("m", "round")) - 1)  # a row for each round
    low, high = int(0.025 * rounds), int(0.975 * rounds) - 1
    return got.agg(F.max(F.when(F.col("r") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("r") == high, F.col("m"))).alias("high"))


def log_factorial(n: Column) -> Column:
    """ln(n!), by Stirling's series from 10 on."""
    x = n.cast("double")
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3)) + 1 / (1260 * F.pow(x, 5)) - 1 / (1680 * F.pow(x, 7))
    few = F.array(*(F.lit(math.lgamma(i + 1)) for i in range(10)))
    return F.when(n < 10, few[F.greatest(F.least(n, F.lit(9)), F.lit(0)).cast("int")]).otherwise(series)


def sign_test(fixes: Column, breaks: Column) -> tuple[Column, Column]:
    """Binomial p values (two-sided: the smaller tail twice, 1 at most; one-sided: this many fixes or more).

    A tail's terms build on its largest one, whose logarithm is taken, so that none underflows at
    any n; from the middle on they fall faster than exp(-2 j**2 / n), so the sum ends where what
    follows is below 1e-40 of it. A tail that begins below the middle is 1 less the other one.
    """
    n = (fixes + breaks).cast("long")

    def upper(least: Column) -> Column:
        step = lambda a, k: F.struct(
            (a["term"] * (n - k + 1) / k).alias("term"), (a["sum"] + a["term"] * (n - k + 1) / k).alias("sum")
        )
        last = F.least(n, least + 50 + F.ceil(7 * F.sqrt(n.cast("double"))))
        ks = F.when(last > least, F.sequence(least + 1, F.greatest(last, least + 1))).otherwise(F.array().cast("array<long>"))
        first = log_factorial(n) - log_factorial(least) - log_factorial(n - least) - n * math.log(2)
        return F.exp(first) * F.aggregate(ks, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), step)["sum"]

    def tail(least: Column) -> Column:
        return F.when(least <= 0, 1.0).when(2 * least > n, upper(least)).otherwise(1 - upper(n - least + 1))

    two = F.least(F.lit(1.0), 2 * tail(F.greatest(fixes, breaks).cast("long")))
    return two, tail(fixes.cast("long"))


def threshold_sweep(scored: DataFrame, value: str, positive: str) -> DataFrame:
    """(threshold, right, wrong): rows at or above each distinct threshold, by class.

    Thresholds are dealt by ranges; running sums within a range start from the totals of the ranges above.
    """
    each = scored.groupBy(F.col(value).alias("threshold")).agg(count_if(F.col(positive)).alias("r"), count_if(~F.col(positive)).alias("w"))
    parted = settle(each.repartitionByRange(F.desc("threshold")).withColumn("range", F.spark_partition_id()))
    above = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = parted.groupBy("range").agg(F.sum("r").alias("r"), F.sum("w").alias("w"))
    sums = sums.select("range", F.coalesce(F.sum("r").over(above), F.lit(0)).alias("r0"), F.coalesce(F.sum("w").over(above), F.lit(0)).alias("w0"))
    order = Window.partitionBy("range").orderBy(F.desc("threshold"))
    return parted.join(F.broadcast(sums), "range").select("threshold", (F.sum("r").over(order) + F.col("r0")).alias("right"), (F.sum("w").over(order) + F.col("w0")).alias("wrong"))


def capped(reference: Column, own: Column) -> Column:
    """reference / own, 1 at most; 0 where own is missing or not positive."""
    return F.when(own > 0, F.least(F.lit(1.0), reference / own)).otherwise(0.0)


def official_score(f1_a: Column, evidence: Column, tokens_a: Column, time_a: Column, f1_b: Column, tokens_b: Column, time_b: Column) -> Column:
    """The total of both tasks, from F1, evidence and capped token and time ratios; 0 below the least scores."""
    a = WEIGHTS_A[0] * f1_a + WEIGHTS_A[1] * evidence + WEIGHTS_A[2] * tokens_a + WEIGHTS_A[3] * time_a
    b = WEIGHTS_B[0] * f1_b + WEIGHTS_B[1] * tokens_b + WEIGHTS_B[2] * time_b
    return F.when((f1_a < LEAST_A) | (f1_b < LEAST_B), F.lit(0.0)).otherwise(TASKS[0] * a + TASKS[1] * b)
