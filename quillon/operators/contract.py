"""The response contract: what is wrong with answers, and with their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import evidence_form
from quillon.operators.judge import NAMES

#: Evidence items that count, characters of one.
ITEMS, CHARS = 5, 5000


def violations(responses: DataFrame, cases: DataFrame) -> DataFrame:
    """(id, problem): each broken rule of responses (id, label, label_name, n_evidence, shortest, longest,
    lowest_page, pages, input_tokens, output_tokens, ms) against the cases (id, task); one pass over a joined
    row per id. pages counts the items that name a page, which those of task B must not."""
    n = responses.groupBy("id").agg(F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in responses.columns if c != "id"))
    both = n.withColumn("answered", F.lit(True)).join(cases.select("id", "task").distinct().withColumn("asked", F.lit(True)), "id", "full")
    name = F.try_element_at(F.array(*map(F.lit, NAMES)), F.col("label") + 1)
    number = lambda c: F.col("answered") & (F.col(c).isNull() | (F.col(c) < 0))
    rules = {
        "missing id": F.col("answered").isNull(),
        "unknown id": F.col("asked").isNull(),
        "duplicate id": F.col("n") > 1,
        "label": F.col("answered") & (F.col("label").isNull() | ~F.col("label").isin(0, 1, 2)),
        "label name": F.col("label").isin(0, 1, 2) & ~F.coalesce(F.col("label_name") == name, F.lit(False)),
        "no evidence list": F.col("answered") & F.col("n_evidence").isNull(),
        "too many items": F.col("n_evidence") > ITEMS,
        "empty item": F.col("shortest") < 1,
        "long item": F.col("longest") > CHARS,
        "page": F.col("lowest_page") < 1,
        "page of a passage": (F.col("task") == "B") & (F.col("pages") > 0),
        "input tokens": number("input_tokens"),
        "output tokens": number("output_tokens"),
        "time": number("ms"),
    }
    named = F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(k)) for k, r in rules.items())))
    return both.select("id", F.explode(named).alias("problem"))


def not_verbatim(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items (case, page, text) whose text their page doesn't hold, but for white space and hyphens."""
    got = items.join(pages.select("page", F.col("text").alias("whole")), "page", "left")
    return got.where(~F.coalesce(F.contains(evidence_form(F.col("whole")), evidence_form(F.col("text"))), F.lit(False))).drop("whole")
