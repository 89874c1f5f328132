"""Evidence: items from cited pages and paragraphs, within limits of number and length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import halves, let
from quillon.operators.segment import chunked

#: Items at most, characters of an item, of a piece, of an excerpt; paragraphs cited.
ITEMS, ITEM_CHARS, PIECE_CHARS, EXCERPT_CHARS, CITED = 5, 5000, 1000, 2000, 3


def _cited(cases: DataFrame, case: str, cited: str) -> DataFrame:
    """(case, place, page): cited numbers in order, each once."""
    return cases.select(case, F.posexplode(F.array_distinct(cited)).alias("place", "page"))


def page_items(cases: DataFrame, pages: DataFrame, case: str, cited: str = "cited", most: int = ITEMS, chars: int = ITEM_CHARS) -> DataFrame:
    """(case, item_no, page, text): the cited pages in cited order, long ones cut."""
    cut = _cited(cases, case, cited).join(pages, [case, "page"]).select(case, "place", "page", F.posexplode(chunked(chars)(F.trim("text"))).alias("piece_no", "text"))
    w = Window.partitionBy(case).orderBy("place", "piece_no")
    return cut.withColumn("item_no", F.row_number().over(w)).where(F.col("item_no") <= most).select(case, "item_no", "page", "text")


def round_robin(cases: DataFrame, pages: DataFrame, case: str, cited: str = "cited", most: int = ITEMS, chars: int = PIECE_CHARS) -> DataFrame:
    """(case, item_no, page, text): the first piece of every cited page, then every second, .."""
    cut = _cited(cases, case, cited).join(pages, [case, "page"]).select(case, "place", "page", F.posexplode(chunked(chars)(F.trim("text"))).alias("piece_no", "text"))
    w = Window.partitionBy(case).orderBy("piece_no", "place")
    return cut.withColumn("item_no", F.row_number().over(w)).where(F.col("item_no") <= most).select(case, "item_no", "page", "text")


def padded(items: DataFrame, spare: DataFrame, case: str, most: int = ITEMS) -> DataFrame:
    """items, then of `spare` (case, rank, page, text) the pages that no item has, by rank."""
    new = spare.join(items.select(case, "page").distinct(), [case, "page"], "left_anti")
    both = items.select(case, F.lit(0).alias("turn"), F.col("item_no").alias("place"), "page", "text").unionByName(new.select(case, F.lit(1).alias("turn"), F.col("rank").alias("place"), "page", "text"))
    w = Window.partitionBy(case).orderBy("turn", "place")
    return both.withColumn("item_no", F.row_number().over(w)).where(F.col("item_no") <= most).select(case, "item_no", "page", "text")


def paragraph_items(cases: DataFrame, paragraphs: DataFrame, case: str, cited: str = "cited", most: int = ITEMS) -> DataFrame:
    """(case, item_no, page, text): up to CITED cited paragraphs (case, para_no, page, text), then
    their halves in turn; a text that is there already is left out."""
    valid = _cited(cases, case, cited).withColumnRenamed("page", "para_no").join(paragraphs, [case, "para_no"])
    first = Window.partitionBy(case, "text").orderBy("place")
    whole = valid.withColumn("same", F.row_number().over(first)).where("same = 1").drop("same")
    whole = whole.withColumn("turn", F.row_number().over(Window.partitionBy(case).orderBy("place"))).where(F.col("turn") <= CITED)
    half = whole.select(case, F.col("turn").alias("of"), "page", F.posexplode(halves(F.col("text"))).alias("side", "text"))
    rows = whole.select(case, F.lit(0).alias("kind"), F.col("turn").alias("a"), F.lit(0).alias("b"), "page", "text").unionByName(half.select(case, F.lit(1).alias("kind"), F.col("of").alias("a"), F.col("side").alias("b"), "page", "text"))
    once = Window.partitionBy(case, "text").orderBy("kind", "a", "b")
    rows = rows.withColumn("same", F.row_number().over(once)).where("same = 1")
    w = Window.partitionBy(case).orderBy("kind", "a", "b")
    return rows.withColumn("item_no", F.row_number().over(w)).where(F.col("item_no") <= most).select(case, "item_no", "page", "text")


def hedged(items: DataFrame, paragraphs: DataFrame, pages: DataFrame, first: DataFrame, case: str, most: int = ITEMS) -> DataFrame:
    """items, then the paragraph before the first cited one if that opens its page and an earlier
    page holds it, then the first cited one's whole page; texts that are there stay single.

    first: (case, para_no), the first valid cited number of each case.
    """
    order = Window.partitionBy(case).orderBy("para_no")
    near = paragraphs.withColumn("before_page", F.lag("page").over(order)).withColumn("before_text", F.lag("text").over(order)).join(first, [case, "para_no"])
    before = near.where("before_page < page").select(case, F.lit(1).alias("turn"), F.col("before_page").alias("page"), F.col("before_text").alias("text"))
    whole = near.select(case, "page").join(pages, [case, "page"]).select(case, F.lit(2).alias("turn"), "page", F.trim("text").alias("text"))
    more = before.unionByName(whole).withColumn("text", F.substring("text", 1, ITEM_CHARS)).where("text <> ''").withColumn("place", F.lit(0))
    rows = items.select(case, F.lit(0).alias("turn"), "page", "text", F.col("item_no").alias("place")).unionByName(more)
    once = Window.partitionBy(case, "text").orderBy("turn", "place")
    rows = rows.withColumn("same", F.row_number().over(once)).where("same = 1 OR turn = 0")
    w = Window.partitionBy(case).orderBy("turn", "place")
    return rows.withColumn("item_no", F.row_number().over(w)).where(F.col("item_no") <= most).select(case, "item_no", "page", "text")


def within_budget(items: Column, most: int = EXCERPT_CHARS) -> Column:
    """Of texts in order of choice the places taken while the total stays within `most`: one that
    doesn't fit is skipped; only the very first is cut instead. Returns [(place from 1, text)]."""
    kind = "array<struct<at:int,text:string>>"
    start = F.struct(F.lit(0).alias("total"), F.array().cast(kind).alias("kept"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        text = F.when(F.size(a["kept"]) == 0, F.substring(x, 1, most)).otherwise(x)
        fits = a["total"] + F.length(text) <= most
        one = F.array(F.struct((a["at"] + 1).alias("at"), text.alias("text")))
        return F.struct(F.when(fits, a["total"] + F.length(text)).otherwise(a["total"]).alias("total"), F.when(fits, F.concat(a["kept"], one)).otherwise(a["kept"]).alias("kept"), (a["at"] + 1).alias("at"))

    return F.aggregate(items, start, step)["kept"]


def excerpt(paragraphs: Column, cited: Column, most: int = EXCERPT_CHARS) -> Column:
    """The excerpt of a second look: cited paragraphs in the answer's order, then the one before and the one after
    each, as within_budget() takes them; [(number, text)] in number order. Unknown numbers are left out."""

    def order(known: Column) -> Column:
        near = F.flatten(F.transform(known, lambda n: F.array(n - 1, n + 1)))
        return F.concat(known, F.array_distinct(F.filter(near, lambda n: (n >= 1) & (n <= F.size(paragraphs)) & ~F.array_contains(known, n))))

    def taken(numbers: Column) -> Column:
        kept = within_budget(F.transform(numbers, lambda n: F.element_at(paragraphs, n)), most)
        return F.array_sort(F.transform(kept, lambda x: F.struct(F.element_at(numbers, x["at"]).alias("number"), x["text"].alias("text"))))

    known = F.array_distinct(F.filter(cited, lambda n: (n >= 1) & (n <= F.size(paragraphs))))
    return let(let(known, order), taken)
