"""Ranking: BM25, fusion, cosine, lexical overlap, top-k with neighbours, page selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import char_grams, number_tokens, stem_tokens
from quillon.operators.settled import settle, small

#: BM25's and the fusion's constants.
K1, B, RRF = 1.5, 0.75, 60


def postings(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", scope: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Counts of the terms that queries ask for, and those terms: (doc, scope, len, term, tf) and (query, scope, term).

    The texts are read once: each adds a row with a null term, which carries its length. A query's
    terms are a set; postings of other terms are dropped before they are counted and shuffled.
    """
    terms = settle(queries.select(query, *scope, F.explode(F.array_distinct(stem_tokens(F.col(text)))).alias("term")).distinct())
    asked = small(terms.select(*scope, "term").distinct().withColumn("asked", F.lit(True)))
    tokens = docs.select(doc, *scope, stem_tokens(F.col(text)).alias("tokens"))
    each = tokens.select(doc, *scope, F.size("tokens").alias("len"), F.explode(F.concat("tokens", F.array(F.lit(None).cast("string")))).alias("term"))
    kept = each.join(asked, [*scope, "term"], "left").where("asked OR term IS NULL")
    return settle(kept.groupBy(doc, *scope, "len", "term").agg(F.count(F.lit(1)).alias("tf"))), terms


def bm25_of(found: tuple[DataFrame, DataFrame], doc: str, query: str, scope: tuple[str, ...] = ()) -> DataFrame:
    """(query, doc, score) of pairs that share a term, by Okapi BM25 of postings() within each scope."""
    counts, terms = found
    lengths, tf = counts.where("term IS NULL"), counts.where("term IS NOT NULL")
    whole = lengths.groupBy(*scope).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    df = tf.groupBy(*scope, "term").agg(F.count(F.lit(1)).alias("df"))
    if scope:
        tf = tf.join(df, [*scope, "term"]).join(whole, list(scope))
    else:
        n, mean = whole.first()
        tf = tf.join(small(df), "term").withColumn("n", F.lit(n)).withColumn("mean", F.lit(mean))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    got = tf.select(doc, *scope, "term", weight.alias("w")).join(small(terms), [*scope, "term"])
    return got.groupBy(query, doc).agg(F.sum("w").alias("score"))


def shared_of(found: tuple[DataFrame, DataFrame], doc: str, query: str) -> DataFrame:
    """(query, doc, score) of pairs that share a term, by how many they share."""
    counts, terms = found
    return counts.where("term IS NOT NULL").select(doc, "term").join(small(terms), "term").groupBy(query, doc).agg(F.count(F.lit(1)).cast("double").alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str = "text", scope: tuple[str, ...] = ()) -> DataFrame:
    return bm25_of(postings(docs, queries, doc, query, text, scope), doc, query, scope)


def ranked(scores: DataFrame, group: str, *order: Column | str, name: str = "rank") -> DataFrame:
    return scores.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def top_k(scores: DataFrame, group: str, k: int, *order: Column | str) -> DataFrame:
    """The k first of each group; Spark limits groups before the shuffle."""
    return ranked(scores, group, *order).where(F.col("rank") <= k)


def fused(a: DataFrame, b: DataFrame, group: str, item: str) -> DataFrame:
    """Reciprocal-rank fusion of two score tables (group, item, score); an item that only one
    has takes that one's share."""
    order = (F.round("score", 9).desc(), item)
    one = ranked(a, group, *order, name="ra").select(group, item, "ra")
    two = ranked(b, group, *order, name="rb").select(group, item, "rb")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return one.join(two, [group, item], "full").select(group, item, (part("ra") + part("rb")).alias("score"))


def lexical_form(text: Column) -> Column:
    """What lexical() compares: the text's 4-grams and numbers, made once for each text."""
    return F.struct(char_grams(text).alias("grams"), number_tokens(text).alias("numbers"))


def lexical(claim: Column, paragraph: Column) -> Column:
    """Of two lexical_form()s: the share of the claim's 4-grams in the paragraph, plus the numbers they share."""
    grams = claim["grams"]
    share = F.when(F.size(grams) > 0, F.size(F.array_intersect(grams, paragraph["grams"])) / F.size(grams)).otherwise(0.0)
    return share + F.size(F.array_intersect(claim["numbers"], paragraph["numbers"]))


def with_neighbours(top: DataFrame, items: DataFrame, group: str, at: str, n: int = 1) -> DataFrame:
    """(group, at) of the chosen items and those up to n places away that exist in `items`."""
    around = top.select(group, F.explode(F.sequence(F.col(at) - n, F.col(at) + n)).alias(at)).distinct()
    return around.join(items.select(at).distinct(), at, "left_semi").select(group, at)


def gap_filled(kept: DataFrame, pages: DataFrame, group: str, page: str = "page", follow: int = 1, gap: int = 10) -> DataFrame:
    """Kept pages, the page after each, and the pages between two that lie at most `gap` apart."""
    more = kept.select(group, F.explode(F.sequence(F.col(page), F.col(page) + follow)).alias(page)).distinct()
    more = more.join(pages.select(group, page), [group, page], "left_semi")
    after = F.lead(page).over(Window.partitionBy(group).orderBy(page))
    stop = F.when(after - F.col(page) <= gap, after - 1).otherwise(F.col(page))
    filled = more.withColumn("stop", stop).select(group, F.explode(F.sequence(F.col(page), "stop")).alias(page))
    return filled.join(pages.select(group, page), [group, page], "left_semi").distinct()


def section_scores(pages: DataFrame, titles: DataFrame, group: str, page: str = "page", words: str = "words") -> DataFrame:
    """(title, group, page, score): title words in page headers, each weighted ln((n+1)/(df+1))."""
    head = pages.select(group, page, F.explode(words).alias("word")).distinct()
    n = pages.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    df = head.groupBy(group, "word").agg(F.count(F.lit(1)).alias("df")).join(n, group)
    weight = df.select(group, "word", F.ln((F.col("n") + 1) / (F.col("df") + 1)).alias("w"))
    asked = titles.select("title", F.explode(words).alias("word")).distinct()
    return head.join(small(asked), "word").join(weight, [group, "word"]).groupBy("title", group, page).agg(F.sum("w").alias("score"))


def with_title_pages(scores: DataFrame, full: DataFrame, group: str, page: str = "page", keep: float = 0.5) -> DataFrame:
    """(title, group, page): the pages that carry the full title, and of the others those whose score reaches
    `keep` of the best among them."""
    by = ["title", group]
    rest = scores.join(full.select(*by, page), [*by, page], "left_anti")
    best = F.max("score").over(Window.partitionBy(*by))
    kept = rest.withColumn("best", best).where((F.col("best") > 0) & (F.round("score", 9) >= F.round(keep * F.col("best"), 9)))
    return kept.select(*by, page).unionByName(full.select(*by, page)).distinct()
