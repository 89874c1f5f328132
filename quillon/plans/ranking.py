"""Queries of the ranking family: BM25, fusion, cosine, lexical overlap, page sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import header, plain, title_words
from quillon.functions.vectors import static_embeddings as static
from quillon.operators import rank, scored
from quillon.operators.fuzzy import fuzzy_pairs
from quillon.operators.nearest import nearest
from quillon.operators.settled import in_blocks
from quillon.plans.catalog import query, table

STEMS = "list_transform(regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]{{2,}}'), lambda x: x[1:7])"
BM25_SQL = f"""
tok AS (SELECT doc_id, {STEMS.format(t="text")} AS ws FROM documents),
st AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM tok),
tf AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest({STEMS.format(t="text")}) AS term FROM benchmark),
bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
       FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", "text")


def found(spark: SparkSession, d: str) -> list[scored.Found]:
    return scored.found(table(spark, d, "documents").select("doc_id", "text"), claims(spark, d), "doc_id", "item_id")


def ranked(spark: SparkSession, d: str, **k: int) -> DataFrame:
    """(ranker, item_id, doc_id, rank, score, shared): the first k by each ranker (see scored.best)."""
    return scored.best(found(spark, d), k)


def best(scores: DataFrame, k: int = 8) -> DataFrame:
    return rank.top_k(scores, "item_id", k, F.round("score", 9).desc(), "doc_id")


@query(f"""WITH {BM25_SQL}
SELECT item_id, doc_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm) WHERE r <= 8""")
def bm25_top8(spark: SparkSession, d: str) -> DataFrame:
    return ranked(spark, d, bm25=8).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25_SQL},
ts AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM (SELECT DISTINCT doc_id, term FROM tf) JOIN q USING (term) GROUP BY 1, 2),
a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm),
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM ts),
f AS (SELECT item_id, doc_id, coalesce(1.0 / (60 + a.r), 0) + coalesce(1.0 / (60 + b.r), 0) AS score FROM a FULL JOIN b USING (item_id, doc_id))
SELECT item_id, doc_id, CAST(r AS INTEGER) AS rank, round(CAST(score AS DOUBLE), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM f) WHERE r <= 8""")
def rrf_hybrid_top8(spark: SparkSession, d: str) -> DataFrame:
    """BM25 fused with the number of shared terms."""
    return best(scored.fused(found(spark, d), 8)).select("item_id", "doc_id", "rank", F.round("score", 6).alias("score"))


COSINE_SQL = """c AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
      FROM c AS q, c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS r FROM s)"""


def cosine_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and the query rows (id divisible by 50)."""
    vectors = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    return vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("v").alias("q"))


def cosine_best(spark: SparkSession, d: str, k: int = 8) -> DataFrame:
    """Of each query row with every other row, the k best."""
    return rank.top_k(nearest(*cosine_sides(spark, d), k), "query_id", k, F.round("score", 6).desc(), "vec_id")


@query(f"WITH {COSINE_SQL} SELECT query_id, vec_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM t WHERE r <= 8")
def cosine_top8(spark: SparkSession, d: str) -> DataFrame:
    return cosine_best(spark, d).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {COSINE_SQL}
SELECT DISTINCT query_id, n AS vec_id FROM (SELECT query_id, unnest([vec_id - 1, vec_id, vec_id + 1]) AS n FROM t WHERE r <= 3) WHERE n IN (SELECT vec_id FROM embeddings)""")
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return rank.with_neighbours(cosine_best(spark, d, 3), table(spark, d, "embeddings"), "query_id", "vec_id")


@query(f"""WITH {COSINE_SQL},
x AS (SELECT t.score, q.label = c.label AS same FROM t JOIN c AS q ON q.vec_id = t.query_id JOIN c ON c.vec_id = t.vec_id WHERE r <= 8),
g AS (SELECT round(score, 2) AS threshold, count(*) FILTER (WHERE same) AS a, count(*) FILTER (WHERE NOT same) AS b FROM x GROUP BY 1)
SELECT threshold, CAST(sum(a) OVER (ORDER BY threshold DESC) AS BIGINT) AS "right", CAST(sum(b) OVER (ORDER BY threshold DESC) AS BIGINT) AS wrong FROM g""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    from quillon.operators.metrics import threshold_sweep as sweep

    pairs = cosine_best(spark, d).select(F.round("score", 2).alias("score"), (F.col("label") == F.col("query_label")).alias("same"))
    return sweep(pairs, "score", "same")


@query(f"""WITH {COSINE_SQL},
b AS (SELECT query_id, max(CASE WHEN r = 1 THEN score END) - max(CASE WHEN r = 2 THEN score END) AS lead, max(CASE WHEN r = 1 THEN vec_id END) AS first FROM t WHERE r <= 2 GROUP BY 1),
x AS (SELECT lead, q.label = c.label AS same FROM b JOIN c AS q ON q.vec_id = query_id JOIN c ON c.vec_id = first)
SELECT CAST(m AS INTEGER) AS margin_pct, count(*) FILTER (WHERE lead >= m / 100.0 AND same) AS "right", count(*) FILTER (WHERE lead >= m / 100.0 AND NOT same) AS wrong, count(*) FILTER (WHERE lead < m / 100.0) AS unmatched
FROM x, range(0, 11) AS g(m) GROUP BY 1""")
def margin_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Matches by their lead over the second best, at margins of 0 to 0.10."""
    from quillon.operators.metrics import count_if

    w = Window.partitionBy("query_id").orderBy("rank")
    first = cosine_best(spark, d, 2).withColumn("lead", F.col("score") - F.lead("score").over(w)).where("rank = 1")
    each = first.select("lead", (F.col("label") == F.col("query_label")).alias("same"), F.explode(F.sequence(F.lit(0), F.lit(10))).alias("margin_pct"))
    ok = F.col("lead") >= F.col("margin_pct") / 100.0
    return each.groupBy("margin_pct").agg(count_if(ok & F.col("same")).alias("right"), count_if(ok & ~F.col("same")).alias("wrong"), count_if(~ok).alias("unmatched"))


FLAT = "trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '[\\s\u00a0]+', ' ', 'g'))"
NUMBERS = "list_distinct(regexp_extract_all({t}, '\\d+(?:[.,'']\\d+)*'))"
GRAMS = "list_distinct(list_transform(range(1, greatest(length(f) - 3, 0) + 1), lambda i: substr(f, i, 4)))"


@query(f"""WITH a AS (SELECT item_id, text, {FLAT.format(t="text")} AS f FROM benchmark), g AS (SELECT item_id, text, {GRAMS} AS g, {NUMBERS.format(t="text")} AS n FROM a),
p AS (SELECT x.item_id AS a, y.item_id AS b, len(list_intersect(x.g, y.g)) / CAST(len(x.g) AS DOUBLE) + len(list_intersect(x.n, y.n)) AS score FROM g AS x JOIN g AS y ON x.item_id <> y.item_id)
SELECT a AS claim_id, b AS item_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 9) DESC, b) AS r FROM p) WHERE r <= 4""")
def lexical_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The four benchmark texts nearest to each by shared 4-grams and numbers."""
    texts = claims(spark, d).repartition("item_id").select("item_id", rank.lexical_form(F.col("text")).alias("form"))
    other = texts.select(F.col("item_id").alias("claim_id"), F.col("form").alias("claim"))
    pairs = in_blocks(texts, other, "claim_id").where("item_id <> claim_id").withColumn("score", rank.lexical(F.col("claim"), F.col("form")))
    return rank.top_k(pairs, "claim_id", 4, F.round("score", 9).desc(), "item_id").select("claim_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {BM25_SQL},
ts AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM tf JOIN q USING (term) GROUP BY 1, 2),
a AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm) WHERE r <= 8),
b AS (SELECT item_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM ts) WHERE r <= 8),
c AS (SELECT item_id, count(b.doc_id) AS shared FROM a LEFT JOIN b USING (item_id, doc_id) GROUP BY 1)
SELECT count(*) AS cases, round(avg(shared), 6) AS mean_shared, round(avg(CASE WHEN shared = 8 THEN 1.0 ELSE 0.0 END), 6) AS all_equal FROM c""")
def topk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How many of BM25's eight best are among the eight with the most shared terms."""
    of = lambda name: F.collect_set(F.when(F.col("ranker") == name, F.col("doc_id")))
    both = ranked(spark, d, bm25=8, terms=8).groupBy("item_id").agg(of("bm25").alias("a"), of("terms").alias("b")).select(F.size(F.array_intersect("a", "b")).alias("shared"))
    return both.agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("shared"), 6).alias("mean_shared"), F.round(F.avg(F.when(F.col("shared") == 8, 1.0).otherwise(0.0)), 6).alias("all_equal"))


PLAIN = "lower(trim(regexp_replace(replace({t}, '’', ''''), '[\\s\u00a0]+', ' ', 'g')))"
HEADER = "substr(" + PLAIN.format(t="regexp_replace({t}, '^\\s*\\d+\\s*', '')") + ", 1, 160)"
WORDS = "list_distinct(regexp_extract_all(lower({t}), '\\p{{L}}{{4,}}'))"
SECTION_SQL = f"""
pg AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page, {WORDS.format(t=HEADER.format(t="text"))} AS ws FROM documents),
hd AS (SELECT source, page, unnest(ws) AS word FROM pg),
n AS (SELECT source, count(*) AS n FROM pg GROUP BY 1),
wt AS (SELECT source, word, ln((any_value(n) + 1.0) / (count(*) + 1)) AS w FROM hd JOIN n USING (source) GROUP BY 1, 2),
tt AS (SELECT DISTINCT item_id AS title, unnest({WORDS.format(t=PLAIN.format(t="text"))}) AS word FROM benchmark),
sc AS (SELECT title, source, page, sum(w) AS score FROM hd JOIN tt USING (word) JOIN wt USING (source, word) GROUP BY 1, 2, 3),
kp AS (SELECT title, source, page FROM (SELECT *, max(score) OVER (PARTITION BY title, source) AS best FROM sc) WHERE best > 0 AND round(score, 9) >= round(0.5 * best, 9))"""


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, source, page): a source's documents as its pages, numbered without their texts."""
    order = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(order).alias("page"))


def sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(kept pages, pages): documents of a source as a booklet's pages, benchmark texts as titles."""
    pages = table(spark, d, "documents").select("doc_id", title_words(header(F.col("text"))).alias("words")).join(page_numbers(spark, d), "doc_id").drop("doc_id")
    titles = claims(spark, d).select(F.col("item_id").alias("title"), title_words(F.col("text")).alias("words"))
    got = rank.section_scores(pages, titles, "source")
    top = F.max("score").over(Window.partitionBy("title", "source"))
    kept = got.withColumn("best", top).where((F.col("best") > 0) & (F.round("score", 9) >= F.round(0.5 * F.col("best"), 9)))
    return kept.select("title", "source", "page"), pages


@query(f"WITH {SECTION_SQL} SELECT title, source, page FROM kp")
def section_pages(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d)[0]


@query()
def section_pages_titled(spark: SparkSession, d: str) -> DataFrame:
    """section_pages with the pages that carry a title's first 70 characters to 90 %."""
    pages = table(spark, d, "documents").select("doc_id", plain(F.col("text")).alias("p"), title_words(header(F.col("text"))).alias("words")).join(page_numbers(spark, d), "doc_id")
    titles = claims(spark, d).select(F.col("item_id").alias("title"), F.substring(plain(F.col("text")), 1, 70).alias("t"), title_words(F.col("text")).alias("words"))
    full = fuzzy_pairs(titles, pages, ("title", "t"), ("doc_id", "p")).join(page_numbers(spark, d), "doc_id")
    return rank.with_title_pages(rank.section_scores(pages.select("source", "page", "words"), titles.select("title", "words"), "source"), full, "source")


@query("""WITH n AS (SELECT count(*) AS n FROM embeddings), w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM benchmark), t AS (SELECT item_id, length(w) * 7 % n AS vec_id FROM w, n),
e AS (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings), m AS (SELECT item_id, i, avg(x) AS x FROM t JOIN e USING (vec_id) GROUP BY 1, 2), z AS (SELECT item_id, sqrt(sum(x * x)) AS size FROM m GROUP BY 1)
SELECT item_id, CAST(i AS INTEGER) AS dim, round(CASE WHEN size > 0 THEN x / size ELSE 0.0 END, 6) AS x FROM m JOIN z USING (item_id)""")
def static_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Texts as unit means of their words' vectors; a word's length stands for its place in the table."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector"))
    n = vectors.count()
    words = claims(spark, d).select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), 1)).alias("w"))
    tokens = words.select("item_id", (F.length("w") * 7 % n).cast("long").alias("token"))
    return static(tokens, vectors, "item_id").select("item_id", F.posexplode("vector").alias("dim", "x")).select("item_id", (F.col("dim") + 1).alias("dim"), F.round("x", 6).alias("x"))


@query(f"""WITH {SECTION_SQL},
f AS (SELECT DISTINCT source, page + o AS page FROM (SELECT DISTINCT source, page FROM kp), (VALUES (0), (1)) AS v(o)),
g AS (SELECT source, page FROM f SEMI JOIN pg USING (source, page)),
h AS (SELECT source, page, lead(page) OVER (PARTITION BY source ORDER BY page) AS nxt FROM g),
i AS (SELECT DISTINCT source, unnest(range(page, CASE WHEN nxt - page <= 10 THEN nxt ELSE page + 1 END)) AS page FROM h)
SELECT source, CAST(page AS INTEGER) AS page FROM i SEMI JOIN pg USING (source, page)""")
def section_pages_gapfill(spark: SparkSession, d: str) -> DataFrame:
    kept, pages = sections(spark, d)
    return rank.gap_filled(kept.select("source", "page").distinct(), pages, "source").select("source", "page")


@query(f"""WITH c AS (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT label, unnest(range(1, len(v) + 1)) AS i, unnest(v) AS x FROM c), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
z AS (SELECT label, sqrt(sum(x * x)) AS size FROM m GROUP BY 1)
SELECT label, CAST(i AS INTEGER) AS dim, round(CASE WHEN size > 0 THEN x / size ELSE 0.0 END, 6) AS x FROM m JOIN z USING (label)""")
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Unit mean vectors by label: averages by dimension, as static embeddings average tokens."""
    each = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    mean = each.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    size = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    unit = F.when(F.col("size") > 0, F.col("x") / F.col("size")).otherwise(0.0)
    return mean.join(size, "label").select("label", (F.col("i") + 1).alias("dim"), F.round(unit, 6).alias("x"))
