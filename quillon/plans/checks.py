"""Queries that check and compare: splits, provenance of numbers, canaries, manifests, vectors, rankers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import dispatch, evidence, metrics, rank, sample, scored
from quillon.operators.nearest import nearest
from quillon.operators.settled import settle
from quillon.plans.catalog import query, table
from quillon.plans.documents import CASES_SQL, HITS_SQL, _items_sql, cases, hits
from quillon.plans.ranking import BM25_SQL, COSINE_SQL, SECTION_SQL, cosine_sides, found, ranked, sections

_SPLIT = "g AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42:' || source), source LIMIT 5), sp AS (SELECT doc_id, source, lang, text, source IN (SELECT source FROM g) AS held FROM documents)"


def split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    return sample.holdout(docs, "source", 5)


@query(f"""WITH {_SPLIT}, x AS (SELECT source, count(DISTINCT held) AS n FROM sp GROUP BY 1), y AS (SELECT doc_id, count(DISTINCT held) AS n FROM sp GROUP BY 1), z AS (SELECT text, count(DISTINCT held) AS n FROM sp GROUP BY 1),
l AS (SELECT lang, count(*) FILTER (WHERE held) AS n FROM sp GROUP BY 1)
SELECT 'groups on both sides' AS assertion, count(*) AS broken FROM x WHERE n > 1 UNION ALL SELECT 'ids on both sides', count(*) FROM y WHERE n > 1 UNION ALL SELECT 'texts on both sides', count(*) FROM z WHERE n > 1
UNION ALL SELECT 'languages without held rows', count(*) FROM l WHERE n = 0 UNION ALL SELECT 'held groups', abs(count(DISTINCT source) - 5) FROM sp WHERE held""")
def leakage(spark: SparkSession, d: str) -> DataFrame:
    """Assertions on a split, each with how often it is broken."""
    s = settle(split(spark, d))
    both = lambda c, name: s.groupBy(c).agg(F.countDistinct("held").alias("n")).where("n > 1").agg(F.lit(name).alias("assertion"), F.count(F.lit(1)).alias("broken"))
    lacking = s.groupBy("lang").agg(metrics.count_if(F.col("held")).alias("n")).where("n = 0").agg(F.lit("languages without held rows").alias("assertion"), F.count(F.lit(1)).alias("broken"))
    groups = s.where("held").agg(F.lit("held groups").alias("assertion"), F.abs(F.countDistinct("source") - 5).alias("broken"))
    return reduce(DataFrame.unionAll, [both("source", "groups on both sides"), both("doc_id", "ids on both sides"), both("h", "texts on both sides"), lacking, groups])


@query(f"WITH {_SPLIT} SELECT doc_id, source, 'v1.1-row-' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '-A' ELSE '-B' END AS name, CAST(doc_id AS INTEGER) AS row, CASE WHEN doc_id % 2 = 0 THEN 'A' ELSE 'B' END AS task FROM sp WHERE held AND doc_id IN (SELECT doc_id FROM labels)")
def extraction(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows of the held sources, with the names that a data set gives them, read back."""
    got = split(spark, d).where("held").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    name = F.concat(F.lit("v1.1-row-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "-A").otherwise("-B"))
    return got.select("doc_id", "source", name.alias("name")).select("*", T.row_of(F.col("name")).alias("x")).select("doc_id", "source", "name", "x.row", "x.task")


@query("SELECT event_type, 'k' AS key, count(*) AS n, CAST(sum(CAST(regexp_extract(props, ':\\s*(-?\\d+)', 1) AS BIGINT)) AS DOUBLE) AS total FROM events GROUP BY 1")
def number_index(spark: SparkSession, d: str) -> DataFrame:
    """All numbers in JSON, by their key."""
    parsed = table(spark, d, "events").select("event_type", F.from_json("props", "map<string,double>").alias("m"))
    each = parsed.select("event_type", F.explode("m").alias("key", "value"))
    return each.groupBy("event_type", "key").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


_FILES = """f AS (SELECT 1 AS file, o_totalprice AS v FROM orders UNION ALL SELECT 2, l_extendedprice FROM lineitem),
rp AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN round(o_totalprice + 0.5, 1) ELSE round(o_totalprice, CAST(o_orderkey % 3 AS INTEGER)) END AS x, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE CAST(o_orderkey % 3 AS INTEGER) END AS digits FROM orders WHERE o_orderkey % 10 = 1)"""


@query(f"""WITH {_FILES}, k AS (SELECT DISTINCT file, d AS digits, CAST(floor(v * power(10, d) + 0.5) AS BIGINT) AS key FROM f, (VALUES (0), (1), (2)) AS y(d)), r AS (SELECT id, digits, CAST(floor(x * power(10, digits) + 0.5) AS BIGINT) AS key FROM rp)
SELECT id, CAST(min(file) AS INTEGER) AS file FROM r LEFT JOIN k USING (digits, key) GROUP BY 1""")
def number_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The first file that holds a reported number, rounded to the decimals it is given with.

    Rounding on both sides makes the join on nearness an equi-join on (decimals, scaled number).
    """
    scaled = lambda v, n: F.floor(v * F.pow(F.lit(10.0), n) + 0.5)
    o = table(spark, d, "orders")
    files = o.select(F.lit(1).alias("file"), F.col("o_totalprice").alias("v")).unionAll(table(spark, d, "lineitem").select(F.lit(2), "l_extendedprice"))
    known = files.select("file", "v", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("digits")).groupBy("digits", scaled(F.col("v"), F.col("digits")).alias("key")).agg(F.min("file").alias("file"))
    odd = F.col("o_orderkey") % 7 == 0
    digits = F.when(odd, 1).otherwise((F.col("o_orderkey") % 3).cast("int"))
    said = F.when(odd, F.round(F.col("o_totalprice") + 0.5, 1)).when(F.col("o_orderkey") % 3 == 0, F.round("o_totalprice", 0)).when(F.col("o_orderkey") % 3 == 1, F.round("o_totalprice", 1)).otherwise(F.round("o_totalprice", 2))
    told = o.where("o_orderkey % 10 = 1").select(F.col("o_orderkey").alias("id"), digits.alias("digits"), said.alias("x")).withColumn("key", scaled(F.col("x"), F.col("digits")))
    return told.join(known, ["digits", "key"], "left").select("id", "file")


_CANARY = """q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), e AS (SELECT conv_id, turn, run, CASE WHEN (conv_id + run) % 5 = 0 THEN substr(text, 1, 40) WHEN (conv_id * 3 + run) % 7 = 0 THEN 'other' ELSE text END AS earlier, text FROM q, (VALUES (0), (1), (2)) AS r(run)),
c AS (SELECT run, CASE WHEN earlier = text THEN 'equal' WHEN length(earlier) >= 40 AND starts_with(text, earlier) THEN 'prefix' ELSE 'different' END AS state FROM e)"""


def canary(spark: SparkSession, d: str) -> DataFrame:
    """(run, state): today's answers against those of earlier runs, some of which were cut when saved."""
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "text", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("run"))
    earlier = F.when((F.col("conv_id") + F.col("run")) % 5 == 0, F.substring("text", 1, 40)).when((F.col("conv_id") * 3 + F.col("run")) % 7 == 0, "other").otherwise(F.col("text"))
    state = F.when(F.col("earlier") == F.col("text"), "equal").when((F.length("earlier") >= 40) & F.col("text").startswith(F.col("earlier")), "prefix").otherwise("different")
    return rows.withColumn("earlier", earlier).select("run", state.alias("state"))


@query(f"WITH {_CANARY} SELECT CAST(run AS INTEGER) AS run, state, count(*) AS n FROM c GROUP BY 1, 2")
def canary_pairs(spark: SparkSession, d: str) -> DataFrame:
    return canary(spark, d).groupBy("run", "state").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CANARY}, m AS (SELECT run, count(*) FILTER (WHERE state <> 'different') AS same, count(*) AS n FROM c GROUP BY 1) SELECT CAST(run AS INTEGER) AS run, same, n, same = max(same) OVER () AS closest FROM m")
def drift_canary(spark: SparkSession, d: str) -> DataFrame:
    """How many answers each earlier run shares with today's, and which runs are closest."""
    m = canary(spark, d).groupBy("run").agg(metrics.count_if(F.col("state") != "different").alias("same"), F.count(F.lit(1)).alias("n"))
    return m.withColumn("closest", F.col("same") == F.max("same").over(Window.partitionBy()))  # a row for each run


@query("""WITH r AS (SELECT source, min(CASE WHEN source LIKE '%3' THEN NULL ELSE doc_id END) AS seen FROM documents GROUP BY 1)
SELECT source, CASE WHEN seen IS NULL THEN 'unknown' ELSE lpad(CAST(seen AS VARCHAR), 6, '0') END AS time, CASE WHEN seen IS NULL OR seen < 10 THEN 'old' ELSE 'new' END AS era, CAST(row_number() OVER (ORDER BY seen NULLS FIRST, source) AS INTEGER) AS place FROM r""")
def manifest_order(spark: SparkSession, d: str) -> DataFrame:
    """Runs in the order of a report: those of unknown time first, with the endpoint's era."""
    r = table(spark, d, "documents").groupBy("source").agg(F.min(F.when(~F.col("source").endswith("3"), F.col("doc_id"))).alias("at"))
    at = F.col("at")
    place = F.row_number().over(Window.orderBy(F.asc_nulls_first("at"), "source"))  # a row for each source
    return r.select("source", F.coalesce(F.lpad(at.cast("string"), 6, "0"), F.lit("unknown")).alias("time"), F.when(at.isNull() | (at < 10), "old").otherwise("new").alias("era"), place.alias("place"))


@query("""WITH a AS (SELECT item_id % 5 AS f, item_id % 3 AS label, item_id % 4 AS cited FROM benchmark)
SELECT CASE WHEN f = 0 THEN 'not JSON' WHEN label = 1 AND cited = 0 THEN 'neutral without numbers' WHEN label = 1 THEN 'neutral with numbers' WHEN cited > 0 THEN 'decided with numbers' ELSE 'decided without numbers' END AS branch, count(*) AS n FROM a GROUP BY 1""")
def answer_branches(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the branch of a coupled schema: labels other than neutral need numbers."""
    i = F.col("item_id")
    numbers = F.when(i % 4 == 0, "[]").otherwise(F.concat(F.lit("["), (i % 4).cast("string"), F.lit("]")))
    text = F.when(i % 5 == 0, "none").otherwise(F.concat(F.lit('{"label": '), (i % 3).cast("string"), F.lit(', "paragraphs": '), numbers, F.lit("}")))
    v = F.try_parse_json("answer")
    rows = table(spark, d, "benchmark").select(text.alias("answer")).select(F.try_variant_get(v, "$.label", "int").alias("label"), F.size(F.try_variant_get(v, "$.paragraphs", "array<int>")).alias("k"))
    branch = F.when(F.col("label").isNull(), "not JSON").when((F.col("label") == 1) & (F.col("k") == 0), "neutral without numbers").when(F.col("label") == 1, "neutral with numbers").when(F.col("k") > 0, "decided with numbers").otherwise("decided without numbers")
    return rows.groupBy(branch.alias("branch")).agg(F.count(F.lit(1)).alias("n"))


_ROUNDED = COSINE_SQL.replace("CAST(embedding AS DOUBLE[]) AS v", "list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 1)) AS v").replace("c AS (", "c2 AS (").replace("FROM c AS q, c ", "FROM c2 AS q, c2 AS c ").replace("s AS (", "s2 AS (").replace("t AS (", "t2 AS (").replace("FROM s)", "FROM s2)")


@query(f"""WITH {COSINE_SQL}, {_ROUNDED}, x AS (SELECT query_id, list(vec_id ORDER BY r) AS a FROM t WHERE r <= 8 GROUP BY 1), y AS (SELECT query_id, list(vec_id ORDER BY r) AS b FROM t2 WHERE r <= 8 GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (WHERE a = b) AS same_order, count(*) FILTER (WHERE list_sort(a) = list_sort(b)) AS same_set, round(avg(len(list_intersect(a, b))), 6) AS shared FROM x JOIN y USING (query_id)""")
def vector_orders(spark: SparkSession, d: str) -> DataFrame:
    """Whether vectors rounded to one decimal keep the first eight and their order."""

    def first(v: DataFrame, name: str) -> DataFrame:
        q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
        top = rank.top_k(nearest(v, q, 8), "query_id", 8, F.round("score", 6).desc(), "vec_id")
        return top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))), lambda x: x["vec_id"]).alias(name))

    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = first(v, "a").join(first(v.withColumn("v", F.transform("v", lambda x: F.round(x, 1))), "b"), "query_id")
    return both.agg(F.count(F.lit(1)).alias("queries"), metrics.count_if(F.col("a") == F.col("b")).alias("same_order"), metrics.count_if(F.array_sort("a") == F.array_sort("b")).alias("same_set"), F.round(F.avg(F.size(F.array_intersect("a", "b"))), 6).alias("shared"))


@query(f"""WITH {COSINE_SQL}, m AS (SELECT query_id, c.label, max(round(s.score, 6)) AS score FROM s JOIN c USING (vec_id) GROUP BY 1, 2)
SELECT query_id, label, CAST(r AS INTEGER) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS r FROM m) WHERE r <= 3""")
def pages_by_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Groups (labels, as pages) by their nearest member (vectors, as chunks)."""
    m = nearest(*cosine_sides(spark, d), 3, by="label").groupBy("query_id", "label").agg(F.max(F.round("score", 6)).alias("score"))
    return rank.top_k(m, "query_id", 3, F.desc("score"), "label").select("query_id", "label", "rank", "score")


_SWITCH = f"""{BM25_SQL}, ts AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM tf JOIN q USING (term) GROUP BY 1, 2),
ra AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm), rb AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM ts),
al AS (SELECT item_id, doc_id, 'BM25' AS ranker, -ra.r AS s FROM ra UNION ALL SELECT item_id, doc_id, 'S', -rb.r FROM rb UNION ALL SELECT item_id, doc_id, 'S+BM25', 1.0 / (60 + ra.r) + 1.0 / (60 + rb.r) FROM ra JOIN rb USING (item_id, doc_id) UNION ALL SELECT item_id, doc_id, 'none', -doc_id FROM ra)"""


@query(f"WITH {_SWITCH} SELECT ranker, item_id, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ranker, item_id ORDER BY round(CAST(s AS DOUBLE), 9) DESC, doc_id) AS r FROM al) WHERE r <= 3")
def ranker_switch(spark: SparkSession, d: str) -> DataFrame:
    """The first three by each ranker; shared terms stand for the similarity of a model."""
    got = found(spark, d)
    rows = scored.best(got, {"bm25": 3, "terms": 3, "none": 3}).select(F.element_at(F.create_map(*map(F.lit, ("bm25", "BM25", "terms", "S", "none", "none"))), F.col("ranker")).alias("ranker"), "item_id", "doc_id", "rank")
    both = rank.top_k(scored.fused(got, 3), "item_id", 3, F.round("score", 9).desc(), "doc_id")
    return rows.unionByName(both.select(F.lit("S+BM25").alias("ranker"), "item_id", "doc_id", "rank"))


@query(f"WITH {BM25_SQL} SELECT item_id, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm) WHERE r <= 2")
def degraded_ranker(spark: SparkSession, d: str) -> DataFrame:
    """A fused ranker whose model cannot run: its lexical half."""
    name = dispatch.effective("S+BM25", {"S"})
    return ranked(spark, d, **{{"BM25": "bm25", "S": "terms", "none": "none"}[name]: 2}).select("item_id", "doc_id", "rank")


@query(f"""WITH {SECTION_SQL}, {HITS_SQL}, pn AS (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page FROM documents),
g AS (SELECT item_id AS title, source, page FROM hit JOIN pn USING (doc_id)), f AS (SELECT title, source, min(page) AS first FROM g GROUP BY 1, 2)
SELECT g.title, g.source, count(*) AS gold, count(kp.page) AS kept, count(kp.page) > 0 AS any_page, max(CASE WHEN kp.page = first THEN 1 ELSE 0 END) = 1 AS first_page FROM g JOIN f ON f.title = g.title AND f.source = g.source LEFT JOIN kp ON kp.title = g.title AND kp.source = g.source AND kp.page = g.page GROUP BY 1, 2""")
def page_judgement(spark: SparkSession, d: str) -> DataFrame:
    """Of pages that hold a text, whether the section's selection keeps any, and the first."""
    from quillon.plans.ranking import page_numbers

    kept, _ = sections(spark, d)
    gold = hits(spark, d).select(F.col("item_id").alias("title"), "doc_id").join(page_numbers(spark, d), "doc_id").select("title", "source", "page")
    first = F.min("page").over(Window.partitionBy("title", "source"))
    both = gold.withColumn("first", first).join(kept.withColumn("kept", F.lit(1)), ["title", "source", "page"], "left")
    return both.groupBy("title", "source").agg(F.count(F.lit(1)).alias("gold"), F.count("kept").alias("kept"), (F.count("kept") > 0).alias("any_page"), F.coalesce(F.bool_or((F.col("page") == F.col("first")) & F.col("kept").isNotNull()), F.lit(False)).alias("first_page"))


_FORM_A, _FORM_B = _items_sql(5000, "place, no").removeprefix("WITH RECURSIVE "), _items_sql(1000, "no, place").removeprefix("WITH RECURSIVE ")


def _form(sql: str, n: str) -> str:
    """The tables of _items_sql under other names, and its rows as a table."""
    head, rows = sql.rsplit("\nSELECT ", 1)
    for name in ("pg0", "cs", "ct0", "src", "cut", "pieces", "x", "y"):
        head = head.replace(f"{name} AS (", f"{name}{n} AS (")
    for name in ("pg0", "ct0", "src", "cut", "pieces", "x", "cs"):
        head = head.replace(f"FROM {name} ", f"FROM {name}{n} ").replace(f"FROM {name})", f"FROM {name}{n})").replace(f"JOIN {name} ", f"JOIN {name}{n} ").replace(f"FROM {name}\n", f"FROM {name}{n}\n")
    return f"{head}, f{n} AS (SELECT {rows.replace('FROM y', f'FROM y{n}')})"


@query(f"WITH RECURSIVE {_form(_FORM_A, '_a')}, {_form(_FORM_B, '_b')} SELECT form, source, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT 'a' AS form, * FROM f_a UNION ALL SELECT 'b', * FROM f_b) GROUP BY 1, 2")
def item_forms(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as whole pages and as their pieces in turn, side by side."""
    a, b = evidence.page_items(*cases(spark, d), "source"), evidence.round_robin(*cases(spark, d), "source")
    both = a.select(F.lit("a").alias("form"), "source", "text").unionAll(b.select(F.lit("b"), "source", "text"))
    return both.groupBy("form", "source").agg(F.count(F.lit(1)).alias("items"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(f"""WITH {CASES_SQL}, m AS (SELECT source, string_agg('=== PAGE ' || page || ' ===' || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS t FROM pg GROUP BY 1) SELECT source, CAST(length(t) AS INTEGER) AS chars, md5(t) AS digest FROM m""")
def page_markers(spark: SparkSession, d: str) -> DataFrame:
    """Booklets as one text with a marker over each page."""
    _, pages = cases(spark, d)
    t = pages.groupBy("source").agg(T.page_markers(F.collect_list(F.struct("page", "text"))).alias("t"))
    return t.select("source", F.length("t").alias("chars"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


@query("""WITH x AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT CASE WHEN role = 'assistant' THEN 'answered' WHEN nxt IS NULL THEN 'open' WHEN n > 4 THEN 'long talk' ELSE 'asked' END AS path, count(*) AS n FROM x GROUP BY 1""")
def paths_taken(spark: SparkSession, d: str) -> DataFrame:
    """What became of a turn, the first that applies."""
    w = Window.partitionBy("conv_id")
    x = table(spark, d, "conversations").withColumn("nxt", F.lead("role").over(w.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(w))
    path = F.when(F.col("role") == "assistant", "answered").when(F.col("nxt").isNull(), "open").when(F.col("n") > 4, "long talk").otherwise("asked")
    return x.groupBy(path.alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH p AS (SELECT page_id, lower(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1)) AS said, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS path FROM pages) SELECT said <> path AS crossed, count(*) AS n FROM p GROUP BY 1")
def cross_language(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose markup and address name different languages."""
    p = table(spark, d, "pages").select(F.lower(F.regexp_extract("html", '<html lang="([a-z]+)"', 1)).alias("said"), F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("path"))
    return p.groupBy((~F.col("said").eqNullSafe(F.col("path"))).alias("crossed")).agg(F.count(F.lit(1)).alias("n"))
