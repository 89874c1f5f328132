"""Queries of case runs: kinds, prompts, completion, second looks, strategies, fallbacks, order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.operators import booklet, dispatch, evidence, judge, rank, route, segment
from quillon.operators.scored import best, found
from quillon.operators.settled import settle
from quillon.plans import booklets
from quillon.plans.catalog import query, table
from quillon.plans.documents import ROUTE_SQL, opened
from quillon.plans.ranking import BM25_SQL

#: Claims on the table's texts as cases: on a booklet (A), on a document (B), or faulty; some name no vote.
CASES_SQL = f"""{ROUTE_SQL}, cs AS (SELECT item_id AS id, text, part, CASE WHEN item_id % 13 = 0 THEN NULL WHEN item_id % 3 = 2 THEN 'B' ELSE 'A' END AS task, 'src' || (item_id % 20) AS doc, item_id % 20 AS k, 1 + (item_id // 20) % 2 AS vote_no, item_id % 11 = 5 AS unknown FROM rt),
ks AS (SELECT *, CASE WHEN unknown THEN [] WHEN k % 4 <> 3 AND k % 7 = 0 AND vote_no = 1 THEN ['committee', 'council', 'detail', 'parliament', 'summary'] ELSE ['committee', 'council', 'detail', 'law', 'parliament', 'summary'] END AS valid FROM cs),
kd AS (SELECT *, CASE WHEN task IS NULL THEN 'done' WHEN task = 'B' THEN 'passage' WHEN list_contains(valid, part) THEN 'paragraphs' WHEN part IS NULL AND len(valid) > 0 THEN 'ask-part' WHEN part IS NOT NULL AND len(valid) = 0 THEN 'ask-structure' ELSE 'pages' END AS kind FROM ks)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, part, task, doc, vote_no, valid, kind)."""
    i = F.col("item_id")
    got = route.route(opened(spark, d)).select(
        i.alias("id"), "text", "part", F.when(i % 13 == 0, None).when(i % 3 == 2, "B").otherwise("A").alias("task"), F.concat(F.lit("src"), (i % 20).cast("string")).alias("doc"),
        F.when(i % 11 != 5, 1 + F.floor(i / 20) % 2).cast("int").alias("vote_no"),
    )
    votes = booklets.votes(spark, d).select("doc", "vote_no", "valid")
    got = got.join(votes, ["doc", "vote_no"], "left").withColumn("valid", F.coalesce("valid", F.array().cast("array<string>")))
    return got.withColumn("kind", dispatch.kind(F.col("task"), F.col("part"), F.col("valid")))


@query(f"{CASES_SQL} SELECT task, kind, count(*) AS n, count(part) AS routed FROM kd GROUP BY 1, 2")
def case_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How cases are completed, by what their rules found."""
    return cases(spark, d).groupBy("task", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("part").alias("routed"))


_SAID = """CASE WHEN kind = 'done' THEN 'invalid request' WHEN id % 19 = 4 THEN 'model call failed' WHEN id % 17 = 3 THEN 'unparseable answer' ELSE 'ok' END"""


def _said() -> F.Column:
    """A judge's answers: some calls fail, some say nothing to the point."""
    i = F.col("id")
    text = F.concat(F.lit('{"label": '), (i % 3).cast("string"), F.lit(', "paragraphs": [1, '), (1 + i % 4).cast("string"), F.lit("]}"))
    return F.when(i % 19 == 4, None).when(i % 17 == 3, "no idea").otherwise(text)


@query(f"{CASES_SQL}, ct AS (SELECT kind, id, {_SAID} AS status FROM kd) SELECT kind, status, CASE WHEN status = 'ok' THEN CAST(id % 3 AS INTEGER) ELSE 1 END AS label, count(*) AS n, CAST(sum(CASE WHEN status = 'ok' THEN 2 + id % 4 ELSE 0 END) AS BIGINT) AS cited FROM ct GROUP BY 1, 2, 3")
def case_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Labels, statuses and the sum of cited numbers, with the fallback label where anything fails."""
    done = dispatch.completed(cases(spark, d), judge.SaidJudge(_said()))
    total = F.aggregate(F.coalesce("cited", F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return done.groupBy("kind", "status", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("cited"))


@query(f"""{CASES_SQL}, ap AS (SELECT *, ['law', 'summary', 'nothing', 'council'][id % 4 + 1] AS said FROM kd WHERE kind = 'ask-part'), st AS (SELECT *, k % 4 <> 3 AND k % 2 = 0 AND part IN ('summary', 'detail') AS ok FROM kd WHERE kind = 'ask-structure')
SELECT kind AS asked, CASE WHEN list_contains(valid, said) THEN 'paragraphs' ELSE 'pages' END AS kind, count(*) AS n FROM ap GROUP BY 1, 2 UNION ALL SELECT kind, CASE WHEN ok THEN 'paragraphs' ELSE 'pages' END, count(*) FROM st GROUP BY 1, 2""")
def asked_first(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose part or structure a model is asked for: to that part if it holds, else to their fallback."""
    c = cases(spark, d)
    said = F.element_at(F.array(*map(F.lit, ("law", "summary", "nothing", "council"))), (F.col("id") % 4 + 1).cast("int"))
    part = dispatch.asked_part(c.where("kind = 'ask-part'"), said).select(F.lit("ask-part").alias("asked"), "kind")
    k = F.substring("doc", 4, 9).cast("int")
    stated = c.select("doc").distinct().where((k % 4 != 3) & (k % 2 == 0)).withColumn("stated", F.array(F.lit("summary"), F.lit("detail")))
    structure = dispatch.asked_structure(c.where("kind = 'ask-structure'"), stated).select(F.lit("ask-structure").alias("asked"), "kind")
    return part.unionByName(structure).groupBy("asked", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def task_a(spark: SparkSession, d: str) -> DataFrame:
    """Task A end to end: booklets parsed, claims routed, paragraphs numbered and sent, answers and evidence."""
    pages = booklets.pages(spark, d)
    paras = settle(booklet.part_paragraphs(pages, booklets.votes(spark, d), booklets.boxes(spark, d)))
    routed = cases(spark, d).where("kind = 'paragraphs'")
    own = routed.select("id", "doc", "vote_no", "part").join(paras, ["doc", "vote_no", "part"]).select("id", "para_no", "page", "text")
    sent = own.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_no", "text"))), lambda x: x["text"]).alias("paragraphs"))
    asked = routed.join(sent, "id").withColumn("prompt", dispatch.paragraphs_prompt(F.col("part"), F.col("paragraphs"), F.col("doc"), F.col("text")))
    done = settle(dispatch.completed(asked, judge.SaidJudge(_said())))
    wanted = done.where("label <> 1 AND cited IS NOT NULL")
    items = evidence.paragraph_items(wanted, own, "id")
    first = wanted.select("id", F.get("cited", F.lit(0)).alias("para_no"))
    hedged = evidence.hedged(items, own, routed.select("id", "doc").join(pages, "doc").select("id", "page", "text"), first, "id")
    return dispatch.with_evidence(done, hedged).groupBy("part", "status", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("items"), F.sum(F.length("prompt")).alias("chars"))


@query()
def page_completion(spark: SparkSession, d: str) -> DataFrame:
    """Cases without a part: the pages that the answer cites, if they were shown, become the evidence."""
    done = dispatch.completed(cases(spark, d).where("kind = 'pages' OR kind LIKE 'ask%'"), judge.SaidJudge(_said()))
    shown = done.select("id", "doc").join(booklets.pages(spark, d), "doc").where("page <= 12").select("id", "page", "text")
    items = evidence.page_items(done.where("label <> 1 AND cited IS NOT NULL"), shown, "id")
    return dispatch.with_evidence(done, items).groupBy("kind", "status", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("items"))


@query("""WITH x AS (SELECT doc_id AS id, doc_id % 3 AS label, doc_id % 2 AS cited, CASE doc_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS e, CASE doc_id % 7 WHEN 0 THEN 1 ELSE doc_id % 7 % 3 END AS g, doc_id % 11 / 10.0 AS sim, 2 * (doc_id // 2 % 2) AS s FROM labels),
y AS (SELECT *, CASE WHEN label = 1 AND cited = 1 THEN coalesce(e, label) ELSE label END AS l1 FROM x), z AS (SELECT *, CASE WHEN l1 = 1 AND cited = 1 AND g IN (0, 2) THEN g ELSE l1 END AS l2 FROM y)
SELECT CAST(label AS INTEGER) AS first, CAST(CASE WHEN l2 = 1 AND sim >= 0.845 AND s IN (0, 2) THEN s ELSE l2 END AS INTEGER) AS label, count(*) AS n FROM z GROUP BY 1, 2""")
def second_looks(spark: SparkSession, d: str) -> DataFrame:
    """First labels and those after the three second looks, in their order."""
    i = F.col("doc_id")
    rows = table(spark, d, "labels").withColumn("label", (i % 3).cast("int")).withColumn("cited", F.when(i % 2 == 1, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    e, g = F.when(i % 5 == 0, 2).when(i % 5 == 1, 1).when(i % 5 == 2, 0), F.when(i % 7 == 0, 1).otherwise((i % 7 % 3).cast("int"))
    last = dispatch.looks(F.col("label"), F.col("cited"), e, g, (2 * (F.floor(i / 2) % 2)).cast("int"), i % 11 / 10.0)
    return rows.select(F.col("label").alias("first"), last.cast("int").alias("label")).groupBy("first", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT item_id AS id, md5('REFERENCE TEXT:{chr(10)}' || text || '{chr(10)}{chr(10)}CLAIM:{chr(10)}' || substr(text, 1, 40)) AS prompt, md5('{dispatch.PROMPTS['passage'][0]}') AS system, CAST({dispatch.PROMPTS['passage'][2]} AS INTEGER) AS budget FROM benchmark")
def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Requests as they would be sent, by their hashes."""
    text = dispatch.passage_prompt(F.col("text"), F.substring("text", 1, 40))
    h = lambda c: F.md5(F.encode(c, "UTF-8"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), h(text).alias("prompt"), h(dispatch.system(F.lit("passage"))).alias("system"), dispatch.budget(F.lit("passage")).alias("budget"))


@query("""WITH x AS (SELECT conv_id, turn, role, turn % 4 AS t FROM conversations), y AS (SELECT role, t, CASE t WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS word, CASE WHEN t = 3 THEN NULL ELSE conv_id % 2 = 0 END AS same, turn FROM x)
SELECT role, CAST(word AS INTEGER) AS word, same, CAST(sum(CASE WHEN t = 3 THEN 0 ELSE turn + 5 END) AS BIGINT) AS numbers, count(*) AS n FROM y GROUP BY 1, 2, 3""")
def answer_words(spark: SparkSession, d: str) -> DataFrame:
    """Answers by words, booleans and lists of numbers: of conversations' turns, in several spellings."""
    word = F.element_at(F.array(*map(F.lit, ("same", "Different ", "NOTHING", "other"))), (F.col("turn") % 4 + 1).cast("int"))
    flag = F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false")
    text = F.concat(F.lit('Well: {"finding": "'), word, F.lit('", "same_ballot": '), flag, F.lit(', "paragraphs": [5, true, "'), F.col("turn").cast("string"), F.lit('"]} as asked.'))
    said = table(spark, d, "conversations").withColumn("answer", F.when(F.col("turn") % 4 != 3, text).otherwise("I cannot say"))
    a = F.col("answer")
    total = F.aggregate(judge.numbers(a, "paragraphs"), F.lit(0).cast("long"), lambda s, x: s + x)
    got = said.select("role", judge.word_label(a, "finding", dispatch.FINDINGS).alias("word"), judge.boolean(a, "same_ballot").alias("same"), total.alias("s"))
    return got.groupBy("role", "word", "same").agg(F.sum("s").alias("numbers"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT item_id AS id, text, least(4, len(string_split_regex(text, '[.!?]\\s+'))) AS parts FROM benchmark), a AS (SELECT id, id % 3 AS x, (id + 1) % 3 AS y, id % 2 AS z, (id // 3) % 3 AS neg, parts FROM c),
p AS (SELECT id, max(CASE WHEN (id + i) % 3 = 2 THEN 1 ELSE 0 END) AS any2, min(CASE WHEN (id + i) % 3 = 0 THEN 1 ELSE 0 END) AS all0, count(*) AS n FROM (SELECT id, unnest(range(0, parts)) AS i FROM a) GROUP BY 1),
s AS (SELECT 'xlang' AS strategy, id, CASE WHEN x = y THEN x ELSE z END AS label, 3 AS calls FROM a UNION ALL SELECT 'negation', id, CASE WHEN x = 1 THEN 2 - neg ELSE x END, 2 FROM a UNION ALL SELECT 'decompose', id, CASE WHEN any2 = 1 THEN 2 WHEN all0 = 1 THEN 0 ELSE 1 END, n FROM p)
SELECT strategy, CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(calls * 10) AS BIGINT) AS tokens FROM s GROUP BY 1, 2""")
def strategies(spark: SparkSession, d: str) -> DataFrame:
    """Labels by strategies of several calls: another language, the negation, the claim in parts."""
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    i, call = F.col("id"), F.col("call")
    said = F.when(call == "first", i % 3).when(call == "translated", (i + 1) % 3).when(call == "tiebreak", i % 2).when(call == "negated", F.floor(i / 3) % 3).otherwise((i + F.substring(call, 5, 2).cast("int")) % 3).cast("int")
    rows = []
    for name in ("xlang", "negation", "decompose"):
        calls = dispatch.strategy_calls(claims, name).withColumn("label", said).withColumn("tokens", F.lit(10))
        rows.append(dispatch.strategy_labels(calls, name).withColumn("strategy", F.lit(name)))
    return reduce(DataFrame.unionByName, rows).groupBy("strategy", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))


@query("SELECT role, count(*) AS n, count(DISTINCT text) AS asked, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def parsing_roles(spark: SparkSession, d: str) -> DataFrame:
    """Calls that a text decides alone are made once for each text, and joined back."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", "text")
    got = dispatch.once(rows, ["role", "text"], judge.SaidJudge(F.length("text").cast("string")))
    return got.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked_here").cast("long")).alias("asked"), F.sum(F.col("answer").cast("long")).alias("chars"))


_TRANSLATED = BM25_SQL.replace("FROM benchmark)", "FROM (SELECT item_id, coalesce(CASE WHEN item_id % 3 <> 0 THEN replace(text, 'th', 'sch') END, text) AS text FROM benchmark))")


@query(f"WITH {_TRANSLATED} SELECT item_id, doc_id, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm) WHERE r <= 3")
def translated_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 with the claim's translation, or with the claim itself where there is none."""
    said = judge.SaidJudge(F.when(F.col("item_id") % 3 != 0, F.replace("text", F.lit("th"), F.lit("sch"))))
    claims = said.ask(table(spark, d, "benchmark")).select("item_id", F.coalesce("answer", "text").alias("text"))
    return best(found(table(spark, d, "documents").select("doc_id", "text"), claims, "doc_id", "item_id"), {"bm25": 3}).select("item_id", "doc_id", "rank")


_NEEDS = f"""{CASES_SQL}, nd AS (SELECT kd.*, CASE WHEN kind = 'passage' THEN d.n_chars > 3000 AND NOT d.lang = ['de', 'en', 'fr'][id % 3 + 1] ELSE false END AS needs FROM kd LEFT JOIN documents AS d ON d.doc_id = kd.id)"""


def _needs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang")
    same = F.coalesce(F.col("lang") == F.element_at(F.array(*map(F.lit, ("de", "en", "fr"))), (F.col("id") % 3 + 1).cast("int")), F.lit(False))
    got = cases(spark, d).join(docs, "id", "left")
    return got.withColumn("needs_model", F.coalesce(dispatch.needs_model(F.col("kind"), F.col("n_chars") > 3000, "cut4-h", same, False), F.lit(False)))


@query(f"{_NEEDS} SELECT kind, needs, count(*) AS n, bool_and(NOT needs) AS none FROM nd GROUP BY 1, 2")
def needs_model(spark: SparkSession, d: str) -> DataFrame:
    """Cases that run an embedding model while they are prepared."""
    return _needs(spark, d).groupBy("kind", F.col("needs_model").alias("needs")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(~F.col("needs_model")).alias("none"))


@query(f"{_NEEDS} SELECT id, CAST(row_number() OVER (ORDER BY needs, min_id, id) AS INTEGER) AS turn FROM (SELECT id, needs, min(id) OVER (PARTITION BY CASE WHEN task = 'A' THEN doc ELSE '' END) AS min_id FROM nd)")
def case_order(spark: SparkSession, d: str) -> DataFrame:
    """Cases without a model first, then booklet by booklet as first seen, then as given."""
    got = dispatch.prepared_order(_needs(spark, d).withColumn("line_no", F.col("id")).withColumn("doc", F.when(F.col("task") == "A", F.col("doc"))))
    return got.select("id", F.row_number().over(Window.orderBy("turn")).alias("turn"))  # numbers of cases alone


@query()
def task_b_selectors(spark: SparkSession, d: str) -> DataFrame:
    """Long references cut by each selector that needs no model, to their first line and best paragraphs."""
    items = table(spark, d, "benchmark")
    n = items.count()
    claims = rank.small(items.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim"), rank.lexical_form(F.col("text")).alias("c")))
    docs = table(spark, d, "documents").where(F.length("text") > dispatch.LIMITS["cut4"][0])
    same = (F.col("doc_id") % 2) == 0
    first = F.trim(F.split(F.trim("text"), "\n")[0])
    paras = docs.select("doc_id", first.alias("first"), F.posexplode(segment.grouped(F.regexp_replace("text", r"^\s*[^\n]*\n", ""))).alias("para_no", "paragraph")).withColumn("claim_id", F.col("doc_id") % n).join(claims, "claim_id")
    # Texts are cut once, and each of the three forms that selectors compare is scored once.
    form = lambda s: rank.lexical(F.col("c"), rank.lexical_form(dispatch.selector_text(F.lit(s), F.col("paragraph"), F.col("first"))))
    each = paras.select("doc_id", "para_no", *(form(s).alias(s) for s in ("L", "T", "TF")))

    def score(mode: str) -> Column:
        s = dispatch.selector(mode, same)
        return F.when(s == "L", F.col("L")).when(s == "T", F.col("T")).otherwise(F.col("TF"))

    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), score(m).alias("score")) for m in ("cut4-l", "cut4-t", "cut4-h", "cut4-tf"))))
    each = each.select("doc_id", "para_no", modes.alias("x")).select("doc_id", "para_no", "x.mode", "x.score")
    first_of = Window.partitionBy("doc_id", "mode").orderBy(F.round("score", 9).desc(), "para_no")
    kept = each.withColumn("rank", F.row_number().over(first_of)).where(F.col("rank") <= dispatch.LIMITS["cut4"][1])
    return kept.groupBy("doc_id", "mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list("para_no")), lambda x: x.cast("string")), ",").alias("kept")).select("doc_id", "mode", "kept")


@query()
def wide_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose opening names no part: the nearest paragraphs of all parts of their booklet."""
    pages = booklets.pages(spark, d)
    paras = booklet.part_paragraphs(pages, booklets.votes(spark, d), booklets.boxes(spark, d)).select("doc", F.struct("vote_no", "part", "para_no").alias("place"), "part", "text")
    claims = cases(spark, d).where("kind = 'ask-part'").select(F.col("id").alias("claim"), "doc", "text")
    return dispatch.wide(paras, claims).groupBy("claim").agg(F.count(F.lit(1)).alias("paragraphs"), F.countDistinct("part").alias("parts"), F.sum(F.length("text")).alias("chars"))


@query(f"""{CASES_SQL}, rc AS (SELECT k % 3 AS edition, part, CASE WHEN task IS NULL OR task = 'B' THEN 'not asked' WHEN kind = 'paragraphs' THEN 'routed' WHEN unknown THEN 'vote not found' WHEN part IS NULL THEN 'no part named' ELSE 'part not valid' END AS reason FROM kd)
SELECT reason, part, CAST(edition AS INTEGER) AS edition, CAST(grouping(reason, part, edition) AS INTEGER) AS level, count(*) AS n FROM rc GROUP BY GROUPING SETS ((reason), (reason, part), (reason, edition), ())""")
def routing_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Why cases were not routed, the first reason that holds, by part and edition in one aggregate."""
    c = cases(spark, d)
    reason = F.when(F.coalesce(F.col("task") == "B", F.lit(True)), "not asked").when(F.col("kind") == "paragraphs", "routed").when(F.col("vote_no").isNull(), "vote not found").when(F.col("part").isNull(), "no part named").otherwise("part not valid")
    g = c.select(reason.alias("reason"), "part", (F.substring("doc", 4, 9).cast("int") % 3).alias("edition"))
    r, p, e = map(F.col, ("reason", "part", "edition"))
    return g.groupingSets([[r], [r, p], [r, e], []], "reason", "part", "edition").agg(F.grouping_id("reason", "part", "edition").cast("int").alias("level"), F.count(F.lit(1)).alias("n"))
