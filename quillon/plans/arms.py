"""Queries over runs of three arms: tables, comparisons, replayed rules, acceptance, losses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import arms, metrics, rank, segment
from quillon.plans.catalog import query, table
from quillon.plans.documents import HITS_SQL, TAGS, hits, holding
from quillon.plans.evaluation import ARM_A, PAIRS_SQL, _classes, pairs
from quillon.plans.ranking import BM25_SQL, COSINE_SQL, cosine_best, ranked

#: Each labelled document as a case of three arms; what a run records is a function of its number.
RUNS_SQL = f"""{PAIRS_SQL}, r AS (SELECT arm, n AS arm_no, doc_id AS id, lang, CASE doc_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'it' END AS claim_lang, source, gold, CASE n WHEN 0 THEN a WHEN 1 THEN b ELSE CASE WHEN n_chars > 2000 THEN 1 - b ELSE b END END AS label,
n_chars, n_chars // (4 + n) AS tokens_in, 9 + doc_id % 4 AS tokens_out, 1 + (doc_id + n) % 3 AS calls, 100 + (doc_id * 7 + n * 13) % 400 AS ms, 'backend' || ((doc_id + n) % 3) AS backend, (doc_id + n) % 3 AS position, doc_id % 5 <> n AS hit,
doc_id % 4 AS cited FROM p, (VALUES ('a', 0), ('b', 1), ('c', 2)) AS x(arm, n))"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    p = pairs(spark, d).withColumn("id", F.col("doc_id"))
    p = p.select("*", F.explode(F.array(*(F.struct(F.lit(a).alias("arm"), F.lit(i).alias("n")) for i, a in enumerate("abc")))).alias("x")).withColumn("arm", F.col("x.arm")).withColumn("arm_no", F.col("x.n"))
    i, n = F.col("id"), F.col("arm_no")
    third = F.when(F.col("n_chars") > 2000, 1 - F.col("b")).otherwise(F.col("b"))
    return p.select(
        "arm", "arm_no", "id", "lang", F.element_at(F.array(F.lit("de"), F.lit("fr"), F.lit("it")), (i % 3 + 1).cast("int")).alias("claim_lang"), "source", "gold",
        F.when(n == 0, F.col("a")).when(n == 1, F.col("b")).otherwise(third).alias("label"), "n_chars", F.floor(F.col("n_chars") / (4 + n)).alias("tokens_in"), (9 + i % 4).alias("tokens_out"), (1 + (i + n) % 3).alias("calls"),
        (100 + (i * 7 + n * 13) % 400).alias("ms"), F.concat(F.lit("backend"), ((i + n) % 3).cast("string")).alias("backend"), ((i + n) % 3).alias("position"), (i % 5 != n).alias("hit"), (i % 4).alias("cited"),
    )


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def _classes_by(rows: str, by: str) -> str:
    """Macro F1 in SQL of rows (by, gold, pred) named `p`: a table k (by, f1)."""
    return f"p2 AS ({rows}), " + _classes(by).replace("FROM p GROUP BY ALL", "FROM p2 GROUP BY ALL")


TABLE_SQL = f"""{RUNS_SQL}, {_classes_by("SELECT arm, gold, label AS pred FROM r", "arm")}, m AS (SELECT arm, avg(f1) AS macro_f1 FROM k GROUP BY 1),
t AS (SELECT arm, count(*) AS n, avg(CASE WHEN gold = label THEN 1.0 ELSE 0.0 END) AS accuracy, avg(CASE WHEN gold <> 1 THEN CASE WHEN hit THEN 1.0 ELSE 0.0 END END) AS evidence, avg(tokens_in + tokens_out) AS tokens, CAST(sum(calls) AS BIGINT) AS calls, avg(ms) AS ms FROM r GROUP BY 1),
tab AS (SELECT t.*, macro_f1 FROM t JOIN m USING (arm))"""


@query(f"WITH {TABLE_SQL} SELECT arm, n, round(accuracy, 6) AS accuracy, round(evidence, 6) AS evidence, round(tokens, 6) AS tokens, calls, round(ms, 6) AS ms, round(macro_f1, 6) AS macro_f1 FROM tab")
def arm_table(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arms.arm_table(runs(spark, d)), "accuracy", "evidence", "tokens", "ms", "macro_f1")


@query(f"""WITH {TABLE_SQL} SELECT arm, round(0.7 * macro_f1 + 0.15 * least(1.0, min(tokens) OVER () / tokens) + 0.15 * least(1.0, min(ms) OVER () / ms), 6) AS score FROM tab""")
def relative_score(spark: SparkSession, d: str) -> DataFrame:
    """Each arm's score with the best arm's tokens and time as reference."""
    return rounded(arms.relative_scores(arms.arm_table(runs(spark, d))).select("arm", "score"), "score")


_BY = "SELECT {by}, count(*) AS n, count(*) FILTER (WHERE gold = label) AS hits, round(avg(CASE WHEN gold = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(tokens_in + tokens_out), 6) AS tokens FROM r GROUP BY ALL"


@query(f"WITH {RUNS_SQL} " + _BY.format(by="arm, backend"))
def by_backend(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arms.grouped(runs(spark, d), "arm", "backend"), "accuracy", "tokens")


@query(f"WITH {RUNS_SQL} " + _BY.format(by="arm, CAST(position AS BIGINT) AS position"))
def by_position(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arms.grouped(runs(spark, d), "arm", "position"), "accuracy", "tokens")


@query(f"WITH {RUNS_SQL} SELECT backend, ms < 150 AS from_cache, count(*) AS n FROM r GROUP BY 1, 2")
def backend_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Calls by what answered them, a cache where they were quick."""
    return runs(spark, d).groupBy("backend", (F.col("ms") < 150).alias("from_cache")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS_SQL}, g AS (SELECT *, CASE WHEN claim_lang = lang THEN 'same' ELSE 'cross' END AS kind, lang || '->' || claim_lang AS pair, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS size FROM r WHERE arm = 'a')
SELECT kind, claim_lang, lang, pair, source, size, CAST(grouping(kind, claim_lang, lang, pair, source, size) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE gold = label) AS hits
FROM g GROUP BY GROUPING SETS ((kind), (claim_lang), (lang), (pair), (source), (size), ())""")
def case_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """Same or cross language, claim's and source's language, pair, booklet, length: one aggregate."""
    g = runs(spark, d).where("arm = 'a'").withColumn("kind", F.when(F.col("claim_lang").eqNullSafe(F.col("lang")), "same").otherwise("cross")).withColumn("pair", F.concat("lang", F.lit("->"), "claim_lang"))
    g = g.withColumn("size", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    keys = ["kind", "claim_lang", "lang", "pair", "source", "size"]
    got = g.groupingSets([[F.col(k)] for k in keys] + [[]], *keys)
    return got.agg(F.grouping_id(*keys).cast("int").alias("level"), F.count(F.lit(1)).alias("n"), metrics.count_if(arms.right()).alias("hits"))


_AGAINST = f"""{RUNS_SQL}, f AS (SELECT r.arm, {{by}}count(*) AS n, count(*) FILTER (WHERE q.label <> r.gold AND r.label = r.gold) AS fixes, count(*) FILTER (WHERE q.label = r.gold AND r.label <> r.gold) AS breaks
FROM r JOIN r AS q ON q.id = r.id AND q.arm = 'a' WHERE r.arm <> 'a' GROUP BY ALL), ks AS (SELECT *, unnest(range(0, fixes + breaks + 1)) AS k FROM f),
ts AS (SELECT *, exp(lgamma(fixes + breaks + 1) - lgamma(k + 1) - lgamma(fixes + breaks - k + 1) - (fixes + breaks) * ln(2)) AS p FROM ks),
ag AS (SELECT arm, {{by}}n, fixes, breaks, least(1.0, 2 * sum(CASE WHEN k >= greatest(fixes, breaks) THEN p ELSE 0 END)) AS two_sided, sum(CASE WHEN k >= fixes THEN p ELSE 0 END) AS one_sided FROM ts GROUP BY ALL)"""


@query(f"WITH {_AGAINST.format(by='')} SELECT arm, n, fixes, breaks, round(two_sided, 6) AS two_sided, round(one_sided, 6) AS one_sided FROM ag")
def against_first(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arms.against(runs(spark, d), "a"), "two_sided", "one_sided")


@query(f"""WITH {RUNS_SQL}, l AS (SELECT r.arm, r.n_chars > 2000 AS is_long, r.claim_lang = r.lang AS same, r.gold <> r.label AS wrong, q.label <> q.gold AND r.label = r.gold AS fix, q.label = q.gold AND r.label <> r.gold AS brk FROM r JOIN r AS q ON q.id = r.id AND q.arm = 'a')
SELECT arm, is_long, same, count(*) AS n, count(*) FILTER (WHERE wrong) AS errors, count(*) FILTER (WHERE fix) AS fixes, count(*) FILTER (WHERE brk) AS breaks FROM l GROUP BY 1, 2, 3""")
def long_short_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of long and short cases, and what each arm fixes and breaks there."""
    r = runs(spark, d)
    first = r.where("arm = 'a'").select("id", F.col("label").alias("before"))
    both = r.join(first, "id").groupBy("arm", (F.col("n_chars") > 2000).alias("is_long"), (F.col("claim_lang") == F.col("lang")).alias("same"))
    return both.agg(F.count(F.lit(1)).alias("n"), metrics.count_if(~arms.right()).alias("errors"), metrics.count_if(~arms.right("before") & arms.right()).alias("fixes"), metrics.count_if(arms.right("before") & ~arms.right()).alias("breaks"))


@query(f"WITH {RUNS_SQL} SELECT x.arm, y.arm AS other, count(*) AS n, count(*) FILTER (WHERE x.label = y.label) AS equal FROM r AS x JOIN r AS y ON x.id = y.id AND x.arm < y.arm GROUP BY 1, 2")
def run_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every two runs side by side."""
    return arms.run_pairs(runs(spark, d))


@query(f"WITH {RUNS_SQL}, h AS (SELECT * FROM r WHERE NOT (arm = 'b' AND id % 7 = 0) AND NOT (arm = 'c' AND id % 11 = 0)) SELECT id FROM h GROUP BY 1 HAVING count(DISTINCT arm) = 3")
def shared_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases that every arm has, where arms b and c have lost some."""
    r = runs(spark, d).where("NOT (arm = 'b' AND id % 7 = 0) AND NOT (arm = 'c' AND id % 11 = 0)")
    return arms.shared_ids(r)


_REPLAY = f"""{RUNS_SQL}, v AS (SELECT id, any_value(gold) AS gold, any_value(lang) AS lang, max(CASE WHEN arm = 'a' THEN label END) AS a, max(CASE WHEN arm = 'b' THEN label END) AS b, max(CASE WHEN arm = 'c' THEN label END) AS c FROM r GROUP BY 1),
y AS (SELECT gold, lang, 'agree' AS rule, CASE WHEN a = b THEN a ELSE 1 END AS pred FROM v UNION ALL SELECT gold, lang, 'side', CASE WHEN a = 1 THEN b ELSE a END FROM v
UNION ALL SELECT gold, lang, 'consistent', CASE WHEN a = 2 - b THEN a ELSE 1 END FROM v UNION ALL SELECT gold, lang, 'majority', CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END FROM v)"""


@query(f"""WITH {_REPLAY}, {_classes_by("SELECT rule, gold, pred FROM y", "rule")}, h AS (SELECT rule, count(*) FILTER (WHERE gold = pred) AS hits FROM y GROUP BY 1)
SELECT rule, round(avg(f1), 6) AS macro_f1, any_value(hits) AS hits FROM k JOIN h USING (rule) GROUP BY 1""")
def replayed_rules(spark: SparkSession, d: str) -> DataFrame:
    """What rules of combination would have made of saved answers."""
    cases = arms.pivoted(runs(spark, d), "abc", "lang")
    return rounded(arms.replay(cases, arms.replayed_rules(F.col("a"), F.col("b"), F.col("c"))), "macro_f1")


@query(f"""WITH {RUNS_SQL}, y AS (SELECT gold, id, label AS pred, 'before' AS rule FROM r WHERE arm = 'a' UNION ALL SELECT gold, id, CASE WHEN label = 1 AND cited = 0 THEN 2 ELSE label END, 'after' FROM r WHERE arm = 'a'),
{_classes_by("SELECT rule, gold, pred FROM y", "rule")}, h AS (SELECT rule, count(*) FILTER (WHERE gold = pred) AS hits FROM y GROUP BY 1) SELECT rule, round(avg(f1), 6) AS macro_f1, any_value(hits) AS hits FROM k JOIN h USING (rule) GROUP BY 1""")
def code_rule_replay(spark: SparkSession, d: str) -> DataFrame:
    """A rule in code over saved answers: neutral with a citation becomes contradiction."""
    a = runs(spark, d).where("arm = 'a'")
    rules = {"before": F.col("label"), "after": F.when((F.col("label") == 1) & (F.col("cited") == 0), 2).otherwise(F.col("label"))}
    return rounded(arms.replay(a, rules), "macro_f1")


_LINES = f"""{_AGAINST.format(by='')}, gr AS (SELECT arm, avg(tokens_in) AS t FROM r GROUP BY 1), fl AS (SELECT x.arm, count(*) FILTER (WHERE x.label <> y.label AND x.id % 50 = 0) AS flips FROM r AS x JOIN r AS y ON y.id = x.id AND y.arm = 'a' GROUP BY 1),
ln AS (SELECT ag.*, gr.t / (SELECT t FROM gr WHERE arm = 'a') - 1 AS growth, flips FROM ag JOIN gr USING (arm) JOIN fl USING (arm))"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    r = runs(spark, d)
    mean = r.groupBy("arm").agg(F.avg("tokens_in").alias("t"))
    base = mean.where("arm = 'a'").select(F.col("t").alias("t0"))
    first = r.where("arm = 'a'").select("id", F.col("label").alias("before"))
    flips = r.join(first, "id").groupBy("arm").agg(metrics.count_if((F.col("label") != F.col("before")) & (F.col("id") % 50 == 0)).alias("flips"))
    return arms.against(r, "a").join(mean, "arm").join(flips, "arm").crossJoin(F.broadcast(base)).withColumn("growth", F.col("t") / F.col("t0") - 1)  # base is one row


@query(f"WITH {_LINES} SELECT arm, fixes > breaks AS gains, one_sided <= 0.10 AS sure, growth <= 0.03 AS cheap, flips <= 2 AS steady, fixes > breaks AND one_sided <= 0.10 AND growth <= 0.03 AND flips <= 2 AS accepted FROM ln")
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Whether an arm may replace the first: gains, significance, tokens, flips."""
    return arms.accepted(_lines(spark, d)).select("arm", "gains", "sure", "cheap", "steady", "accepted")


@query(f"WITH {_LINES} SELECT arm, fixes, breaks, flips, round(growth, 6) AS growth, fixes > breaks AND flips = 0 AND growth <= 0.005 AS accepted FROM ln")
def second_look_rule(spark: SparkSession, d: str) -> DataFrame:
    return rounded(arms.look_accepted(_lines(spark, d)).select("arm", "fixes", "breaks", "flips", "growth", "accepted"), "growth")


@query(f"""WITH {RUNS_SQL}, m AS (SELECT n_chars > 2000 AS is_long, unnest(['full', 'cut', 'half']) AS mode, unnest([n_chars // 4, least(n_chars, 2000) // 4, n_chars // 8]) AS tokens FROM r WHERE arm = 'a'), g AS (SELECT mode, is_long, avg(tokens) AS mean FROM m GROUP BY 1, 2)
SELECT mode, is_long, round(mean, 6) AS mean, round(1 - mean / max(CASE WHEN mode = 'full' THEN mean END) OVER (PARTITION BY is_long), 6) AS saved FROM g""")
def token_savings(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that contexts save against the full text, of long and short cases."""
    n = F.col("n_chars")
    modes = F.array(*(F.struct(F.lit(k).alias("mode"), F.floor(c).alias("tokens")) for k, c in (("full", n / 4), ("cut", F.least(n, F.lit(2000)) / 4), ("half", n / 8))))
    each = runs(spark, d).where("arm = 'a'").select((n > 2000).alias("is_long"), F.explode(modes).alias("x")).select("is_long", "x.mode", "x.tokens")
    return rounded(arms.savings(each, "full", "is_long"), "mean", "saved")


@query(f"""WITH {RUNS_SQL}, dt AS (SELECT *, CAST(substr(source, 4) AS INTEGER) % 4 AS date FROM r WHERE arm = 'a')
SELECT CAST(date AS INTEGER) AS date, CAST(grouping(date) AS INTEGER) AS pooled, count(*) AS n, count(*) FILTER (WHERE gold = label) AS hits, round(avg(tokens_in), 6) AS tokens FROM dt GROUP BY GROUPING SETS ((date), ())""")
def sealed_report(spark: SparkSession, d: str) -> DataFrame:
    """By voting date and pooled."""
    r = runs(spark, d).where("arm = 'a'").withColumn("date", F.substring("source", 4, 9).cast("int") % 4)
    return r.groupingSets([[F.col("date")], []], "date").agg(F.grouping("date").cast("int").alias("pooled"), F.count(F.lit(1)).alias("n"), metrics.count_if(arms.right()).alias("hits"), F.round(F.avg("tokens_in"), 6).alias("tokens"))


@query(f"WITH {RUNS_SQL}, x AS (SELECT id, lang, max(CASE WHEN arm = 'a' THEN label END) AS a, max(CASE WHEN arm = 'b' THEN label END) AS b, any_value(gold) AS gold FROM r GROUP BY 1, 2) SELECT lang, gold || ': ' || a || ' -> ' || b AS pattern, count(*) AS n FROM x GROUP BY 1, 2")
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Gold, first and second run's labels, by language."""
    got = arms.pivoted(runs(spark, d), "ab", "lang")
    return got.groupBy("lang", F.concat_ws("", F.col("gold").cast("string"), F.lit(": "), F.col("a").cast("string"), F.lit(" -> "), F.col("b").cast("string")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS_SQL}, c AS (SELECT arm, backend, unnest(range(0, calls)) AS turn FROM r) SELECT arm, backend, CASE WHEN turn = 0 THEN 'first' ELSE 'follow-up' END AS kind, count(*) AS n FROM c GROUP BY 1, 2, 3""")
def call_identities(spark: SparkSession, d: str) -> DataFrame:
    """Backends over first and follow-up calls."""
    each = runs(spark, d).select("arm", "backend", F.explode(F.sequence(F.lit(0).cast("long"), F.col("calls") - 1)).alias("turn"))
    return each.groupBy("arm", "backend", F.when(F.col("turn") == 0, "first").otherwise("follow-up").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {RUNS_SQL}, dc AS (SELECT arm, source, round(avg(CASE WHEN gold = label THEN 1.0 ELSE 0.0 END), 6) AS value FROM r GROUP BY 1, 2),
de AS (SELECT arm, source, round(value, 2) + CASE WHEN CAST(substr(source, 4) AS INTEGER) % 6 = 1 THEN 0.05 ELSE 0 END AS declared FROM dc)
SELECT arm, source FROM dc JOIN de USING (arm, source) WHERE round(value * 100) <> round(declared * 100)""")
def manifest_mismatches(spark: SparkSession, d: str) -> DataFrame:
    """Declared accuracies of two digits that the recomputed ones don't round to."""
    found = rounded(arms.grouped(runs(spark, d), "arm", "source").select("arm", "source", F.col("accuracy").alias("value")), "value")
    wrong = F.when(F.substring("source", 4, 9).cast("int") % 6 == 1, 0.05).otherwise(0.0)
    declared = found.select("arm", "source", (F.round("value", 2) + wrong).alias("value"), F.lit(2).alias("digits"))
    return arms.mismatches(declared, found, ["arm", "source"]).select("arm", "source")


#: Benchmark texts as gold passages: the documents that hold one are its cases, of which a judge got the first characters.
SENT = 1000
SENT_SQL = f"""{HITS_SQL}, ca AS (SELECT item_id, hit.doc_id, d.lang, d.t, b.t AS gold, substr(d.t, 1, {SENT}) AS sent, length(d.t) AS n FROM hit JOIN d USING (doc_id) JOIN b USING (item_id)),
wi AS (SELECT item_id, unnest(list_filter(list_transform(range(1, length(t) + 1, 30), lambda i: substr(t, i, 60)), lambda w: length(w) = 60)) AS w FROM b)"""


def sent(spark: SparkSession, d: str) -> DataFrame:
    """(item_id, doc_id, lang, t, gold, sent): cases with what was sent of the document."""
    docs = table(spark, d, "documents").select("doc_id", T.evidence_form(F.col("text")).alias("t"))
    items = table(spark, d, "benchmark").select("item_id", T.evidence_form(F.col("text")).alias("gold"))
    return hits(spark, d).join(docs, "doc_id").join(rank.small(items), "item_id").withColumn("sent", F.substring("t", 1, SENT))


@query(f"""WITH {SENT_SQL} SELECT lang, count(*) AS cases, round(avg(CASE WHEN contains(sent, gold) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN contains(sent, substr(gold, 1, 60)) THEN 1.0 ELSE 0.0 END), 6) AS ceiling,
round(CAST(sum(length(sent)) AS DOUBLE) / sum(n), 6) AS share FROM ca GROUP BY 1""")
def hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate, ceiling of evidence and share of characters, by language."""
    got = sent(spark, d)
    yes = lambda c: F.round(F.avg(c.cast("double")), 6)
    return got.groupBy("lang").agg(F.count(F.lit(1)).alias("cases"), yes(F.contains("sent", F.col("gold"))).alias("hit_rate"), yes(F.contains("sent", F.substring("gold", 1, 60))).alias("ceiling"), F.round(F.sum(F.length("sent")).cast("double") / F.sum(F.length("t")), 6).alias("share"))


@query(f"WITH {SENT_SQL} SELECT item_id, doc_id, count(*) AS windows, round(avg(CASE WHEN contains(sent, w) THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM ca JOIN wi USING (item_id) GROUP BY 1, 2")
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of a gold text's windows in what was sent."""
    each = sent(spark, d).select("item_id", "doc_id", "sent", F.explode(segment.windows(F.col("gold"), 60, 30, 60)).alias("w"))
    return each.groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("windows"), F.round(F.avg(F.contains("sent", F.col("w")).cast("double")), 6).alias("coverage"))


_LABELLED = f"JOIN (SELECT doc_id, quality, CASE WHEN {ARM_A} THEN 1 ELSE 0 END AS a FROM labels JOIN documents USING (doc_id)) AS l USING (doc_id)"


@query(f"WITH {SENT_SQL} SELECT CASE WHEN a = quality THEN 'right' WHEN contains(sent, gold) THEN 'reading' ELSE 'search' END AS kind, count(*) AS n FROM ca {_LABELLED} GROUP BY 1")
def search_or_reading(spark: SparkSession, d: str) -> DataFrame:
    """Errors by whether the judge had been given the passage."""
    got = sent(spark, d).join(pairs(spark, d).select("doc_id", "quality", "a"), "doc_id")
    kind = arms.first_reason(("right", F.col("a") == F.col("quality")), ("reading", F.contains("sent", F.col("gold"))), other="search")
    return got.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SENT_SQL} SELECT CASE WHEN contains(sent, gold) THEN 'sent whole' WHEN contains(sent, substr(gold, 1, 60)) THEN 'cut at the end' WHEN n <= {SENT} THEN 'not there' WHEN strpos(t, gold) > {SENT} THEN 'beyond the cut' ELSE 'other' END AS reason, count(*) AS n,
CAST(min(length(gold)) AS INTEGER) AS shortest, CAST(max(length(gold)) AS INTEGER) AS longest FROM ca GROUP BY 1""")
def evidence_losses(spark: SparkSession, d: str) -> DataFrame:
    """Why no item matches: the first of five reasons."""
    reason = arms.first_reason(
        ("sent whole", F.contains("sent", F.col("gold"))), ("cut at the end", F.contains("sent", F.substring("gold", 1, 60))), ("not there", F.length("t") <= SENT), ("beyond the cut", F.locate("x", F.lit("x")).isNotNull() & (F.expr("locate(gold, t)") > SENT)), other="other"
    )
    return sent(spark, d).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.min(F.length("gold")).alias("shortest"), F.max(F.length("gold")).alias("longest"))


@query(f"WITH {SENT_SQL} SELECT item_id, doc_id, contains(sent, gold) AS reached, n > {SENT} AS was_cut, a <> quality AS wrong, CAST(strpos(t, gold) AS INTEGER) AS place FROM ca {_LABELLED} WHERE a <> quality")
def error_dossier(spark: SparkSession, d: str) -> DataFrame:
    """A line for each error: what the judge got and where the passage stands."""
    got = sent(spark, d).join(pairs(spark, d).where("a <> quality").select("doc_id", "quality", "a"), "doc_id")
    return got.select("item_id", "doc_id", F.contains("sent", F.col("gold")).alias("reached"), (F.length("t") > SENT).alias("was_cut"), F.lit(True).alias("wrong"), F.expr("locate(gold, t)").alias("place"))


@query(f"""WITH {PAIRS_SQL}, tg AS (SELECT doc_id, [{", ".join(f"regexp_matches(lower(text), '{r}')" for r in holding(TAGS).values())}] AS has FROM documents),
u AS (SELECT p.*, unnest([{", ".join(f"'{k}'" for k in TAGS)}]) AS tag, unnest(has) AS tagged FROM p JOIN tg USING (doc_id)) SELECT tag, tagged, count(*) AS n, round(avg(CASE WHEN a = gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM u GROUP BY 1, 2""")
def accuracy_by_tag(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy with and without each feature of the text."""
    # Only labelled texts are searched for features, which costs more than to move them.
    has = F.array(*(F.struct(F.lit(k).alias("tag"), F.lower("text").rlike(f"(?U){r}").alias("tagged")) for k, r in TAGS.items()))
    cases = table(spark, d, "documents").select("doc_id", "text").join(rank.small(pairs(spark, d).select("doc_id", "a", "gold")), "doc_id")
    got = cases.select("a", "gold", F.explode(has).alias("x")).select("a", "gold", "x.tag", "x.tagged")
    return got.groupBy("tag", "tagged").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("a") == F.col("gold")).cast("double")), 6).alias("accuracy"))


_RANKS = f"""{BM25_SQL}, ts AS (SELECT item_id, doc_id, CAST(count(*) AS DOUBLE) AS score FROM tf JOIN q USING (term) GROUP BY 1, 2),
ra AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm), rb AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM ts),
{HITS_SQL}"""


def _gold_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(ranker, item_id, r): the best place of a document that holds the item, among each ranker's first eight."""
    rows = ranked(spark, d, bm25=8, terms=8).select("ranker", "item_id", "doc_id", F.col("rank").alias("r"))
    return rows.join(hits(spark, d).select("item_id", "doc_id"), ["item_id", "doc_id"]).groupBy("ranker", "item_id").agg(F.min("r").alias("r"))


@query(f"""WITH {_RANKS}, rk AS (SELECT 'bm25' AS ranker, * FROM ra UNION ALL SELECT 'terms', * FROM rb), g AS (SELECT ranker, item_id, min(r) AS r FROM rk SEMI JOIN hit USING (item_id, doc_id) WHERE r <= 8 GROUP BY 1, 2)
SELECT ranker, count(*) AS in_8, count(*) FILTER (WHERE r <= 4) AS in_4, count(*) FILTER (WHERE r = 1) AS first FROM g GROUP BY 1""")
def ranker_comparison(spark: SparkSession, d: str) -> DataFrame:
    """How often each ranker has a document with the passage among its first eight, four and one."""
    return _gold_ranks(spark, d).groupBy("ranker").agg(F.count(F.lit(1)).alias("in_8"), metrics.count_if(F.col("r") <= 4).alias("in_4"), metrics.count_if(F.col("r") == 1).alias("first"))


@query(f"""WITH {_RANKS}, g AS (SELECT DISTINCT item_id FROM ra SEMI JOIN hit USING (item_id, doc_id) WHERE r <= 8), h AS (SELECT DISTINCT item_id FROM rb SEMI JOIN hit USING (item_id, doc_id) WHERE r <= 8)
SELECT count(*) FILTER (WHERE g.item_id IS NOT NULL AND h.item_id IS NOT NULL) AS both, count(*) FILTER (WHERE g.item_id IS NULL) AS gained, count(*) FILTER (WHERE h.item_id IS NULL) AS lost FROM g FULL JOIN h ON g.item_id = h.item_id""")
def search_text_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Cases that one way to search finds and the other doesn't."""
    got = _gold_ranks(spark, d).groupBy("item_id").agg(F.collect_set("ranker").alias("by"))
    has = lambda k: F.array_contains("by", k)
    return got.agg(metrics.count_if(has("bm25") & has("terms")).alias("both"), metrics.count_if(~has("bm25")).alias("gained"), metrics.count_if(~has("terms")).alias("lost"))


@query(f"""WITH {_RANKS}, x AS (SELECT item_id, list(doc_id) AS a FROM ra WHERE r <= 4 GROUP BY 1), y AS (SELECT item_id, list(doc_id) AS b FROM rb WHERE r <= 4 GROUP BY 1)
SELECT item_id, CAST(len(list_filter(a, lambda v: NOT list_contains(b, v))) AS INTEGER) AS differ FROM x JOIN y USING (item_id)""")
def pick_differences(spark: SparkSession, d: str) -> DataFrame:
    """How many of one selector's four picks the other doesn't make."""
    of = lambda name: F.collect_set(F.when(F.col("ranker") == name, F.col("doc_id")))
    both = ranked(spark, d, bm25=4, terms=4).groupBy("item_id").agg(of("bm25").alias("x"), of("terms").alias("y"))
    return both.select("item_id", F.size(F.array_except("x", "y")).alias("differ"))


_GRID = ", ".join(f"({k}, {m})" for k in (1, 2, 4, 8) for m in (0, 1))


@query(f"""WITH {_RANKS}, s AS (SELECT * FROM (VALUES {_GRID}) AS v(k, m)), z AS (SELECT item_id, count(DISTINCT doc_id) AS held FROM hit GROUP BY 1),
e AS (SELECT k, m, item_id, max(CASE WHEN h.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS found, count(*) AS docs FROM s, (SELECT 0 AS which, * FROM ra UNION ALL SELECT 1, * FROM rb) AS x LEFT JOIN hit AS h USING (item_id, doc_id) WHERE x.r <= k AND which = m AND item_id IN (SELECT item_id FROM z) GROUP BY 1, 2, 3),
g AS (SELECT k, m, avg(CAST(found AS DOUBLE)) AS hit_rate, sum(docs) AS docs FROM e GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, round(hit_rate, 6) AS hit_rate, CAST(docs AS BIGINT) AS docs, hit_rate >= 0.9 AS meets FROM g""")
def retrieval_grid(spark: SparkSession, d: str) -> DataFrame:
    """Hit rate and cost of a grid of settings, and which meet the target."""
    held = hits(spark, d).select("item_id", "doc_id").distinct()
    every = ranked(spark, d, bm25=8, terms=8).select(F.when(F.col("ranker") == "bm25", 0).otherwise(1).alias("m"), "item_id", "doc_id", "rank")
    x = every.join(held.select("item_id").distinct(), "item_id", "left_semi").join(held.withColumn("held", F.lit(1)), ["item_id", "doc_id"], "left")
    x = x.select("m", "item_id", "rank", F.coalesce("held", F.lit(0)).alias("held"), F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))).alias("k")).where("rank <= k")
    g = x.groupBy("k", "m", "item_id").agg(F.max("held").alias("found"), F.count(F.lit(1)).alias("docs")).groupBy("k", "m").agg(F.avg(F.col("found").cast("double")).alias("hit_rate"), F.sum("docs").alias("docs"))
    return g.select("k", "m", F.round("hit_rate", 6).alias("hit_rate"), "docs", (F.col("hit_rate") >= 0.9).alias("meets"))


@query(f"""WITH {_RANKS}, s AS (SELECT * FROM (VALUES {_GRID}) AS v(k, m)), z AS (SELECT DISTINCT item_id FROM hit),
e AS (SELECT k, m, item_id, max(CASE WHEN h.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS found, count(*) AS docs FROM s, (SELECT 0 AS which, * FROM ra UNION ALL SELECT 1, * FROM rb) AS x LEFT JOIN hit AS h USING (item_id, doc_id) WHERE x.r <= k AND which = m AND item_id IN (SELECT item_id FROM z) GROUP BY 1, 2, 3),
g AS (SELECT k, m, round(avg(CAST(found AS DOUBLE)), 6) AS hit_rate, CAST(sum(docs) AS BIGINT) AS docs FROM e GROUP BY 1, 2)
SELECT CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, hit_rate, docs FROM g ORDER BY hit_rate < 0.9, CASE WHEN hit_rate >= 0.9 THEN docs END, hit_rate DESC, docs, k, m LIMIT 1""")
def grid_choice(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest setting that meets the target, else the one with the highest hit rate."""
    g = retrieval_grid(spark, d)
    order = (~F.col("meets"), F.when(F.col("meets"), F.col("docs")), F.desc("hit_rate"), "docs", "k", "m")
    return g.orderBy(*order).limit(1).select("k", "m", "hit_rate", "docs")


@query(f"""WITH {COSINE_SQL}, x AS (SELECT t.query_id, q.label AS a, min_by(c.label, t.r) AS b FROM t JOIN c AS q ON q.vec_id = t.query_id JOIN c ON c.vec_id = t.vec_id WHERE r <= 1 GROUP BY 1, 2)
SELECT a AS rules, b AS model, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY a) AS DOUBLE), 6) AS share FROM x GROUP BY 1, 2""")
def router_agreement(spark: SparkSession, d: str) -> DataFrame:
    """A router by nearest neighbour against the given labels: confusion and shares."""
    got = cosine_best(spark, d, 1).groupBy(F.col("query_label").alias("rules"), F.col("label").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("rules")).cast("double"), 6))


@query("""WITH x AS (SELECT *, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS said FROM pages), y AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]{2})/', 1) AS path, said, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM x)
SELECT unnest(['language', 'title', 'path']) AS field, unnest([avg(CASE WHEN path = said THEN 1.0 ELSE 0.0 END), avg(CASE WHEN title <> '' THEN 1.0 ELSE 0.0 END), avg(CASE WHEN path <> '' THEN 1.0 ELSE 0.0 END)]) AS share FROM y""".replace("unnest([avg", "unnest([round(avg").replace("END), avg", "END), 6), round(avg").replace("END)]) AS share", "END), 6)]) AS share"))
def structure_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Two readings of pages, field by field: how often they agree or are there."""
    p = table(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]{2})/", 1).alias("path"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("said"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    one = p.agg(share(F.col("path") == F.col("said")).alias("language"), share(F.col("title") != "").alias("title"), share(F.col("path") != "").alias("path"))
    return one.unpivot([], ["language", "title", "path"], "field", "share")


@query(f"WITH {PAIRS_SQL}, x AS (SELECT doc_id, a FROM p UNION ALL SELECT doc_id, a FROM p WHERE doc_id % 10 = 0), y AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN b ELSE a END AS a FROM p) SELECT 'gone' AS side, doc_id, a FROM (SELECT * FROM x EXCEPT ALL SELECT * FROM y) UNION ALL SELECT 'new', doc_id, a FROM (SELECT * FROM y EXCEPT ALL SELECT * FROM x)")
def rederived(spark: SparkSession, d: str) -> DataFrame:
    """Answers derived again from what was saved: rows that either side has alone, copies counted."""
    p = pairs(spark, d)
    x = p.select("doc_id", "a").unionAll(p.where("doc_id % 10 = 0").select("doc_id", "a"))
    y = p.select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.col("b")).otherwise(F.col("a")).alias("a"))
    return x.exceptAll(y).select(F.lit("gone").alias("side"), "*").unionAll(y.exceptAll(x).select(F.lit("new").alias("side"), "*"))


@query(f"""WITH {PAIRS_SQL}, a AS (SELECT lang, count(*) FILTER (WHERE gold = a) AS x FROM p GROUP BY 1), b AS (SELECT lang, sum(CASE WHEN gold = a THEN n ELSE 0 END) AS y FROM (SELECT lang, gold, a, count(*) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1)
SELECT lang, x AS one, CAST(y AS BIGINT) AS two, x = y AS same FROM a JOIN b USING (lang)""")
def scorer_check(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to score that must agree: by rows, and by the confusion matrix."""
    p = pairs(spark, d).select("lang", "gold", F.col("a").alias("pred"))
    one = p.groupBy("lang").agg(metrics.count_if(F.col("gold") == F.col("pred")).alias("one"))
    two = metrics.confusion(p, "lang").groupBy("lang").agg(F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).cast("long").alias("two"))
    return one.join(two, "lang").withColumn("same", F.col("one") == F.col("two"))
