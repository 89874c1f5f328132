"""Queries of evaluation: scores, breakdowns, percentiles, tests, intervals, samples, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import intervals, judge, metrics, sample
from quillon.plans.catalog import query, table

#: Two rules that play the arms, on labelled documents: what each says of a document's quality.
ARM_A, ARM_B = "n_chars >= 1000", "n_chars >= 600 AND n_chars % 7 <> 0"
PAIRS_SQL = f"""p AS (SELECT doc_id, lang, source, quality AS gold, CASE WHEN n_chars < 20 THEN NULL WHEN {ARM_A} THEN 1 ELSE 0 END AS pred,
CASE WHEN {ARM_A} THEN 1 ELSE 0 END AS a, CASE WHEN {ARM_B} THEN 1 ELSE 0 END AS b, n_chars FROM labels JOIN documents USING (doc_id))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = table(spark, d, "labels").join(docs, "doc_id").withColumn("gold", F.col("quality"))
    a, b = F.expr(f"CASE WHEN {ARM_A} THEN 1 ELSE 0 END"), F.expr(f"CASE WHEN {ARM_B} THEN 1 ELSE 0 END")
    return rows.withColumn("pred", F.when(F.col("n_chars") >= 20, a)).withColumn("a", a).withColumn("b", b)


def _classes(by: str = "") -> str:
    """Class scores in SQL, grouped by the given columns."""
    g, on = (f"{by}, ", f"{by}, ") if by else ("", "")
    return f"""n AS (SELECT {g}gold, pred, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT {g}gold AS class, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN gold IS DISTINCT FROM pred THEN n ELSE 0 END AS fn FROM n
  UNION ALL SELECT {g}pred, 0, CASE WHEN gold <> pred THEN n ELSE 0 END, 0 FROM n WHERE pred IS NOT NULL),
c AS (SELECT {on}CAST(class AS VARCHAR) AS class, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY ALL),
f AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall FROM c),
k AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM f)"""


@query(f"WITH {PAIRS_SQL} SELECT CAST(gold AS VARCHAR) AS gold, coalesce(CAST(pred AS VARCHAR), 'invalid') AS pred, count(*) AS n FROM p GROUP BY 1, 2")
def confusion(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confusion(pairs(spark, d))


@query(f"WITH {PAIRS_SQL}, {_classes()} SELECT class, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    got = metrics.class_scores(pairs(spark, d))
    return got.select("class", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {PAIRS_SQL}, {_classes()} SELECT round(avg(f1), 6) AS macro_f1 FROM k")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(pairs(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT unnest([0, 1, 2]) AS class),
x AS (SELECT class, count(*) FILTER (WHERE gold = class AND pred = class) AS tp, count(*) FILTER (WHERE gold = class) + count(*) FILTER (WHERE pred = class) AS n FROM p, c GROUP BY 1)
SELECT round(sum(CASE WHEN n = 0 THEN 0.0 ELSE 2.0 * tp / n END) / 3, 6) AS macro_f1 FROM x""")
def macro_f1_fixed3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1_fixed(pairs(spark, d)).select(F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""WITH {PAIRS_SQL} SELECT lang, source, CAST(grouping(lang, source) AS INTEGER) AS level, count(*) AS n, count(*) FILTER (WHERE gold = pred) AS hits,
round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY GROUPING SETS ((lang, source), (lang), (source), ())""")
def breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy by language, by source, by both and over all, in one aggregate."""
    hit = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    sets = [[F.col("lang"), F.col("source")], [F.col("lang")], [F.col("source")], []]
    got = pairs(spark, d).withColumn("hit", hit).groupingSets(sets, "lang", "source")
    return got.agg(F.grouping_id("lang", "source").cast("int").alias("level"), F.count(F.lit(1)).alias("n"), metrics.count_if(F.col("hit")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("accuracy"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def p95_nearest(spark: SparkSession, d: str) -> DataFrame:
    return metrics.nearest_rank(table(spark, d, "events"), "event_type", "value", 95, "p95")


_AT = "SELECT event_type, list_sort(list(value))[CAST({i} AS INTEGER) + 1] AS {name} FROM events GROUP BY 1"


@query(_AT.format(i="least(count(*) - 1, floor(0.95 * count(*)))", name="p95"))
def p95_index(spark: SparkSession, d: str) -> DataFrame:
    return metrics.at_index(table(spark, d, "events"), "event_type", "value", F.least(F.col("n") - 1, F.floor(0.95 * F.col("n"))), "p95")


@query(_AT.format(i="floor(count(*) / 2.0)", name="upper_median"))
def upper_median(spark: SparkSession, d: str) -> DataFrame:
    return metrics.at_index(table(spark, d, "events"), "event_type", "value", F.floor(F.col("n") / 2), "upper_median")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS lowest, max(l_quantity) AS highest,
quantile_disc(l_quantity, 0.95) AS p95, round(median(l_quantity), 6) AS median FROM lineitem GROUP BY 1, 2""")
def describe(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(q), 6).alias("mean"), F.min(q).alias("lowest"), F.max(q).alias("highest"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY l_quantity)").cast("double").alias("p95"), F.round(F.median(q), 6).alias("median"),
    )


FLIPS_SQL = f"{PAIRS_SQL}, f AS (SELECT lang, count(*) FILTER (WHERE a <> gold AND b = gold) AS fixes, count(*) FILTER (WHERE a = gold AND b <> gold) AS breaks FROM p GROUP BY 1)"


def flips(spark: SparkSession, d: str) -> DataFrame:
    right = lambda c: F.col(c) == F.col("gold")
    return pairs(spark, d).groupBy("lang").agg(metrics.count_if(~right("a") & right("b")).alias("fixes"), metrics.count_if(right("a") & ~right("b")).alias("breaks"))


@query(f"WITH {FLIPS_SQL} SELECT lang, fixes, breaks FROM f")
def fix_break(spark: SparkSession, d: str) -> DataFrame:
    return flips(spark, d)


@query(f"""WITH {FLIPS_SQL}, k AS (SELECT lang, fixes, breaks, unnest(range(0, fixes + breaks + 1)) AS k FROM f),
t AS (SELECT *, exp(lgamma(fixes + breaks + 1) - lgamma(k + 1) - lgamma(fixes + breaks - k + 1) - (fixes + breaks) * ln(2)) AS p FROM k)
SELECT lang, round(least(1.0, 2 * sum(CASE WHEN k >= greatest(fixes, breaks) THEN p ELSE 0 END)), 6) AS two_sided, round(sum(CASE WHEN k >= fixes THEN p ELSE 0 END), 6) AS one_sided FROM t GROUP BY 1""")
def sign_test(spark: SparkSession, d: str) -> DataFrame:
    two, one = metrics.sign_test(F.col("fixes"), F.col("breaks"))
    return flips(spark, d).select("lang", F.round(two, 6).alias("two_sided"), F.round(one, 6).alias("one_sided"))


@query(f"WITH {PAIRS_SQL} SELECT gold, a, b, count(*) AS n FROM p WHERE a <> b GROUP BY 1, 2, 3")
def transitions(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).where("a <> b").groupBy("gold", "a", "b").agg(F.count(F.lit(1)).alias("n"))


ROUNDS = 2000


@query(f"""WITH {PAIRS_SQL}, cl AS (SELECT CAST(gold AS VARCHAR) AS gold, coalesce(CAST(pred AS VARCHAR), 'invalid') AS pred, count(*) AS n FROM p GROUP BY 1, 2),
ce AS (SELECT gold, pred, sum(n) OVER (ORDER BY gold, pred) AS hi, sum(n) OVER (ORDER BY gold, pred) - n AS lo FROM cl), n AS (SELECT count(*) AS n FROM p),
i AS (SELECT id % {ROUNDS} AS round, id // {ROUNDS} AS quad FROM (SELECT unnest(range(0, CAST(ceil(n / 4.0) AS BIGINT) * {ROUNDS})) AS id FROM n)), h AS (SELECT round, quad, md5('42:' || round || ':' || quad) AS h FROM i),
dr AS (SELECT round, CAST('0x' || substr(h, 1 + 8 * CAST(j AS INTEGER), 8) AS BIGINT) % n AS x FROM h, n, (SELECT unnest(range(0, 4)) AS j) WHERE quad * 4 + j < n), xs AS (SELECT round, x, count(*) AS c FROM dr GROUP BY 1, 2),
ct AS (SELECT round, gold, pred, CAST(sum(c) AS BIGINT) AS n FROM xs JOIN ce ON x >= lo AND x < hi GROUP BY 1, 2, 3),
s AS (SELECT round, gold AS class, CASE WHEN gold = pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN gold <> pred THEN n ELSE 0 END AS fn FROM ct UNION ALL SELECT round, pred, 0, CASE WHEN gold <> pred THEN n ELSE 0 END, 0 FROM ct WHERE pred <> 'invalid'),
f AS (SELECT round, class, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM s GROUP BY 1, 2), m AS (SELECT round, avg(CASE WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) AS m FROM f GROUP BY 1),
o AS (SELECT m, row_number() OVER (ORDER BY m, round) - 1 AS k FROM m)
SELECT round(max(CASE WHEN k = {int(0.025 * ROUNDS)} THEN m END), 6) AS low, round(max(CASE WHEN k = {int(0.975 * ROUNDS) - 1} THEN m END), 6) AS high FROM o""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """The 95 % interval of Macro-F1 over 2,000 resamples."""
    return metrics.bootstrap(pairs(spark, d).select("gold", "pred"), ROUNDS).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


SCORES = [(0.977, 0.990, 0.9, 0.8, 0.987, 0.7, 1.0), (0.5, 0.9, 1.0, 1.0, 0.99, 1.0, 1.0), (0.9, 0.0, 0.0, 0.5, 0.76, 0.2, 0.1)]


@query("SELECT i, round(CASE WHEN fa < 0.6 OR fb < 0.75 THEN 0.0 ELSE 0.6 * (0.5 * fa + 0.2 * ev + 0.15 * ta + 0.15 * ka) + 0.4 * (0.7 * fb + 0.15 * tb + 0.15 * kb) END, 6) AS score FROM (VALUES " + ", ".join("(" + ", ".join([str(i), *(f"CAST({x} AS DOUBLE)" for x in r)]) + ")" for i, r in enumerate(SCORES)) + ") AS v(i, fa, ev, ta, ka, fb, tb, kb)")
def official_score(spark: SparkSession, d: str) -> DataFrame:
    names = ["i", "fa", "ev", "ta", "ka", "fb", "tb", "kb"]
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(SCORES)], "i int, " + ", ".join(f"{n} double" for n in names[1:]))
    return rows.select("i", F.round(metrics.official_score(*(F.col(n) for n in names[1:])), 6).alias("score"))


@query("""SELECT lang, count(*) AS n, count(DISTINCT text) AS texts, count(*) - count(DISTINCT text) AS repeats, count(DISTINCT source) AS sources, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY 1""")
def profile(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "documents").select("lang", "source", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("h"))
    return one.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("h").alias("texts"), (F.count(F.lit(1)) - F.countDistinct("h")).alias("repeats"), F.countDistinct("source").alias("sources"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT lang, count(*) FILTER (WHERE quality = 0) AS q0, count(*) FILTER (WHERE quality = 1) AS q1, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(metrics.count_if(F.col("quality") == 0).alias("q0"), metrics.count_if(F.col("quality") == 1).alias("q1"), metrics.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT min(doc_id) AS first, count(DISTINCT source) AS sources, count(DISTINCT lang) AS langs FROM documents GROUP BY text HAVING count(DISTINCT source) > 1 OR count(DISTINCT lang) > 1")
def conflicts(spark: SparkSession, d: str) -> DataFrame:
    same = table(spark, d, "documents").groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.min("doc_id").alias("first"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("langs"))
    return same.where("sources > 1 OR langs > 1").drop("h")


SPANS_SQL = "sp AS (SELECT user_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(abs(value) * 60) AS BIGINT) * 1000000 AS e FROM events)"


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests in flight for |value| minutes: (user_id, event_type, s, e) in microseconds."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select("user_id", "event_type", start.alias("s"), (start + F.floor(F.abs("value") * 60) * 1000000).alias("e"))


ISLANDS_SQL = f"""{SPANS_SQL}, o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
WHEN lag(s) OVER (PARTITION BY user_id ORDER BY s, e) IS NULL THEN 1 ELSE 0 END AS opens FROM sp WHERE s < e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM o), il AS (SELECT user_id, min(s) AS s, max(e) AS e FROM g GROUP BY user_id, i)"""


@query(f"WITH {ISLANDS_SQL} SELECT user_id, CAST(sum(e - s) AS BIGINT) AS covered, count(*) AS islands FROM il GROUP BY 1")
def interval_union(spark: SparkSession, d: str) -> DataFrame:
    return intervals.union_length(spans(spark, d), "user_id")


@query(f"WITH {ISLANDS_SQL}, x AS (SELECT user_id, lag(e) OVER (PARTITION BY user_id ORDER BY s) AS s, s AS e FROM il) SELECT user_id, s, e FROM x WHERE s IS NOT NULL")
def gaps(spark: SparkSession, d: str) -> DataFrame:
    return intervals.gaps(spans(spark, d), "user_id")


@query(f"""WITH {SPANS_SQL}, x AS (SELECT user_id, s AS t, 1 AS d FROM sp UNION ALL SELECT user_id, e, -1 FROM sp), y AS (SELECT user_id, sum(d) OVER (PARTITION BY user_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM x)
SELECT user_id, CAST(max(open) AS BIGINT) AS most FROM y GROUP BY 1""")
def max_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return intervals.max_concurrency(spans(spark, d), "user_id")


@query("""WITH x AS (SELECT user_id, epoch_us(ts) AS t FROM events), y AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 86400000000 THEN 0 ELSE 1 END AS opens FROM x),
z AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY t) AS i FROM y) SELECT user_id, min(t) AS s, max(t) AS e, count(*) AS n FROM z GROUP BY user_id, i""")
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with a day between neighbours at most."""
    return intervals.sessions(spans(spark, d), "user_id", "s", 86400000000)


@query(f"WITH {ISLANDS_SQL}, c AS (SELECT user_id, sum(e - s) AS busy FROM il GROUP BY 1), w AS (SELECT user_id, max(e) - min(s) AS wall FROM sp GROUP BY 1) SELECT user_id, CAST(wall AS BIGINT) AS wall, CAST(wall - coalesce(busy, 0) AS BIGINT) AS local FROM w LEFT JOIN c USING (user_id)")
def local_time(spark: SparkSession, d: str) -> DataFrame:
    """Wall time less the time in flight."""
    wall = spans(spark, d).groupBy("user_id").agg((F.max("e") - F.min("s")).alias("wall"))
    busy = intervals.union_length(spans(spark, d), "user_id")
    return wall.join(busy, "user_id", "left").select("user_id", "wall", (F.col("wall") - F.coalesce("covered", F.lit(0))).alias("local"))


@query(f"""WITH {ISLANDS_SQL}, w AS (SELECT user_id, min(s) - 1000000 AS lo, max(e) + 500000 AS hi FROM sp GROUP BY 1), gp AS (SELECT user_id, s - lag(e) OVER (PARTITION BY user_id ORDER BY s) AS gap FROM il),
x AS (SELECT user_id, count(gap) AS gaps, max(gap) AS longest, quantile_disc(gap, 0.95) AS p95 FROM gp GROUP BY 1), y AS (SELECT user_id, sum(e - s) AS busy, min(s) AS first, max(e) AS last FROM il GROUP BY 1)
SELECT user_id, CAST(first - lo AS BIGINT) AS to_first, CAST(hi - last AS BIGINT) AS tail, gaps, longest, p95, CAST(hi - lo - busy AS BIGINT) AS local FROM w JOIN y USING (user_id) JOIN x USING (user_id)""")
def local_time_parts(spark: SparkSession, d: str) -> DataFrame:
    """Where local time goes: before the first request, between requests, after the last, in a run's bounds."""
    sp = spans(spark, d)
    bounds = sp.groupBy("user_id").agg((F.min("s") - 1000000).alias("lo"), (F.max("e") + 500000).alias("hi"))
    inside = intervals.clipped(sp.join(bounds, "user_id"), F.col("lo"), F.col("hi")).select("user_id", "s", "e")
    il = intervals.islands(inside, "user_id")
    busy = il.groupBy("user_id").agg(F.sum(F.col("e") - F.col("s")).alias("busy"), F.min("s").alias("first"), F.max("e").alias("last"))
    gap = intervals.gaps(inside, "user_id").withColumn("gap", F.col("e") - F.col("s"))
    gap = gap.groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap").alias("longest"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY gap)").cast("long").alias("p95"))
    got = bounds.join(busy, "user_id").join(gap, "user_id", "left")
    return got.select("user_id", (F.col("first") - F.col("lo")).alias("to_first"), (F.col("hi") - F.col("last")).alias("tail"), F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "longest", "p95", (F.col("hi") - F.col("lo") - F.col("busy")).alias("local"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def phase_totals(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(regexp_extract(props, ':\\s*(-?\\d+)', 1) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1")
def json_props_agg(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("total"))


@query("""WITH x AS (SELECT doc_id, lang, source, md5('42:' || doc_id) AS h FROM labels JOIN documents USING (doc_id)), y AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS turn FROM x)
SELECT doc_id, lang, source, CAST(turn AS INTEGER) AS turn FROM y ORDER BY turn, lang, source LIMIT 100""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    return sample.stratified(rows, ["lang", "source"], "doc_id", 100).select("doc_id", "lang", "source", "turn")


@query("WITH g AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY md5('42:' || source), source LIMIT 5) SELECT doc_id, source, source IN (SELECT source FROM g) AS held FROM documents")
def group_holdout(spark: SparkSession, d: str) -> DataFrame:
    return sample.holdout(table(spark, d, "documents").select("doc_id", "source"), "source", 5).select("doc_id", "source", "held")


@query("SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS r FROM labels) WHERE r <= 20")
def per_label_sample(spark: SparkSession, d: str) -> DataFrame:
    return sample.per_label(table(spark, d, "labels"), "quality", "doc_id", 20).select("doc_id", "quality")


@query("""SELECT item_id, CAST(item_id % 7 AS INTEGER) AS variant, CASE item_id % 7 WHEN 0 THEN lower(text) WHEN 1 THEN upper(replace(text, 'ß', 'ss')) WHEN 2 THEN '- ' || text WHEN 3 THEN replace(text, ' ', '  ')
WHEN 4 THEN replace(text, ' ', chr(160)) WHEN 5 THEN replace(text, ' ', chr(10)) ELSE '«' || text || '»' END AS text FROM benchmark""")
def perturbed_claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 7).cast("int").alias("variant"), sample.perturbed(F.col("text"), F.col("item_id")).alias("text"))


GRID = {"scorer": ["bm25", "terms"], "scope": ["booklet", "section"], "k": [4, 8, 12], "neighbours": [0, 1], "rule": ["same", "double", "section"]}
_VALUES = ", ".join(f"(SELECT unnest([{', '.join(repr(x) if isinstance(x, str) else f'CAST({x} AS INTEGER)' for x in v)}]) AS {k}) AS x_{k}" for k, v in GRID.items())


@query(f"SELECT scorer, scope, k, neighbours, rule, count(*) AS claims FROM {_VALUES}, benchmark WHERE length(text) <= 50 * k GROUP BY ALL")
def settings_grid(spark: SparkSession, d: str) -> DataFrame:
    """All 72 settings of a search, with the claims that are short enough for so many chunks."""
    lengths = table(spark, d, "benchmark").groupBy(F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    got = sample.grid(spark, **GRID).join(F.broadcast(lengths), F.col("n") <= 50 * F.col("k"))  # a row for each length
    return got.groupBy(*GRID).agg(F.sum("c").alias("claims"))


@query("""WITH c AS (SELECT unnest(range(0, 12)) AS c), p AS (SELECT unnest(range(0, 4)) AS p)
SELECT CAST(c AS INTEGER) AS case_no, CAST(p AS INTEGER) AS place, CAST((CASE WHEN p % 2 = 1 THEN (p + 1) // 2 ELSE (4 - p // 2) % 4 END + c) % 4 AS INTEGER) AS arm FROM c, p""")
def arm_order(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(12).select(F.col("id").cast("int").alias("case_no"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("place"))
    return rows.withColumn("arm", intervals.arm_order(F.col("case_no"), F.col("place"), 4).cast("int"))


@query("""WITH q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT text AS request, min_by(answer, conv_id) AS answer FROM (
SELECT x.text, y.text AS answer, x.conv_id FROM q AS x JOIN conversations AS y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE x.conv_id % 2 = 0) GROUP BY 1)
SELECT conv_id, turn, answer IS NOT NULL AS replayed, md5(coalesce(answer, '{"label":1}')) AS answer_md5 FROM q LEFT JOIN a ON request = text""")
def replay_join(spark: SparkSession, d: str) -> DataFrame:
    """Questions answered from saved answers (those of even conversations) by the request's hash."""
    talk = table(spark, d, "conversations")
    asked = talk.where("role = 'user'").select("conv_id", "turn", judge.request_hash(text=F.col("text")).alias("request"))
    said = talk.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    saved = asked.where("conv_id % 2 = 0").join(said, ["conv_id", "turn"]).select("request", "answer", F.col("conv_id").alias("order"))
    return judge.ReplayJudge(saved).ask(asked).select("conv_id", "turn", "replayed", F.md5(F.encode("answer", "UTF-8")).alias("answer_md5"))


ANSWERS = (
    '{"label":0}', '{"label": 2, "pages": [1]}', '```json\n{"label":1}\n```', "The label is 2.", "label: 0 or label: 1", '{"label":true}', '{"label":"contradiction"}', "", "nothing", '{"label":7}', 'x {"a":{"label":0},"label":1} y',
)


@query("SELECT i, coalesce(label, -1) AS label FROM (VALUES (0, 0), (1, 2), (2, 1), (3, 2), (4, NULL), (5, NULL), (6, 2), (7, NULL), (8, NULL), (9, NULL), (10, 1)) AS v(i, label)")
def answer_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(ANSWERS)), "i int, answer string")
    return rows.select("i", F.coalesce(judge.parsed(F.col("answer")), F.lit(-1)).alias("label"))


COMBINED = [(0, 0, 1), (0, 2, 1), (1, 0, 2), (1, 1, 0), (2, 2, 2)]


@query("SELECT a, b, c, CASE WHEN a = b THEN a ELSE c END AS tournament, CASE WHEN a = 1 THEN 2 - b ELSE a END AS negated, CASE WHEN 2 IN (a, b, c) THEN 2 WHEN a = 0 AND b = 0 AND c = 0 THEN 0 ELSE 1 END AS parts FROM (VALUES " + ", ".join(map(str, COMBINED)) + ") AS v(a, b, c)")
def combined_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(COMBINED, "a int, b int, c int")
    a, b, c = map(F.col, "abc")
    return rows.select("a", "b", "c", judge.tournament(a, b, c).alias("tournament"), judge.negated(a, b).alias("negated"), judge.parts_combined(F.array(a, b, c)).alias("parts"))


@query(f"""WITH {PAIRS_SQL}, x AS (SELECT doc_id, gold, CASE WHEN n_chars > 8000 THEN 1 ELSE a END AS first, b FROM p), y AS (SELECT gold, CASE WHEN first = 1 AND b = 0 THEN b ELSE first END AS label FROM x)
SELECT gold, label, count(*) AS n FROM y GROUP BY 1, 2""")
def second_look(spark: SparkSession, d: str) -> DataFrame:
    """A stub judge asked again where the first answer was neutral and the second rule disagrees."""
    rows = pairs(spark, d).withColumn("id", F.col("doc_id"))
    first = judge.StubJudge(F.when(F.col("n_chars") > 8000, 1).otherwise(F.col("a"))).ask(rows).withColumn("label", judge.parsed(F.col("answer")))
    got = judge.second_look(first, (F.col("label") == 1) & (F.col("b") == 0), judge.StubJudge(F.col("b")))
    return got.groupBy("gold", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT role, form, count(*) AS n FROM (SELECT role, CASE WHEN text IS NULL OR trim(text) = '' THEN 'none' WHEN regexp_matches(text, '\\{[^{}]*\\}') THEN 'with text' ELSE 'other' END AS form FROM conversations) GROUP BY 1, 2")
def answer_forms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role", judge.answer_form(F.col("text")).alias("form")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT DISTINCT user_id, event_type, props FROM events), y AS (SELECT user_id, count(DISTINCT event_type) AS types, count(DISTINCT props) AS props FROM x GROUP BY 1) SELECT user_id, types, props FROM y WHERE types > 1""")
def identity_report(spark: SparkSession, d: str) -> DataFrame:
    """Users whose fields took more than one value."""
    got = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("types"), F.countDistinct("props").alias("props"))
    return got.where("types > 1")


@query(f"WITH {PAIRS_SQL}, s AS (SELECT source, avg(CASE WHEN a = gold THEN 1.0 ELSE 0.0 END) AS x FROM p GROUP BY 1) SELECT round(min(x), 6) AS lowest, round(max(x), 6) AS highest, round(max(x) - min(x), 6) AS spread FROM s")
def stability(spark: SparkSession, d: str) -> DataFrame:
    by = pairs(spark, d).groupBy("source").agg(F.avg((F.col("a") == F.col("gold")).cast("double")).alias("x"))
    return by.agg(F.round(F.min("x"), 6).alias("lowest"), F.round(F.max("x"), 6).alias("highest"), F.round(F.max("x") - F.min("x"), 6).alias("spread"))
