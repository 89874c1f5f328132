"""Queries over booklets: their structure, boxes and paragraphs, votes by name, coverage of the parser.

The tables hold no booklets, so each source becomes one: its documents are the bodies of the pages,
under headings and contents lines in one of two layouts, with faults planted by the source's number.
The SQL says what a parser must find in booklets made so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.functions.text import STOPWORDS, language
from quillon.operators import booklet
from quillon.operators.settled import settle
from quillon.plans.catalog import query, table
from quillon.plans.documents import PARAGRAPH_SQL

#: Headings by page, in the newer layout and in the older one; pages of a booklet.
NEW = {
    1: "Volksabstimmung", 4: "In Kürze", 6: "In Kürze", 8: "Im Detail\nÜber den {k}. Titel\nArgumente Initiativkomitee 1 2\nArgumente Bundesrat und Parlament 14",
    12: "Argumente des Initiativkomitees", 14: "Argumente Bundesrat und Parlament", 16: "Abstimmungstext", 18: "Im Detail\nNoch ein {k}. Titel\nArgumente Referendumskomitee 22\nArgumente Bundesrat 24",
    22: "Argumente des Referendumskomitees", 24: "Argumente Bundesrat", 26: "Abstimmungstext",
}
OLD = {
    1: "Volksabstimmung", 5: "Das Wichtigste in Kürze", 6: "Die Vorlage im Detail", 8: "Die Argumente des Initiativkomitees", 9: "Die Argumente des Bundesrates", 10: "Abstimmungstext",
    12: "Das Wichtigste in Kürze", 14: "Die Vorlage im Detail", 16: "Die Argumente des Bundesrates", 20: "Abstimmungstext",
}
NEW_CONTENTS = "Erste Vorlage\nKlimagesetz Nummer {k}\nIn Kürze 4-5\nIm Detail 8\nArgumente 1 2\nAbstimmungstext 16\nZweite Vorlage\nSteuerreform Nummer {k}\nIn Kürze 6-7\nIm Detail 18\n{args}Abstimmungstext 26"
OLD_CONTENTS = "Klimagesetz Nummer {k}\nInformationen zur Vorlage Seiten 4–11\nDer Abstimmungstext Seite 10\nSteuerreform Nummer {k}\nInformationen zur Vor lage Sei ten 12–19\nDer Abstimmungstext Seiten 20–21"
BOXES = "Ja\nDer Bundesrat und das Parlament empfehlen, die Vorlage anzunehmen, weil sie nützt.\nwww.admin.ch/vorlage\nNein\nDas Komitee lehnt die Vorlage ab, denn sie kostet alle zu viel.\n107 Ja\n88 Nein"
LAST = 30

SRC_SQL = "src AS (SELECT source, CAST(substr(source, 4) AS INTEGER) AS k, CAST(substr(source, 4) AS INTEGER) % 4 = 3 AS old FROM (SELECT DISTINCT source FROM documents))"
#: (old layout, vote, part, first page, last page); what faults take away is left out below.
SPANS = [
    (False, 1, "summary", 4, 5), (False, 1, "detail", 8, 11), (False, 1, "committee", 12, 13), (False, 1, "council", 14, 15), (False, 1, "law", 16, 17),
    (False, 2, "summary", 6, 7), (False, 2, "detail", 18, 21), (False, 2, "committee", 22, 23), (False, 2, "council", 24, 25), (False, 2, "law", 26, 29),
    (True, 1, "summary", 4, 5), (True, 1, "detail", 6, 7), (True, 1, "committee", 8, 8), (True, 1, "council", 9, 9), (True, 1, "law", 10, 10),
    (True, 2, "summary", 12, 13), (True, 2, "detail", 14, 15), (True, 2, "council", 16, 19), (True, 2, "law", 20, 21),
]
PARTS_SQL = f"""{SRC_SQL}, sp AS (SELECT * FROM (VALUES {", ".join(map(str, SPANS))}) AS v(o, vote_no, part, lo, hi)),
pt AS (SELECT source, k, old, vote_no, part, lo, hi FROM src JOIN sp ON o = old WHERE NOT (NOT old AND k % 7 = 0 AND vote_no = 1 AND part = 'law'))"""


_known: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, d: str, name: str, make) -> DataFrame:
    """What is made once for a session and a folder of tables: pages, votes and boxes are settled results."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _known:
        _known[key] = settle(make())
    return _known[key]


def votes(spark: SparkSession, d: str) -> DataFrame:
    """The booklets' votes."""
    return _once(spark, d, "votes", lambda: booklet.parse(pages(spark, d)))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "boxes", lambda: booklet.boxes(pages(spark, d), votes(spark, d)))


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(doc, page, text): the booklets."""
    return _once(spark, d, "pages", lambda: _pages(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    order = Window.partitionBy("source").orderBy("doc_id")
    body = docs.select("source", F.row_number().over(order).alias("page"), "text").where(F.col("page") <= LAST)
    k = F.substring("source", 4, 9).cast("int")
    every = docs.select("source").distinct().select("source", F.explode(F.sequence(F.lit(1), F.lit(LAST))).alias("page"))
    lookup = lambda heads: F.coalesce(F.try_element_at(F.create_map(*(x for p, h in heads.items() for x in (F.lit(p), F.lit(h)))), F.col("page")), F.lit(""))
    contents = F.replace(F.lit(NEW_CONTENTS), F.lit("{args}"), F.when(k % 5 == 0, "").otherwise("Argumente 22\n"))
    new = F.when(F.col("page") == 2, contents).when((F.col("page") == 16) & (k % 7 == 0), "").otherwise(lookup(NEW))
    old = F.when(F.col("page") == 2, F.lit(OLD_CONTENTS)).otherwise(lookup(OLD))
    head = F.replace(F.when(k % 4 == 3, old).otherwise(new), F.lit("{k}"), k.cast("string"))
    got = every.join(body, ["source", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.when((F.col("page") == 5) & (k % 4 != 3), F.concat("text", F.lit("\n" + BOXES))).when(F.col("page") == 2, head).when((F.col("page") == 1) & (k % 4 == 3), "").otherwise(F.concat(head, F.lit("\n"), "text"))
    return got.select(F.col("source").alias("doc"), "page", text.alias("text"))


@query(f"WITH {PARTS_SQL} SELECT source, CASE WHEN old THEN 'old' ELSE 'new' END AS layout, CAST(vote_no AS INTEGER) AS vote_no, part, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS page FROM pt")
def booklet_parts(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each part of each vote, in both layouts."""
    got = votes(spark, d).select("doc", "layout", "vote_no", F.explode("parts").alias("part", "on"))
    return got.select(F.col("doc").alias("source"), "layout", "vote_no", "part", F.explode("on").alias("page"))


@query(f"WITH {PARTS_SQL} SELECT source, CAST(vote_no AS INTEGER) AS vote_no, part, CAST(min(lo) AS INTEGER) AS first, CAST(max(hi) AS INTEGER) AS last FROM pt WHERE old GROUP BY 1, 2, 3")
def old_layout(spark: SparkSession, d: str) -> DataFrame:
    """The older layout alone: legal texts within a vote's pages and beyond them."""
    found = booklet.old_layout(pages(spark, d)).select("doc", "vote_no", F.explode("parts").alias("part", "on"))
    return found.select(F.col("doc").alias("source"), "vote_no", "part", F.array_min("on").alias("first"), F.array_max("on").alias("last"))


@query(f"""WITH {PARTS_SQL}, w AS (SELECT source, k, old, CAST(v AS INTEGER) AS vote_no FROM src, (VALUES (1), (2)) AS x(v))
SELECT source, vote_no, CASE WHEN old THEN '' WHEN vote_no = 1 THEN 'Erste Vorlage ' ELSE 'Zweite Vorlage ' END || CASE WHEN vote_no = 1 THEN 'Klimagesetz' ELSE 'Steuerreform' END || ' Nummer ' || k AS title,
CASE WHEN NOT old AND k % 7 = 0 AND vote_no = 1 THEN 'committee,council,detail,parliament,summary' ELSE 'committee,council,detail,law,parliament,summary' END AS valid,
CASE WHEN old THEN '' WHEN k % 7 = 0 AND vote_no = 1 THEN 'no law heading on page 16' WHEN k % 5 = 0 AND vote_no = 2 THEN 'contents entry without arguments' ELSE '' END AS problems FROM w""")
def booklet_votes(spark: SparkSession, d: str) -> DataFrame:
    """Votes with their titles, which parts hold and what is wrong with the others."""
    got = votes(spark, d)
    return got.select(F.col("doc").alias("source"), "vote_no", "title", F.array_join("valid", ",").alias("valid"), F.array_join("problems", "; ").alias("problems"))


@query(f"""WITH {SRC_SQL}, b AS (SELECT * FROM (VALUES ('council', 'Ja{chr(10)}Der Bundesrat und das Parlament empfehlen, die Vorlage anzunehmen, weil sie nützt.'),
('committee', 'Nein{chr(10)}Das Komitee lehnt die Vorlage ab, denn sie kostet alle zu viel.{chr(10)}107 Ja{chr(10)}88 Nein'), ('parliament', '107 Ja{chr(10)}88 Nein')) AS v(voice, text))
SELECT source, CAST(1 AS INTEGER) AS vote_no, voice, CAST(5 AS INTEGER) AS page, text FROM src, b WHERE NOT old""")
def booklet_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Recommendation boxes by who speaks."""
    return boxes(spark, d).select(F.col("doc").alias("source"), "vote_no", "voice", "page", "text")


_BODY = f"""hd AS (SELECT * FROM (VALUES {", ".join(f"({o}, {p}, '{h}')" for o, heads in ((False, NEW), (True, OLD)) for p, h in heads.items())}) AS v(o, page, head)),
tx AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page, text FROM documents),
bd AS (SELECT source || ':' || vote_no || ':' || part AS doc_id, replace(CASE WHEN k % 7 = 0 AND NOT old AND q.page = 16 THEN '' ELSE coalesce(head, '') END, '{{k}}', CAST(k AS VARCHAR)) || chr(10) || coalesce(text, '') || CASE WHEN NOT old AND q.page = 5 THEN '{BOXES}' ELSE '' END AS text, q.page
FROM (SELECT source, k, old, vote_no, part, unnest(range(lo, hi + 1)) AS page FROM pt) AS q LEFT JOIN tx USING (source, page) LEFT JOIN hd ON o = old AND hd.page = q.page)"""


@query(f"""WITH {PARTS_SQL}, {_BODY}, documents_ AS (SELECT doc_id || ':' || page AS doc_id, text FROM bd), {PARAGRAPH_SQL.replace("FROM documents", "FROM documents_")},
n AS (SELECT string_split(doc_id, ':') AS x, count(*) AS n FROM par WHERE string_split(doc_id, ':')[4] <> '5' OR NOT starts_with(string_split(doc_id, ':')[1], 'src') OR CAST(substr(string_split(doc_id, ':')[1], 4) AS INTEGER) % 4 = 3 GROUP BY 1)
SELECT x[1] AS source, CAST(x[2] AS INTEGER) AS vote_no, x[3] AS part, CAST(sum(n) AS BIGINT) AS paragraphs FROM n GROUP BY 1, 2, 3""")
def booklet_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """How many paragraphs each part has to offer, but for the pages that hold boxes."""
    got = booklet.part_paragraphs(pages(spark, d), votes(spark, d), boxes(spark, d))
    boxed = (F.substring("doc", 4, 9).cast("int") % 4 != 3) & (F.col("page") == 5)
    return got.where(~boxed).groupBy(F.col("doc").alias("source"), "vote_no", "part").agg(F.count(F.lit(1)).alias("paragraphs"))


ASKED = ("Klimagesetz Nummer {k}", "Steuer-Reform Nummer {k}", "Mietrecht", " ")


@query(f"WITH {SRC_SQL} SELECT source, CAST(i AS INTEGER) AS i, CAST(v AS INTEGER) AS vote_no FROM src, (VALUES (0, 1), (1, 2), (2, NULL), (3, NULL)) AS x(i, v)")
def vote_match(spark: SparkSession, d: str) -> DataFrame:
    """Votes by name: as printed, within more words, not there, and no name at all."""
    p = pages(spark, d)
    docs = p.select("doc").distinct()
    k = F.substring("doc", 4, 9)
    asked = booklet.union([docs.select("doc", F.replace(F.lit(x), F.lit("{k}"), k).alias("name"), F.lit(i).alias("i")) for i, x in enumerate(ASKED)])
    return booklet.find_votes(asked, votes(spark, d)).select(F.col("doc").alias("source"), "i", "vote_no")


@query(f"""WITH {SRC_SQL} SELECT source, CAST(1 AS INTEGER) AS vote_no, 'Über den ' || k || '. Titel' AS title FROM src WHERE NOT old UNION ALL SELECT source, CAST(2 AS INTEGER), 'Noch ein ' || k || '. Titel' FROM src WHERE NOT old""")
def detail_titles(spark: SparkSession, d: str) -> DataFrame:
    """The long titles that stand over the lists of the newer layout's detail pages."""
    p = pages(spark, d)
    new = votes(spark, d).where("layout = 'new'")
    return booklet.detail_titles(p, new).select(F.col("doc").alias("source"), "vote_no", "title")


def _stated(p: DataFrame) -> DataFrame:
    """One vote for each booklet, as another source might state it."""
    return p.select("doc").distinct().select("doc", F.lit(1).alias("block"), F.lit("stated").alias("title"), F.lit(4).alias("s0"), F.lit(5).alias("s1"), F.lit(None).cast("int").alias("overview"), F.lit(8).alias("detail"), F.lit(12).alias("arguments"), F.lit(16).alias("law"))


@query(f"""WITH {PARTS_SQL} SELECT source, part, CAST(min(lo) AS INTEGER) AS first, CAST(max(CASE WHEN part = 'law' THEN 29 ELSE hi END) AS INTEGER) AS last FROM sp, src
WHERE NOT o AND NOT old AND vote_no = 1 AND NOT (part = 'law' AND k % 7 = 0) GROUP BY 1, 2""")
def external_structure(spark: SparkSession, d: str) -> DataFrame:
    """Entries that another source states (a model's answer), held against the same pages: one vote."""
    p = pages(spark, d).where(F.substring("doc", 4, 9).cast("int") % 4 != 3)
    said = _stated(p)
    got = booklet.parse_blocks(p, said).select("doc", F.explode("parts").alias("part", "on"))
    return got.select(F.col("doc").alias("source"), "part", F.array_min("on").alias("first"), F.when(F.col("part") == "summary", F.lit(5)).otherwise(F.array_max("on")).alias("last"))


@query(f"""WITH {PARTS_SQL} SELECT part, count(*) AS n, CAST(sum(CASE WHEN part IN ('summary', 'law') THEN 0 ELSE 1 END) AS BIGINT) AS same FROM pt WHERE NOT old AND vote_no = 1 GROUP BY 1""")
def structure_diff(spark: SparkSession, d: str) -> DataFrame:
    """The parser's pages of a vote's parts against those of one stated vote, part by part: a stated vote that is
    the only one ends its summary and its law text elsewhere."""
    p = pages(spark, d).where(F.substring("doc", 4, 9).cast("int") % 4 != 3)
    one = votes(spark, d).where("layout = 'new' AND vote_no = 1").select("doc", F.explode("parts").alias("part", "a"))
    two = booklet.parse_blocks(p, _stated(p)).select("doc", F.explode("parts").alias("part", "b"))
    both = one.join(two, ["doc", "part"], "full")
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("a").eqNullSafe(F.col("b")).cast("long")).alias("same"))


@query(f"""WITH {PARTS_SQL}, v AS (SELECT source, k, old, unnest([1, 2]) AS vote_no FROM src), y AS (SELECT k % 3 AS edition, CASE WHEN old THEN 'old' ELSE 'new' END AS layout, source,
CASE WHEN NOT old AND k % 7 = 0 AND vote_no = 1 OR NOT old AND k % 5 = 0 AND vote_no = 2 THEN 0 ELSE 1 END AS ok FROM v)
SELECT CAST(edition AS INTEGER) AS edition, layout, count(DISTINCT source) AS booklets, count(*) AS votes, CAST(sum(ok) AS BIGINT) AS complete FROM y GROUP BY 1, 2""")
def parser_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Booklets and complete votes, by edition and layout."""
    got = votes(spark, d).withColumn("edition", (F.substring("doc", 4, 9).cast("int") % 3))
    ok = F.sum((F.size("problems") == 0).cast("long"))
    return got.groupBy("edition", "layout").agg(F.countDistinct("doc").alias("booklets"), F.count(F.lit(1)).alias("votes"), ok.alias("complete"))


@query(f"""WITH {SRC_SQL}, c AS (SELECT source, 'no law heading on page N' AS cause FROM src WHERE NOT old AND k % 7 = 0 UNION ALL SELECT source, 'contents entry without arguments' FROM src WHERE NOT old AND k % 5 = 0)
SELECT cause, count(DISTINCT source) AS booklets, string_agg(source, ',' ORDER BY source) AS names FROM c GROUP BY 1""")
def parser_causes(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong, without its numbers, and in which booklets."""
    from quillon.functions.text import cause

    got = votes(spark, d).select("doc", F.explode("problems").alias("problem")).select("doc", cause(F.col("problem")).alias("cause"))
    return got.groupBy("cause").agg(F.countDistinct("doc").alias("booklets"), F.array_join(F.array_sort(F.collect_set("doc")), ",").alias("names"))


@query(f"""WITH {PARTS_SQL}, a AS (SELECT k // 3 AS date, k % 3 AS edition, vote_no, part, min(lo) AS start FROM pt GROUP BY ALL),
g AS (SELECT date, vote_no, part, count(*) AS editions, max(start) - min(start) AS apart FROM a GROUP BY 1, 2, 3), n AS (SELECT date, count(DISTINCT edition) AS of FROM a GROUP BY 1)
SELECT CAST(date AS INTEGER) AS date, count(*) AS parts, count(*) FILTER (WHERE editions < of) AS lacking, count(*) FILTER (WHERE apart > 1) AS far FROM g JOIN n USING (date) GROUP BY 1""")
def edition_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Editions of one date side by side: parts that some lack, and starts more than a page apart."""
    k = F.substring("doc", 4, 9).cast("int")
    got = votes(spark, d).select(F.floor(k / 3).cast("int").alias("date"), (k % 3).alias("edition"), "vote_no", F.explode("parts").alias("part", "on"))
    of = got.groupBy("date").agg(F.countDistinct("edition").alias("of"))
    start = F.array_min("on")
    each = got.groupBy("date", "vote_no", "part").agg(F.count(F.lit(1)).alias("editions"), (F.max(start) - F.min(start)).alias("apart")).join(of, "date")
    return each.groupBy("date").agg(F.count(F.lit(1)).alias("parts"), F.sum((F.col("editions") < F.col("of")).cast("long")).alias("lacking"), F.sum((F.col("apart") > 1).cast("long")).alias("far"))


@query(f"""WITH {SRC_SQL}, t AS (SELECT k // 3 AS date, k % 3 AS edition, vote_no, CASE WHEN vote_no = 1 THEN 'Klimagesetz' ELSE 'Steuerreform' END AS name FROM src, (VALUES (1), (2)) AS v(vote_no))
SELECT CAST(x.date AS INTEGER) AS date, CAST(x.edition AS INTEGER) AS edition, CAST(y.edition AS INTEGER) AS other, CAST(x.vote_no AS INTEGER) AS vote_no, y.name FROM t AS x JOIN t AS y ON x.date = y.date AND x.vote_no = y.vote_no AND x.edition <> y.edition""")
def swapped_names(spark: SparkSession, d: str) -> DataFrame:
    """A vote's names in the other editions of its date, found by position."""
    k = F.substring("doc", 4, 9).cast("int")
    name = F.regexp_extract("title", r"(\w+) Nummer", 1)
    got = votes(spark, d).select(F.floor(k / 3).cast("int").alias("date"), (k % 3).alias("edition"), "vote_no", name.alias("name"))
    other = got.select("date", F.col("edition").alias("other"), "vote_no", "name")
    return got.drop("name").join(other, ["date", "vote_no"]).where("edition <> other").select("date", "edition", "other", "vote_no", "name")


_STOP = {k: "[" + ", ".join(f"'{w}'" for w in v) + "]" for k, v in STOPWORDS.items()}


@query("WITH d AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents), w AS (SELECT source, regexp_extract_all(lower(string_agg(text, chr(10) ORDER BY page)), '\\p{L}+') AS ws FROM d WHERE page <= 8 GROUP BY 1), c AS (SELECT source, " + ", ".join(f"len(list_filter(ws, lambda x: list_contains({v}, x))) AS c_{k}" for k, v in _STOP.items()) + """ FROM w)
SELECT source, CASE WHEN greatest(c_de, c_fr, c_it) = 0 THEN 'de' WHEN c_de = greatest(c_de, c_fr, c_it) THEN 'de' WHEN c_fr = greatest(c_de, c_fr, c_it) THEN 'fr' ELSE 'it' END AS found FROM c""")
def booklet_languages(spark: SparkSession, d: str) -> DataFrame:
    """A booklet's language by the words of its first eight pages."""
    order = Window.partitionBy("source").orderBy("doc_id")
    docs = table(spark, d, "documents")
    first = docs.select("doc_id", "source").withColumn("page", F.row_number().over(order)).where("page <= 8")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n")
    whole = docs.select("doc_id", "text").join(first, "doc_id").groupBy("source").agg(text.alias("t"))
    return whole.select("source", language(F.col("t")).alias("found"))
