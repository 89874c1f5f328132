"""Structure of voting booklets: contents entries, votes, part page ranges, recommendation boxes.

Works on pages (doc, page, text) of any number of booklets at once. Each rule is a filter, a
running sum over line order or a join on the booklet, so that an entry or a heading that cannot
be read costs the part it belongs to and nothing else. Patterns are matched on the compatibility
form in lower case, or on that without any space where text layers put spaces into words.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import plain
from quillon.operators.fuzzy import ratio
from quillon.operators.segment import grouped
from quillon.operators.settled import settle

#: Parts in the order of a booklet, and who speaks in boxes.
PARTS = ("summary", "detail", "committee", "parliament", "council", "law")
VOICES = ("committee", "council", "parliament")
#: Contents labels; a page number, whose digits may be apart; pages that hold contents.
LABELS = {
    "summary": r"in kürze|en bref|in breve",
    "overview": r"übersicht[^\d]*|vue d'ensemble[^\d]*|tabella riassuntiva[^\d]*",
    "detail": r"(?:vorlage )?im detail|(?:l'objet )?en détail|in dettaglio",
    "arguments": r"argumente|arguments|gli argomenti",
    "law": r"abstimmungstexte?|textes? soumis au vote|(?:il |i )?test[oi] in votazione",
}
NUMBER = r"\d(?: ?\d){0,2}"
CONTENTS_PAGES = 6
#: The parliament's debate as a heading, and as the list on a vote's page has it.
DEBATE = r"debatte(?:im)?parlament|débats?(?:au)?parlement|dibattit[oi](?:parlamentar[ei]|(?:in|al)?parlamento)|deliberazion[ei](?:in|al)?parlamento"
DEBATE_LISTED = r"debatte (?:im )?parlament|débats? (?:au )?parlement|dibattit[oi] (?:parlamentar[ei]|(?:in |al )?parlamento)|deliberazion[ei] (?:in |al )?parlamento"
#: Headings on the pages where parts start, without spaces.
HEADINGS = {
    "summary": r"inkürze|enbref|inbreve",
    "detail": r"imdetail|endétail|indettaglio",
    "arguments": rf"argumente|arguments|argomenti|{DEBATE}",
    "law": r"abstimmungstext|soumisauvote|invotazione|§",
}
#: Sub-sections of the arguments.
SUBS = {
    "committee": r"argumente (?:des )?(?:initiativ|referendums)komitees?|arguments? (?:du |des )?comités? (?:d'initiative|référendaires?)|gli argomenti (?:del comitato|dei comitati) (?:d'iniziativa|referendari[oa]?)",
    "council": r"argumente (?:von |des )?bundesrat(?:es)?(?: und parlament)?|arguments? (?:du )?conseil fédéral(?: et (?:du )?parlement)?|gli argomenti del consiglio federale(?: e del parlamento)?",
    "parliament": DEBATE_LISTED,
}
#: Lines that open a box, addresses that close it, counts of votes, who speaks.
ANSWER = r"^(?:ja|nein|oui|non|sì|si|no)$"
ADDRESS = r"[\p{L}\p{N}_]\.ch\b|\.ch/"
COUNTS = r"^\d{1,3} (?:ja|nein|enthaltungen?|oui|non|abstentions?|sì|si|no|astensioni|astensione)$"
SPEAKERS = {
    "council": r"bundesratund(?:das)?parlament|conseilfédéralet(?:le)?parlement|consigliofederalee(?:il)?parlamento",
    "committee": r"komitee|comité|comitat[oi]",
    "parliament": r"minderheit|minorité|minoranza|mitglieder(?:des|von)|membres(?:du|de)|membri(?:del|di)",
}
BOX = 40
#: Fixed values of the older layout: one entry a vote, its legal texts, headings as whole lines.
OLD_BLOCK = ("informationen zur vorlage", "explications", "spiegazioni")
OLD_WORDS = ("seiten", "seite", "pages", "page", "pagine", "pagina")
OLD_LAW = r"der abstimmungstext|texte soumis au vote|testo in votazione|der text des (?:bundesbeschlusses|bundesgesetzes)|texte de (?:l'arrêté fédéral|la loi fédérale)|testo (?:del decreto federale|della legge federale)"
OLD_HEADINGS = {
    "summary": r"daswichtigsteinkürze|l'essentielenbref|l'essenzialeinbreve",
    "detail": r"dievorlageimdetail|l'objetendétail|ilprogettoindettaglio",
    "law": r"abstimmungstext|textesoumisauvote|testoinvotazione",
    "parliament": r"dieberatungenimparlament|lesdélibérationsparlementaires|ledeliberazioniinparlamento",
    "council": r"dieargumente(?:desbundesrates(?:unddesparlaments)?|vonbundesratundparlament)|lesargumentsduconseilfédéral(?:etduparlement)?|gliargomentidelconsigliofederale(?:edelparlamento)?",
    "committee": r"dieargumentedes(?:initiativ|referendums)komitees|lesargumentsducomité(?:d'initiative|référendaire)|gliargomentidelcomitato(?:d'iniziativa|referendario)",
}
#: Least score of a vote's title, and its lead over the next.
TITLE, LEAD = 80.0, 5.0


def _u(pattern: str) -> str:
    return f"(?U){pattern}"


def _tight(text: Column) -> Column:
    return F.replace(text, F.lit(" "), F.lit(""))


def _number(digits: Column) -> Column:
    return _tight(digits).try_cast("int")


def lines(pages: DataFrame) -> DataFrame:
    """(doc, page, line_no, line, flat): all lines, and their plain form."""
    got = pages.select("doc", "page", F.posexplode(F.split("text", "\r\n|\n|\r")).alias("line_no", "line"))
    return got.withColumn("flat", plain(F.col("line")))


def first_pages(pages: DataFrame, n: int = CONTENTS_PAGES) -> DataFrame:
    """The pages that may hold contents: a booklet's first ones."""
    order = Window.partitionBy("doc").orderBy("page")
    return pages.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def _entry(labels: Mapping[str, str]) -> tuple[Column, Column, Column]:
    """Label, page and last page of a contents line, from its plain form; null where it is none."""
    form = _u(rf"^(?:{'|'.join(f'(?:{p})' for p in labels.values())})\s+({NUMBER})(?:\s*[–-]\s*({NUMBER}))?$")
    ok, label = F.col("flat").rlike(form), None
    for name, pattern in labels.items():
        hit = F.col("flat").rlike(_u(rf"^(?:{pattern})\s+{NUMBER}(?:\s*[–-]\s*{NUMBER})?$"))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.when(ok, label), F.when(ok, _number(F.regexp_extract("flat", form, 1))), F.when(ok, _number(F.regexp_extract("flat", form, 2)))


def entries(pages: DataFrame, labels: Mapping[str, str] = LABELS) -> DataFrame:
    """(doc, page, line_no, line, flat, label, a, b): the contents pages' lines; label, a (page) and
    b (last page) are null but for entries."""
    label, a, b = _entry(labels)
    return lines(first_pages(pages)).select("doc", "page", "line_no", "line", "flat", label.alias("label"), a.alias("a"), b.alias("b"))


def blocks(found: DataFrame) -> DataFrame:
    """(doc, title, s0, s1, overview, detail, arguments, law): a row for each vote in the contents.

    A summary entry opens a block, on pages that have one that points beyond them; the labels that
    follow belong to it, each once; the lines before it, since the last entry of the page, are
    its title.
    """
    on = found.where((F.col("label") == "summary") & (F.col("a") > F.col("page"))).select("doc", "page").distinct()
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    got = found.join(on, ["doc", "page"]).withColumn("block", F.sum((F.coalesce("label", F.lit("")) == "summary").cast("int")).over(order))
    same = Window.partitionBy("doc", "block", "label").orderBy("page", "line_no")
    got = got.withColumn("taken", F.col("label").isNotNull() & (F.col("block") > 0) & (F.row_number().over(same) == 1))
    got = got.withColumn("run", F.sum(F.col("taken").cast("int")).over(Window.partitionBy("doc", "page").orderBy("line_no")))
    text = F.array_sort(F.collect_list(F.when(F.col("label").isNull() & (F.trim("line") != ""), F.struct("line_no", F.trim("line").alias("t")))))
    titles = got.groupBy("doc", "page", "run").agg(F.array_join(F.transform(text, lambda x: x["t"]), " ").alias("title"))
    opened = got.where("taken AND label = 'summary'").select("doc", "block", "page", (F.col("run") - 1).alias("run")).join(titles, ["doc", "page", "run"], "left")
    of = lambda name, c="a": F.max(F.when(F.col("label") == name, F.col(c)))
    each = got.where("taken").groupBy("doc", "block").agg(of("summary").alias("s0"), of("summary", "b").alias("s1"), *(of(k).alias(k) for k in ("overview", "detail", "arguments", "law")))
    return each.join(opened.select("doc", "block", "title"), ["doc", "block"]).select("doc", "block", F.coalesce("title", F.lit("")).alias("title"), "s0", F.coalesce("s1", "s0").alias("s1"), "overview", "detail", "arguments", "law")


def page_marks(pages: DataFrame) -> DataFrame:
    """(doc, page, has: parts whose heading the page carries, listed: [(name, n)] in order, headed: names)."""
    flat, tight = F.col("flat"), _tight(F.col("flat"))
    bare = plain(F.regexp_replace("text", r"\d", " "))
    has = F.array_compact(F.array(*(F.when(tight.rlike(_u(p)), F.lit(k)) for k, p in HEADINGS.items())))

    def named(k: str, p: str) -> Column:
        found = F.regexp_extract_all(flat, F.lit(_u(rf"(?:{p}) ({NUMBER})(?!\d)")), 1)
        return F.transform(found, lambda n: F.struct(F.lit(k).alias("name"), _number(n).alias("n")))

    listed = F.concat(*(named(k, p) for k, p in SUBS.items()))
    alone = F.exists(F.split("text", "\r\n|\n|\r"), lambda x: _tight(F.lower(F.regexp_replace(x, r"\s+", ""))).rlike(_u(f"^(?:{DEBATE})$")))
    headed = F.array_compact(F.array(*(F.when(bare.rlike(_u(SUBS[k])), F.lit(k)) for k in ("committee", "council")), F.when(alone, F.lit("parliament"))))
    return pages.withColumn("flat", plain(F.col("text"))).select("doc", "page", has.alias("has"), listed.alias("listed"), headed.alias("headed"))


def sub_starts(votes: DataFrame, marks: DataFrame, start: str) -> DataFrame:
    """(doc, vote_no, listed, headed): for the arguments from `start` on, the sub-sections' first pages
    (name -> page) by the list on the vote's own pages, and by headings."""
    asked = votes.where(F.col(start).isNotNull() & F.col("law").isNotNull()).select("doc", "vote_no", "s0", "law", F.col(start).alias("from"))
    got = asked.join(marks, "doc").where((F.col("page") >= F.least("s0", "from")) & (F.col("page") < F.col("law")))
    inside = got.where("page >= s0").select("doc", "vote_no", "page", "from", "law", F.posexplode("listed").alias("at", "x")).where("x.n >= from AND x.n < law")
    named = inside.groupBy("doc", "vote_no", F.col("x.name").alias("name")).agg(F.min_by("x.n", F.struct("page", "at")).alias("n"))
    listed = named.groupBy("doc", "vote_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("listed"))
    seen = got.where("page >= from").select("doc", "vote_no", "page", F.explode("headed").alias("name")).groupBy("doc", "vote_no", "name").agg(F.min("page").alias("n"))
    headed = seen.groupBy("doc", "vote_no").agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("headed"))
    none = F.create_map().cast("map<string,int>")
    both = asked.select("doc", "vote_no").join(listed, ["doc", "vote_no"], "left").join(headed, ["doc", "vote_no"], "left")
    return both.select("doc", "vote_no", F.coalesce("listed", none).alias("listed"), F.coalesce("headed", none).alias("headed"))


def parse_blocks(pages: DataFrame, given: DataFrame) -> DataFrame:
    """(doc, vote_no, title, parts: part -> pages, valid: parts, problems): the votes of `given`
    blocks, wherever those come from, each part held against the pages."""
    marks = settle(page_marks(pages))
    last = pages.groupBy("doc").agg(F.max("page").alias("last"))
    first = F.min(F.coalesce("overview", "detail", F.lit(10**6))).over(Window.partitionBy("doc"))
    order = Window.partitionBy("doc").orderBy("s0", "block")
    starts = given.select("doc", F.explode(F.array_compact(F.array("overview", "detail"))).alias("n")).groupBy("doc").agg(F.array_sort(F.collect_set("n")).alias("starts"))
    v = given.withColumn("vote_no", F.row_number().over(order)).withColumn("s_end", F.coalesce(F.lead("s0").over(order), first) - 1)
    v = v.join(last, "doc").join(starts, "doc", "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))
    v = v.withColumn("law_end", F.coalesce(F.array_min(F.filter("starts", lambda n: n > F.col("law"))) - 1, F.col("last") - 1))
    until = F.array_min(F.filter(F.concat("starts", F.array(F.col("detail") + 1)), lambda n: n > F.col("overview")))
    v = v.withColumn("over", F.when(F.col("overview").isNotNull() & F.col("detail").isNotNull() & (until > F.col("overview")), F.sequence("overview", until - 1)).otherwise(F.array().cast("array<int>")))
    v = v.withColumn("s_last", F.greatest("s1", "s_end"))
    chain = F.array_compact(F.array("s_last", "detail", "arguments", "law"))
    rising = F.forall(F.sequence(F.lit(1), F.size(chain)), lambda i: (i == 1) | (F.try_element_at(chain, F.greatest(i - 1, F.lit(1))) < F.element_at(chain, i)))
    inside = (F.size("over") == 0) | (F.col("overview") > F.col("s_end")) & (F.col("overview") < F.col("detail"))
    v = v.withColumn("ordered", (F.col("s0") <= F.col("s_last")) & rising & (F.col("law").isNull() | (F.col("law") <= F.col("law_end"))) & inside)
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(k)) for k, c in (("detail", "detail"), ("arguments", "arguments"), ("law", "law")))))
    v = settle(v.withColumn("missing", missing))
    # Headings: whether the page where a part starts carries the part's name.
    at = v.select("doc", "vote_no", F.explode(F.array(*(F.struct(F.lit(k).alias("part"), F.col(c).alias("page")) for k, c in (("summary", "s0"), ("detail", "detail"), ("arguments", "arguments"), ("law", "law"))))).alias("x")).where("x.page IS NOT NULL")
    at = at.select("doc", "vote_no", "x.part", "x.page").join(marks.select("doc", "page", "has"), ["doc", "page"], "left")
    at = at.groupBy("doc", "vote_no").agg(
        F.collect_set(F.when(F.array_contains("has", F.col("part")), F.col("part"))).alias("headed_parts"),
        F.array_sort(F.collect_list(F.when(~F.coalesce(F.array_contains("has", F.col("part")), F.lit(False)), F.concat(F.lit("no "), "part", F.lit(" heading on page "), F.col("page").cast("string"))))).alias("unheaded"),
    )
    v = settle(v.join(at, ["doc", "vote_no"]))
    has = lambda k: F.array_contains("headed_parts", k)
    # Where the heading is lost, a list on the vote's pages that names the same page confirms it.
    told = sub_starts(v, marks, "arguments").select("doc", "vote_no", F.map_values("listed").alias("told"))
    # Where the contents name no arguments, the first sub-section after the detail's first page.
    found = sub_starts(v.withColumn("after", F.when(F.col("arguments").isNull(), F.col("detail") + 1)), marks, "after")
    found = found.select("doc", "vote_no", F.array_min(F.concat(F.map_values("listed"), F.map_values("headed"))).alias("found"))
    found = found.join(marks.select("doc", F.col("page").alias("found"), F.array_contains("has", "arguments").alias("sure")), ["doc", "found"]).where("sure").select("doc", "vote_no", "found")
    v = v.join(told, ["doc", "vote_no"], "left").join(found, ["doc", "vote_no"], "left")
    confirmed = F.col("arguments").isNotNull() & ~has("arguments") & F.coalesce(F.array_contains("told", F.col("arguments")), F.lit(False))
    v = v.withColumn("confirmed", confirmed)
    v = v.withColumn("args", F.when(F.col("arguments").isNotNull(), F.when(has("arguments") | F.col("confirmed"), F.col("arguments"))).when(has("detail") & has("law"), F.col("found")))
    v = settle(v)
    subs = sub_starts(v.where("ordered"), marks, "args").withColumnRenamed("headed", "by_heading")
    v = settle(v.join(subs, ["doc", "vote_no"], "left"))
    names = F.array(*map(F.lit, VOICES))
    differ = F.filter(names, lambda k: F.try_element_at("listed", k) != F.try_element_at("by_heading", k))
    sub = F.array_sort(F.filter(F.transform(names, lambda k: F.struct(F.coalesce(F.try_element_at("listed", k), F.try_element_at("by_heading", k)).alias("page"), k.alias("name"))), lambda x: x["page"].isNotNull()))
    v = settle(v.withColumn("differ", differ).withColumn("sub", sub))
    council = F.exists("sub", lambda x: x["name"] == "council")
    apart = (F.get("sub", F.lit(0))["page"] == F.col("args")) & (F.size(F.array_distinct(F.col("sub")["page"])) == F.size("sub"))
    v = v.withColumn("sub_problem", F.when(F.col("args").isNull() | F.col("law").isNull(), F.lit(None)).when(F.size("differ") > 0, F.concat(F.array_join("differ", ", "), F.lit(": list and heading differ"))).when(~council, "no start page for the council's arguments").when(~apart, "sub-sections out of order"))
    good = F.col("ordered") & F.col("args").isNotNull() & F.col("law").isNotNull() & F.col("sub_problem").isNull()
    problems = F.array_compact(F.array(
        F.when(F.size("missing") > 0, F.concat(F.lit("contents entry without "), F.array_join("missing", ", "))),
        F.when(~F.col("ordered"), "contents page numbers out of order"),
        F.when(F.col("ordered") & F.col("confirmed"), "arguments confirmed by the list only"),
        F.when(F.col("ordered") & F.col("arguments").isNull() & has("detail") & has("law") & F.col("args").isNull(), "no arguments heading after the detailed section"),
        F.when(F.col("ordered"), F.col("sub_problem")),
    ))
    problems = F.concat(problems, F.when(F.col("ordered"), F.col("unheaded")).otherwise(F.array().cast("array<string>")))
    ends = F.transform("sub", lambda x, i: F.struct(x["name"].alias("name"), F.sequence(x["page"], F.coalesce(F.get("sub", i + 1)["page"], F.col("law")) - 1).alias("pages")))
    part = lambda k, ok, pages: F.when(F.col("ordered") & ok, F.array(F.struct(F.lit(k).alias("name"), pages.alias("pages")))).otherwise(F.array().cast("array<struct<name:string,pages:array<int>>>"))
    detail = F.array_sort(F.array_union("over", F.sequence("detail", F.col("args") - 1)))
    pieces = F.concat(
        part("summary", has("summary"), F.sequence("s0", "s_last")), part("detail", has("detail") & F.col("args").isNotNull() & (F.col("args") > F.col("detail")), detail),
        F.when(good, ends).otherwise(F.array().cast("array<struct<name:string,pages:array<int>>>")), part("law", has("law"), F.sequence("law", "law_end")),
    )
    valid = F.concat(F.col("pieces")["name"], F.when(F.col("good"), F.array_except(F.array(*map(F.lit, VOICES)), F.col("pieces")["name"])).otherwise(F.array().cast("array<string>")))
    v = settle(v.withColumn("pieces", pieces).withColumn("good", good).withColumn("problems", F.array_sort(problems)))
    return v.select("doc", "vote_no", "title", F.map_from_entries("pieces").alias("parts"), F.array_sort(valid).alias("valid"), "problems")


def _spread(words: tuple[str, ...]) -> str:
    """Words that may carry a space between any two letters."""
    return "|".join(r"\s?".join(r"\s+" if c == " " else c for c in w) for w in words)


def old_layout(pages: DataFrame) -> DataFrame:
    """Like parse_blocks(), for booklets with one contents entry a vote.

    A legal text belongs to the vote whose pages hold it, else to the entry before it; a part
    starts on the first page of the vote that has its heading as a whole line.
    """
    span = rf"(?:{_spread(OLD_WORDS)})\s+({NUMBER})(?:\s*[–-]\s*({NUMBER}))?"
    entry, law = _u(rf"^(?:{_spread(OLD_BLOCK)})\s+{span}(?:\s+\d+)?$"), _u(rf"^(?:{OLD_LAW})\s+{span}$")
    flat = F.col("flat")
    kind = F.when(flat.rlike(entry), "entry").when(flat.rlike(law), "law").when(flat != "", "title")
    at = lambda i: F.coalesce(_number(F.when(F.col("kind") == "entry", F.regexp_extract(flat, entry, i)).otherwise(F.regexp_extract(flat, law, i))))
    got = lines(first_pages(pages)).withColumn("kind", kind).where("kind IS NOT NULL").withColumn("lo", at(1)).withColumn("hi", F.coalesce(at(2), at(1)))
    order = Window.partitionBy("doc").orderBy("page", "line_no")
    got = settle(got)
    got = got.withColumn("nth", F.sum((F.col("kind") == "entry").cast("int")).over(order)).withColumn("run", F.sum((F.col("kind") != "title").cast("int")).over(order))
    text = F.array_sort(F.collect_list(F.when(F.col("kind") == "title", F.struct("page", "line_no", F.trim("line").alias("t")))))
    titles = got.groupBy("doc", "run").agg(F.array_join(F.transform(text, lambda x: x["t"]), " ").alias("title"))
    found = got.where("kind = 'entry'").select("doc", "nth", "lo", "hi", (F.col("run") - 1).alias("run")).join(titles, ["doc", "run"], "left").drop("run")
    found = found.where((F.col("lo") > CONTENTS_PAGES // 2) & (F.col("lo") <= F.col("hi"))).withColumn("vote_no", F.row_number().over(Window.partitionBy("doc").orderBy("nth")))
    laws = got.where("kind = 'law'").select("doc", "page", "line_no", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("nth").alias("before"))
    # The holder if there is one, else the entry before: one row for each legal text.
    held = laws.join(found.select("doc", "vote_no", "lo", "hi"), "doc").withColumn("inside", F.col("a").between(F.col("lo"), F.col("hi")))
    held = held.where("inside OR vote_no = before").groupBy("doc", "page", "line_no", "a", "b").agg(F.min_by("vote_no", F.struct(~F.col("inside"), "vote_no")).alias("vote_no"))
    held = held.groupBy("doc", "vote_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("b") >= F.col("a"), F.sequence("a", "b")))))).alias("law"))
    none = F.array().cast("array<int>")
    v = settle(found.join(held, ["doc", "vote_no"], "left").withColumn("law", F.coalesce("law", none)))
    tight = F.transform(F.split("text", "\r\n|\n|\r"), lambda x: F.lower(F.regexp_replace(x, "[\\s ]+", "")))
    head = None

    def alone(pattern: str) -> Column:
        return F.exists("tight", lambda x: F.replace(x, F.lit("’"), F.lit("'")).rlike(_u(f"^(?:{pattern})$")))

    for name, pattern in OLD_HEADINGS.items():
        hit = alone(pattern)
        head = F.when(hit, name) if head is None else head.when(hit, name)
    heads = settle(pages.withColumn("tight", tight).select("doc", "page", head.alias("part"), _tight(plain(F.col("text"))).rlike(_u(HEADINGS["law"])).alias("legal")))
    v = v.withColumn("first", F.get("law", F.lit(0))).join(heads.select("doc", F.col("page").alias("first"), "legal"), ["doc", "first"], "left").drop("first")
    lost = (F.size("law") > 0) & ~F.coalesce("legal", F.lit(False))
    v = v.withColumn("lost", F.when(lost, F.concat(F.lit("no law heading on page "), F.get("law", F.lit(0)).cast("string")))).withColumn("law", F.when(lost, none).otherwise(F.col("law")))
    v = settle(v)
    begun = v.join(heads.where("part IS NOT NULL").select("doc", "page", "part"), "doc").where((F.col("page") >= F.col("lo")) & (F.col("page") <= F.col("hi")) & ~F.array_contains("law", F.col("page")) & ~((F.col("part") == "law") & (F.size("law") > 0)))
    begun = begun.groupBy("doc", "vote_no", "part").agg(F.min("page").alias("page"))
    begun = begun.unionByName(v.where((F.size("law") > 0) & (F.get("law", F.lit(0)) <= F.col("hi"))).select("doc", "vote_no", F.lit("law").alias("part"), F.get("law", F.lit(0)).alias("page")))
    begun = begun.groupBy("doc", "vote_no").agg(F.array_sort(F.collect_list(F.struct("page", "part"))).alias("begun"))
    v = settle(v.join(begun, ["doc", "vote_no"], "left")).withColumn("begun", F.coalesce("begun", F.array().cast("array<struct<page:int,part:string>>")))

    def span_of(x: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("begun", i + 1)["page"], F.col("hi") + 1)
        own = F.when(stop > x["page"], F.sequence(x["page"], stop - 1)).otherwise(none)
        lead = F.when((i == 0) & (x["part"] == "summary") & (x["page"] > F.col("lo")), F.sequence("lo", x["page"] - 1)).otherwise(none)
        return F.struct(x["part"].alias("name"), F.when(x["part"] == "law", F.when(F.size("law") > 0, F.col("law")).otherwise(own)).otherwise(F.concat(lead, F.array_except(own, F.col("law")))).alias("pages"))

    outside = F.when((F.size("law") > 0) & ~F.exists("begun", lambda x: x["part"] == "law"), F.array(F.struct(F.lit("law").alias("name"), F.col("law").alias("pages")))).otherwise(F.array().cast("array<struct<name:string,pages:array<int>>>"))
    v = settle(v.withColumn("pieces", F.filter(F.concat(F.transform("begun", span_of), outside), lambda x: F.size(x["pages"]) > 0)))
    lacking = F.transform(F.array_except(F.array(*map(F.lit, ("summary", "detail", "council", "law"))), F.col("pieces")["name"]), lambda k: F.concat(F.lit("no "), k, F.lit(" heading")))
    problems = F.array_sort(F.concat(F.array_compact(F.array("lost")), lacking))
    valid = F.when(F.size(problems) == 0, F.array(*map(F.lit, sorted(PARTS)))).otherwise(F.array_sort(F.col("pieces")["name"]))
    return v.select("doc", "vote_no", F.coalesce("title", F.lit("")).alias("title"), F.map_from_entries("pieces").alias("parts"), valid.alias("valid"), problems.alias("problems"))


def parse(pages: DataFrame) -> DataFrame:
    """Votes of booklets in either layout: the older one where no block of the newer was found."""
    found = settle(blocks(settle(entries(pages))))
    rest = pages.join(found.select("doc").distinct(), "doc", "left_anti")
    return settle(parse_blocks(pages, found).withColumn("layout", F.lit("new")).unionByName(old_layout(rest).withColumn("layout", F.lit("old"))))


def boxes(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """(doc, vote_no, voice, page, box_no, text): recommendations on the summary pages.

    A box runs from an answer line to the next one or to an address; the address says who speaks,
    else the speaker named first does. A page's counts of votes are one more of the parliament's.
    """
    at = votes.where(F.array_contains("valid", "summary")).select("doc", "vote_no", F.explode(F.try_element_at("parts", F.lit("summary"))).alias("page"))
    got = settle(lines(pages.join(at, ["doc", "page"]).select(F.struct("doc", "vote_no").alias("doc"), "page", "text")))
    order = Window.partitionBy("doc", "page").orderBy("line_no")
    tight = _tight(F.col("flat"))
    got = got.withColumn("answer", tight.rlike(ANSWER)).withColumn("url", F.col("line").rlike(ADDRESS)).withColumn("box", F.sum(F.col("answer").cast("int")).over(order))
    inside = Window.partitionBy("doc", "page", "box").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    got = got.withColumn("urls", F.sum(F.col("url").cast("int")).over(inside))
    text = lambda ok, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("line_no", F.col(c).alias("t"))))), lambda x: x["t"]), "\n")
    each = got.where("box > 0").groupBy("doc", "page", "box").agg(text(F.col("urls") == 0, "line").alias("body"), F.min_by(tight, F.when(F.col("url"), F.col("line_no"))).alias("first_url"), F.max("url").alias("has_url"))
    each = each.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", "")).withColumn("t", _tight(plain(F.col("body"))))
    named = F.array_min(F.filter(F.array(*(F.struct(F.regexp_instr("t", F.lit(p)).alias("at"), F.lit(k).alias("voice")) for k, p in SPEAKERS.items())), lambda x: x["at"] > 0))["voice"]
    url = F.when(F.col("has_url"), F.col("first_url")).otherwise("")
    voice = F.when(F.contains(url, F.lit("admin.ch")), "council").when(url.rlike(r"parlament\.ch|parlement\.ch|parlamento\.ch"), "parliament").when(url != "", "committee").otherwise(named)
    spoken = each.select("doc", "page", "box", voice.alias("voice"), "body", "t").where(F.col("voice").isNotNull() & (F.length("t") > BOX)).select("doc", "page", "box", "voice", F.col("body").alias("text"))
    counts = got.where(F.col("flat").rlike(_u(COUNTS))).withColumn("trimmed", F.trim("line")).groupBy("doc", "page").agg(text(F.lit(True), "trimmed").alias("text"))
    every = spoken.unionByName(counts.select("doc", "page", F.lit(10**6).cast("long").alias("box"), F.lit("parliament").alias("voice"), "text"))
    number = F.row_number().over(Window.partitionBy("doc", "voice").orderBy("page", "box"))
    return every.select(F.col("doc.doc").alias("doc"), F.col("doc.vote_no").alias("vote_no"), "voice", "page", number.alias("box_no"), "text")


def part_paragraphs(pages: DataFrame, votes: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, vote_no, part, para_no, page, text): a part's boxes, but for counts, then its pages' paragraphs."""
    boxed = found.where(~plain(F.split("text", "\n")[0]).rlike(_u(COUNTS))).select("doc", "vote_no", F.col("voice").alias("part"), F.lit(0).alias("kind"), "page", F.col("box_no").alias("at"), "text")
    of = votes.select("doc", "vote_no", F.explode("parts").alias("part", "pages")).select("doc", "vote_no", "part", F.explode("pages").alias("page"))
    told = of.join(pages, ["doc", "page"]).select("doc", "vote_no", "part", F.lit(1).alias("kind"), "page", F.posexplode(grouped(F.col("text"))).alias("at", "text"))
    order = Window.partitionBy("doc", "vote_no", "part").orderBy("kind", "page", "at")
    return boxed.unionByName(told).select("doc", "vote_no", "part", F.row_number().over(order).alias("para_no"), "page", "text")


def detail_titles(pages: DataFrame, votes: DataFrame) -> DataFrame:
    """(doc, vote_no, title): the lines of a detail part's first page between its heading and the first
    list line that names a page, without numbers of pages."""
    at = votes.select("doc", "vote_no", F.array_min(F.try_element_at("parts", F.lit("detail"))).alias("page")).where("page IS NOT NULL")
    got = settle(lines(pages.join(at, ["doc", "page"]).select(F.struct("doc", "vote_no").alias("doc"), "page", "text")).where("flat <> ''"))
    head, stop = _tight(F.col("flat")).rlike(_u(HEADINGS["detail"])), F.col("flat").rlike(_u(rf"[\p{{L}}.] {NUMBER}$"))
    edge = got.groupBy("doc").agg(F.min(F.when(head, F.col("line_no"))).alias("head"))
    got = got.join(edge, "doc").where("line_no > head")
    end = got.groupBy("doc").agg(F.min(F.when(stop, F.col("line_no"))).alias("end"))
    kept = got.join(end, "doc", "left").where((F.col("end").isNull() | (F.col("line_no") < F.col("end"))) & ~F.col("flat").rlike(r"^\d{1,3}$"))
    title = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))), lambda x: x["t"]), " ")
    return kept.groupBy("doc").agg(title.alias("title")).select("doc.doc", "doc.vote_no", "title")


def find_votes(asked: DataFrame, votes: DataFrame, least: float = TITLE, lead: float = LEAD) -> DataFrame:
    """asked (doc, name, ..) with vote_no: the vote whose title holds the name best, by a ratio of `least` and
    `lead` over the next; else null. Votes of one booklet are few, so a join on it pairs them all."""
    scored = asked.select("doc", "name").distinct().join(votes.select("doc", "vote_no", "title"), "doc")
    scored = scored.withColumn("score", F.when(F.trim("name") != "", ratio(plain(F.col("name")), plain(F.col("title")))))
    best = Window.partitionBy("doc", "name").orderBy(F.desc("score"), F.desc("vote_no"))
    top = scored.withColumn("r", F.row_number().over(best)).withColumn("next", F.lead("score").over(best)).where("r = 1")
    ok = (F.col("score") >= least) & (F.col("next").isNull() | (F.col("next") <= F.col("score") - lead))
    return asked.join(top.where(ok).select("doc", "name", "vote_no"), ["doc", "name"], "left")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
