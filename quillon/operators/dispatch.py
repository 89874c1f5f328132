"""How cases run: kinds, prompts, completion, fallbacks, parsing roles, strategies of several calls.

A case takes one of a few kinds by what its rules found; kinds are branches of one plan, and what
a judge says comes back by joins on the case. Calls that do not depend on the case alone (a
booklet's structure, a text's translation) are asked once for each distinct key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.text import numbered
from quillon.operators import rank
from quillon.operators.judge import FALLBACK, Judge, negated, numbers, parsed, parts_combined, tournament

#: What settings choose: version -> (system text, answer fields, tokens of an answer).
PROMPTS: dict[str, tuple[str, tuple[str, ...], int]] = {
    "pages": ("Judge the claim by the pages given. Answer in JSON with label and pages.", ("label", "pages"), 64),
    "paragraphs": ("Judge the claim by the numbered paragraphs given. Answer in JSON with label and paragraphs.", ("label", "paragraphs"), 48),
    "excerpt": ("Say whether the excerpt states the same, something different or nothing on the claim. Answer in JSON with finding.", ("finding",), 16),
    "passage": ("Judge the claim by the reference text alone. Answer in JSON with label.", ("label",), 32),
    "closed-book": ("Judge the claim from its wording. Answer in JSON with label.", ("label",), 32),
    "negate": ("Rewrite the claim as its negation. Answer in JSON with claim.", ("claim",), 128),
    "decompose": ("Split the claim into at most four claims of one fact. Answer in JSON with claims.", ("claims",), 256),
    "part": ("Name the part of the booklet that the claim's opening names. Answer in JSON with part.", ("part",), 16),
    "structure": ("Read the contents: each vote's first pages of its parts. Answer in JSON with votes.", ("votes",), 512),
    "translate": ("Translate the claim. Answer in JSON with text.", ("text",), 128),
}
#: What a finding stands for; references longer than this are cut; paragraphs kept.
FINDINGS = {"same": 0, "different": 2, "nothing": 1}
LIMITS = {"cut": (8000, 8), "para": (8000, 8), "cut4": (3000, 4)}
#: How a mode picks paragraphs: (selector if the languages are the same, else).
SELECTORS = {"cut": ("E", "E"), "cut4": ("E", "E"), "cut4-q": ("Q", "Q"), "cut4-t": ("T", "T"), "cut4-l": ("L", "L"), "cut4-h": ("L", "T"), "cut4-r": ("R", "R"), "cut4-bm25": ("B", "B"), "cut4-tf": ("TF", "TF")}
FIRST_CHARS = 300


def task(booklet: Column, reference: Column) -> Column:
    """A for a booklet, B for a reference, null for both or neither."""
    return F.when(booklet.isNotNull() & reference.isNull(), "A").when(reference.isNotNull() & booklet.isNull(), "B")


def kind(task: Column, part: Column, valid: Column, *, ask_part: bool = True, ask_structure: bool = True, translate: Column | None = None) -> Column:
    """How a case is completed, by its task, the part its opening names and its vote's valid parts.

    done: nothing to ask. paragraphs: the part is there. ask-part: no part is named but the vote has
    some. ask-structure: a part is named but the vote has none. pages: the fallback. passage, or
    passage-translate where its long reference is in another language.
    """
    some = F.coalesce(F.size(valid) > 0, F.lit(False))
    a = F.when(part.isNotNull() & F.coalesce(F.array_contains(valid, part), F.lit(False)), "paragraphs")
    if ask_part:
        a = a.when(part.isNull() & some, "ask-part")
    if ask_structure:
        a = a.when(part.isNotNull() & ~some, "ask-structure")
    b = F.lit("passage") if translate is None else F.when(translate, "passage-translate").otherwise("passage")
    return F.when(task.isNull(), "done").when(task == "B", b).otherwise(a.otherwise("pages"))


def system(version: Column) -> Column:
    """A version's system text."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in PROMPTS.items() for x in (k, v[0]))), version)


def budget(version: Column) -> Column:
    """How many tokens a version's answer may take."""
    return F.try_element_at(F.create_map(*(F.lit(x) for k, v in PROMPTS.items() for x in (k, v[2]))), version)


def schema(version: str) -> dict:
    """A version's answer schema: its fields in order, no others."""
    kinds = {"label": {"type": "integer", "enum": [0, 1, 2]}, "pages": {"type": "array", "items": {"type": "integer"}}, "paragraphs": {"type": "array", "items": {"type": "integer"}}, "finding": {"type": "string", "enum": list(FINDINGS)}}
    fields = PROMPTS[version][1]
    return {"type": "object", "properties": {f: kinds.get(f, {"type": "string"}) for f in fields}, "required": list(fields), "additionalProperties": False}


def paragraphs_prompt(part: Column, paragraphs: Column, vote: Column, claim: Column) -> Column:
    """A routed case's request: part, numbered paragraphs, vote and claim."""
    return F.concat(F.lit("PART: "), part, F.lit("\n\nREFERENCE TEXT:\n"), F.replace(numbered(paragraphs), F.lit("\n\n["), F.lit("\n[")), F.lit("\n\nVOTE: "), vote, F.lit("\n\nCLAIM:\n"), claim)


def pages_prompt(text: Column, vote: Column, claim: Column, *, excerpts: bool = True) -> Column:
    return F.concat(F.lit("BOOKLET EXCERPTS:\n" if excerpts else "BOOKLET:\n"), text, F.lit("\n\nVOTE: "), vote, F.lit("\n\nCLAIM:\n"), claim)


def passage_prompt(text: Column, claim: Column) -> Column:
    return F.concat(F.lit("REFERENCE TEXT:\n"), text, F.lit("\n\nCLAIM:\n"), claim)


def excerpt_prompt(numbered_text: Column, claim: Column) -> Column:
    return F.concat(F.lit("EXCERPT:\n"), numbered_text, F.lit("\n\nCLAIM:\n"), claim)


def completed(asked: DataFrame, judge: Judge, key: str = "paragraphs") -> DataFrame:
    """asked (id, kind, prompt, ..) with answer, label, cited (numbers under `key`) and status.

    Cases of kind done, calls without an answer and answers that cannot be read get the fallback label.
    """
    open_ = asked.where("kind <> 'done'")
    said = judge.ask(open_).select("id", "answer")
    got = asked.join(said, "id", "left")
    label = parsed(F.col("answer"))
    status = F.when(F.col("kind") == "done", "invalid request").when(F.col("answer").isNull(), "model call failed").when(label.isNull(), "unparseable answer").otherwise("ok")
    return got.withColumn("status", status).withColumn("label", F.coalesce(label, F.lit(FALLBACK))).withColumn("cited", F.when(F.col("status") == "ok", numbers(F.col("answer"), key)))


def with_evidence(done: DataFrame, items: DataFrame) -> DataFrame:
    """done with n_items and a status for labels that need evidence but have none; neutral ones have none."""
    n = items.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    got = done.join(n, "id", "left").withColumn("n_items", F.when(F.col("label") == 1, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long")).drop("n")
    return got.withColumn("status", F.when((F.col("status") == "ok") & (F.col("label") != 1) & (F.col("n_items") == 0), "no valid items for label 0/2").otherwise(F.col("status")))


def looks(label: Column, cited: Column, excerpt: Column, again: Column, similar: Column, similarity: Column, least: float = 0.845) -> Column:
    """The label after second looks, in their order: at the cited excerpt (its answer is final), at the cited
    paragraphs alone, at the most similar ones (these two replace a neutral label by another only)."""
    neutral = label == 1
    has = F.coalesce(F.size(cited) > 0, F.lit(False))
    first = F.when(neutral & has, F.coalesce(excerpt, label)).otherwise(label)
    second = F.when((first == 1) & has & again.isin(0, 2), again).otherwise(first)
    return F.when((second == 1) & (similarity >= least) & similar.isin(0, 2), similar).otherwise(second)


def once(rows: DataFrame, keys: list[str], judge: Judge) -> DataFrame:
    """rows with the judge's answer to each distinct key, asked once, and whether the row is its key's first
    (which carries the call's tokens)."""
    said = judge.ask(rows.select(*keys).distinct())
    first = Window.partitionBy(*keys).orderBy("id")
    return rows.join(said, keys, "left").withColumn("asked_here", F.row_number().over(first) == 1)


def asked_part(cases: DataFrame, said: Column) -> DataFrame:
    """ask-part cases with the part that the answer names, if it is valid; else they fall back to pages."""
    ok = F.array_contains("valid", said)
    return cases.withColumn("part", F.when(ok, said)).withColumn("kind", F.when(F.coalesce(ok, F.lit(False)), "paragraphs").otherwise("pages"))


def asked_structure(cases: DataFrame, stated: DataFrame) -> DataFrame:
    """ask-structure cases with the valid parts that another source's entries (doc, stated) lead to."""
    got = cases.join(stated, "doc", "left")
    ok = F.coalesce(F.array_contains("stated", F.col("part")), F.lit(False))
    return got.withColumn("kind", F.when(ok, "paragraphs").otherwise("pages"))


def wide(paragraphs: DataFrame, claims: DataFrame, k: int = 8) -> DataFrame:
    """(claim, doc, place, part, text): the k paragraphs of all parts that are lexically nearest, in order; a
    text that several parts have counts once, for the first."""
    first = Window.partitionBy("doc", "text").orderBy("place")
    unique = paragraphs.withColumn("same", F.row_number().over(first)).where("same = 1").drop("same")
    asked = claims.select("claim", "doc", rank.lexical_form(F.col("text")).alias("c"))
    scored = unique.withColumn("p", rank.lexical_form(F.col("text"))).join(asked, "doc").withColumn("score", rank.lexical(F.col("c"), F.col("p")))
    return rank.top_k(scored, "claim", k, F.round("score", 9).desc(), "place").select("claim", "doc", "place", "part", "text")


def needs_model(kind: Column, long: Column, mode: str, same: Column, uses_model: bool) -> Column:
    """Whether preparing a case runs an embedding model: long references by selectors that embed, routed parts
    by a ranker that does."""
    one, other = SELECTORS.get(mode, ("E", "E"))
    embeds = lambda s: F.lit(s in ("E", "Q", "T", "TF") or s == "R" and uses_model)
    return F.when(kind.startswith("passage"), long & F.when(same, embeds(one)).otherwise(embeds(other))).otherwise((kind == "paragraphs") & F.lit(uses_model))


def prepared_order(cases: DataFrame) -> DataFrame:
    """cases with their turn: those that need no model first, then by the booklet seen first, then as given."""
    seen = F.min("line_no").over(Window.partitionBy(F.coalesce("doc", F.lit(""))))
    got = cases.withColumn("seen", seen)
    return got.withColumn("turn", F.struct("needs_model", "seen", "line_no")).drop("seen")


#: Rankers: (uses an embedding model, what stands in for it where it cannot run).
RANKERS: Mapping[str, tuple[bool, str]] = {"e5": (True, "none"), "S": (True, "none"), "BM25": (False, "BM25"), "S+BM25": (True, "BM25"), "e5+BM25": (True, "BM25"), "none": (False, "none")}


def effective(ranker: str, unusable: frozenset[str] | set[str] = frozenset()) -> str:
    """The ranker that runs when some models cannot: its lexical half, or none (the first k as they stand)."""
    if ranker not in RANKERS:
        raise ValueError(f"unknown ranker {ranker!r}; known: {', '.join(RANKERS)}")
    return RANKERS[ranker][1] if RANKERS[ranker][0] and ranker.split("+")[0] in unusable else ranker


def ranked_by(ranker: str, lexical: Column, similarity: Column, place: Column, by: str) -> Column:
    """The score that a ranker orders items by; fused ones add reciprocal ranks within `by`."""
    at = lambda c: F.row_number().over(Window.partitionBy(by).orderBy(F.round(c, 9).desc(), place))
    if ranker == "none":
        return -place.cast("double")
    if "+" in ranker:
        return 1.0 / (rank.RRF + at(lexical)) + 1.0 / (rank.RRF + at(similarity))
    return (lexical if ranker == "BM25" else similarity).cast("double")


def selector(mode: str, same: Column) -> Column:
    one, other = SELECTORS.get(mode, ("E", "E"))
    return F.when(same, one).otherwise(other)


def selector_text(selector: Column, paragraph: Column, first: Column) -> Column:
    """The text that a selector compares: the whole paragraph, its first characters, or those under the first line."""
    start = F.substring(paragraph, 1, FIRST_CHARS)
    return F.when(selector == "T", start).when(selector == "TF", F.concat(first, F.lit(": "), start)).otherwise(paragraph)


def strategy_calls(claims: DataFrame, strategy: str, parts: Column | None = None) -> DataFrame:
    """(id, call, text, ..): the requests that a strategy of several calls makes for each claim."""
    calls = {
        "xlang": F.array(*(F.struct(F.lit(k).alias("call"), F.col("text").alias("text")) for k in ("first", "translated", "tiebreak"))),
        "negation": F.array(F.struct(F.lit("first").alias("call"), F.col("text").alias("text")), F.struct(F.lit("negated").alias("call"), F.concat(F.lit("not: "), "text").alias("text"))),
        "decompose": F.transform(F.split("text", r"(?<=[.!?])\s+") if parts is None else parts, lambda x, i: F.struct(F.concat(F.lit("part"), i.cast("string")).alias("call"), x.alias("text"))),
    }[strategy]
    rest = [c for c in claims.columns if c != "text"]
    return claims.select(*rest, F.explode(F.slice(calls, 1, 4)).alias("x")).select(*rest, "x.call", "x.text")


def strategy_labels(answered: DataFrame, strategy: str) -> DataFrame:
    """(id, label, calls, tokens): a claim's answers (id, call, label, tokens) combined as the strategy says."""
    of = lambda k: F.max(F.when(F.col("call") == k, F.col("label")))
    label = {"xlang": tournament(of("first"), of("translated"), of("tiebreak")), "negation": negated(of("first"), of("negated")), "decompose": parts_combined(F.collect_list("label"))}[strategy]
    return answered.groupBy("id").agg(label.cast("int").alias("label"), F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"))
