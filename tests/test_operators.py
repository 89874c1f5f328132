"""Values computed by hand, and small brute force, for the operators."""

from __future__ import annotations

import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F
from quillon.functions import text as T
from quillon.functions.vectors import cosine
from quillon.operators import evidence, fuzzy, intervals, judge, metrics, nearest, rank, route, segment
from quillon.operators import scored as rankings
from quillon.operators.settled import in_blocks
from quillon.sources import jsonl
from quillon.streaming import cases as streams


def scored(spark, gold, pred):
    return spark.createDataFrame(list(zip(range(len(gold)), gold, pred)), "id int, gold int, pred int")


def test_macro_f1(spark):
    a = scored(spark, [0, 0, 1, 2], [0, 1, 1, None])
    assert metrics.macro_f1(a).first()[0] == pytest.approx(4 / 9)
    assert metrics.macro_f1(scored(spark, [0, 1, 2], [1, 1, 1])).first()[0] == pytest.approx(1 / 6)
    absent = scored(spark, [0, 0], [0, None])
    assert metrics.macro_f1(absent).first()[0] == pytest.approx(2 / 3)
    assert metrics.macro_f1_fixed(absent).first()[0] == pytest.approx(2 / 9)


def test_cleaned_answers(spark):
    gold = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 0)], "id int, gold int")
    answers = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 7), (9, 0)], "id int, pred int")
    assert {r.id: r.pred for r in metrics.cleaned(gold, answers, "id").collect()} == {1: 0, 2: None, 3: None, 4: None}


def test_percentiles(spark):
    df = spark.range(1, 21).select(F.lit("g").alias("g"), F.col("id").alias("v"))
    assert metrics.at_index(df, "g", "v", F.least(F.col("n") - 1, F.floor(0.95 * F.col("n"))), "p").first().p == 20
    assert df.select(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY v)")).first()[0] == 19


def test_sign_test(spark):
    two, one = metrics.sign_test(F.col("f"), F.col("b"))
    got = spark.createDataFrame([(5, 1), (0, 0), (3, 3)], "f long, b long").select(two, one).collect()
    assert got[0][0] == pytest.approx(2 * 7 / 64) and got[0][1] == pytest.approx(7 / 64)
    assert got[1][0] == 1.0 and got[2][0] == 1.0


def test_sign_test_of_many_cases(spark):
    """Where 2**-n is no double, and on both sides of the middle."""
    rows = [(1200, 1100), (1100, 1200), (3498, 7847), (40, 23), (9, 9), (1, 0), (0, 4)]
    two, one = metrics.sign_test(F.col("f"), F.col("b"))
    for (f, b), got in zip(rows, spark.createDataFrame(rows, "f long, b long").select(two, one).collect()):
        exact = lambda least: sum(math.comb(f + b, k) for k in range(least, f + b + 1)) / 2 ** (f + b)
        assert got[0] == pytest.approx(min(1.0, 2 * exact(max(f, b))), abs=1e-9) and got[1] == pytest.approx(exact(f), abs=1e-9)


def test_rules_of_combination(spark):
    df = spark.createDataFrame([(1, 0), (0, 0), (1, 1)], "a int, b int")
    assert [r[0] for r in df.select(judge.negated(F.col("a"), F.col("b"))).collect()] == [2, 0, 1]
    parts = spark.createDataFrame([([0, 0],), ([0, 1],), ([1, 2],), ([],)], "x array<int>").select(judge.parts_combined(F.col("x")))
    assert [r[0] for r in parts.collect()] == [0, 1, 2, 1]


@pytest.mark.parametrize(
    ("text", "label"),
    [('{"label":0}', 0), ('x {"label": "2"} y', 2), ("```json\n{\"label\":1}\n```", 1), ("The label is 2.", 2), ("label: 0, label: 1", None), ('{"label":true}', None), ('{"label":"neutral"}', 1), ("", None), (None, None)],
)
def test_answers(text, label):
    assert judge.label_of(text) == label


def test_retries():
    assert judge.wait_before(500, 1) == 2.0 and judge.wait_before(500, 2) is None
    assert [judge.wait_before(429, n) for n in (1, 2, 3)] == [2.0, 4.0, None]
    assert judge.wait_before(429, 1, 60) == 10.0 and judge.wait_before(404, 1) is None
    answers, slept = [judge.Reply(429, "", 3, 1), judge.Reply(200, "ok", 5, 2)], []
    assert judge.HttpJudge(lambda p, o: answers.pop(0), slept.append).one("x") == ("ok", 2, 8, 3) and slept == [2.0]


def test_endpoint_fallbacks():
    """A refused format and a refused name cost a request each, and are remembered."""
    seen = []

    def post(prompt, options):
        seen.append((options["model"], options["response_format"]))
        if options["response_format"]:
            return judge.Reply(400, "unknown field response_format")
        return judge.Reply(404, "no such model") if options["model"] == "a" else judge.Reply(200, prompt)

    asked = judge.HttpJudge(post, lambda s: None, models=["a", "b"], schema={"type": "object"})
    state = asked.start()
    assert asked.one("x", state)[:2] == ("x", 3) and asked.one("y", state)[:2] == ("y", 1)
    assert seen == [("a", {"type": "object"}), ("a", None), ("b", None), ("b", None)] and state["extra"] == 1
    refuse = judge.HttpJudge(lambda p, o: judge.Reply(404, "no such model"), lambda s: None, models=list("abcdefg"))
    assert refuse.one("x")[:2] == (None, 4)
    slept, times = [], iter([0.0, 0.0, 1.0, 3.0, 9.0, 9.0])
    pace = judge.Pace(3.0, lambda: next(times), slept.append)
    for _ in range(3):
        pace.wait()
    assert slept == [2.0]


def test_answer_fields(spark):
    rows = ['{"finding": "Same", "paragraphs": [1, "2", true, 3.5]}', 'so {"same_ballot":false,"claims":["a "," ",  "b"]}', '{"claim":"x","paragraphs":[4,5]}', "nothing", '{"same_ballot":"true"}', None]
    df = spark.createDataFrame([(x,) for x in rows], "a string")
    a = F.col("a")
    got = df.select(judge.word_label(a, "finding", {"same": 0, "different": 2}), judge.numbers(a, "paragraphs"), judge.boolean(a, "same_ballot"), judge.texts_of(a, "claims"), judge.texts_of(a, "claim")).collect()
    assert [r[0] for r in got] == [0, None, None, None, None, None] and [r[1] for r in got] == [[1, 2], [], [4, 5], [], [], None]
    assert [r[2] for r in got] == [None, False, None, None, None, None] and got[1][3] == ["a", "b"] and got[2][4] == ["x"]
    heads = spark.sql("SELECT map('X-Backend', 'b1', 'Date', 'now') AS h").select(judge.identity(F.col("h"))).first()[0]
    assert heads == {"x-backend": "b1"}


def test_bm25_order(spark):
    docs = spark.createDataFrame([(0, "nothing here"), (1, "solar power plants"), (2, "power to all")], "doc int, text string")
    q = spark.createDataFrame([(7, "Solar power")], "q int, text string")
    got = rank.bm25(docs, q, "doc", "q").orderBy(F.desc("score")).collect()
    assert [r.doc for r in got] == [1, 2]


def test_gap_fill(spark):
    pages = spark.range(1, 31).select(F.lit("b").alias("g"), F.col("id").cast("int").alias("page"))
    kept = spark.createDataFrame([("b", 3), ("b", 7), ("b", 25)], "g string, page int")
    got = sorted(r.page for r in rank.gap_filled(kept, pages, "g").collect())
    assert got == [3, 4, 5, 6, 7, 8, 25, 26]


def test_chunks_keep_all_words():
    r = random.Random(3)
    text = " ".join("x" * r.randint(1, 30) for _ in range(400)) + " " + "y" * 950
    got = segment.cut_at_spaces(text, 100)
    assert all(len(c) <= 100 for c in got) and "".join(got).replace(" ", "") == text.replace(" ", "")
    packs = segment.sentences_packed("One. Two! Three? " * 20 + "z" * 250, 100)
    assert all(len(p) <= 100 for p in packs) and "".join(packs).replace(" ", "") == ("One.Two!Three?" * 20 + "z" * 250)


def test_paragraphs(spark):
    lines = ["Erste Vorlage: Etwas", "14", "Titel", "Dies ist eine lange Zeile, die den Absatz hier eröffnet und", "weiter führt, bis er endet.", "Noch eine lange Zeile, mit der ein zweiter Absatz beginnt, der", "auch wieder endet."]
    got = segment.paragraphs(spark.createDataFrame([(1, "\n".join(lines))], "id int, text string"), "id").orderBy("para_no").collect()
    assert [r.paragraph for r in got] == ["\n".join(lines[3:5]), "\n".join(lines[5:7])]


def test_text_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.stem_tokens(F.lit("Initiativen über CO2, a b"))) == ["initiat", "über", "co2"]
    assert one(T.display(F.lit("Volks-\n initiative  heute"))) == "Volksinitiative heute"
    assert one(T.char_grams(F.lit("abc"))) == [] and sorted(one(T.char_grams(F.lit("ab, cd")))) == ["ab c", "b cd"]
    assert one(T.halves(F.lit("One two. Three four. Five six"))) == ["One two. Three four.", "Five six"]
    assert one(T.halves(F.lit("no end"))) == []
    assert one(T.verbatim(F.lit("B  c"), F.lit("a b\nC d"))) == "b\nC"
    assert one(T.nfkc(F.lit("ﬁne"))) == "fine"
    assert [one(T.language(F.lit(x))) for x in ("der Hund und die Katze", "le chat et la table", "il gatto e la tavola", "zzz")] == ["de", "fr", "it", "de"]


def test_router(spark):
    claims = ["«Der Bundesrat ist laut Zusammenfassung dafür»", "Le comité d'initiative", "Secondo il Consiglio federale", "Niemand"]
    got = route.route(spark.createDataFrame([(c,) for c in claims], "text string")).collect()
    assert [r.part for r in got] == ["summary", "committee", "council", None]


def test_budget_skips_and_goes_on(spark):
    texts = ["a" * 900, "b" * 1500, "c" * 1000, "d" * 200]
    got = spark.createDataFrame([(texts,)], "x array<string>").select(evidence.within_budget(F.col("x"))).first()[0]
    assert [r.at for r in got] == [1, 3]
    long = spark.createDataFrame([(["e" * 3000, "f"],)], "x array<string>").select(evidence.within_budget(F.col("x"))).first()[0]
    assert [len(r.text) for r in long] == [2000]


def test_excerpt_with_neighbours(spark):
    """Cited ones first, then those before and after, in number order; the first alone may be cut."""
    one = lambda texts, cited: [tuple(r) for r in spark.createDataFrame([(texts, cited)], "t array<string>, c array<int>").select(evidence.excerpt(F.col("t"), F.col("c"))).first()[0]]
    texts = ["a" * 300, "b" * 300, "c" * 900, "d" * 300, "e" * 500]
    assert [n for n, _ in one(texts, [3, 3, 9, 5])] == [2, 3, 4, 5] and [n for n, _ in one(texts, [1])] == [1, 2]
    assert [(n, len(t)) for n, t in one(["x" * 2500, "y"], [1])] == [(1, 2000)] and one(texts, [7]) == []


def test_hedge(spark):
    paras = spark.createDataFrame([("c", 1, 4, "one"), ("c", 2, 5, "two"), ("c", 3, 5, "three")], "id string, para_no int, page int, text string")
    pages = spark.createDataFrame([("c", 4, "page four"), ("c", 5, " page five ")], "id string, page int, text string")
    items = spark.createDataFrame([("c", 1, 5, "two")], "id string, item_no int, page int, text string")
    got = evidence.hedged(items, paras, pages, spark.createDataFrame([("c", 2)], "id string, para_no int"), "id").orderBy("item_no").collect()
    assert [(r.page, r.text) for r in got] == [(5, "two"), (4, "one"), (5, "page five")]


def test_latin_square(spark):
    for n in (2, 3, 4):
        rows = spark.range(n).select(F.col("id").cast("int").alias("c"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("p"))
        got = {(r.c, r.p): r.a for r in rows.select("c", "p", intervals.arm_order(F.col("c"), F.col("p"), n).cast("int").alias("a")).collect()}
        assert all(sorted(got[c, p] for c in range(n)) == list(range(n)) for p in range(n))
        if n % 2 == 0:
            assert len({(got[c, p], got[c, p + 1]) for c in range(n) for p in range(n - 1)}) == n * (n - 1)


def test_intervals_against_a_scan(spark):
    r = random.Random(5)
    spans = [(s := r.randint(0, 300), s + r.randint(0, 20)) for _ in range(60)]
    df = spark.createDataFrame([("g", a, b) for a, b in spans], "g string, s long, e long")
    covered = len({t for a, b in spans for t in range(a, b)})
    most = max(sum(a <= t < b for a, b in spans) for t in range(330))
    assert intervals.union_length(df, "g").first().covered == covered
    assert intervals.max_concurrency(df.where("s < e"), "g").first().most == most


def test_nearest_is_all_pairs(spark, monkeypatch):
    """Odd vectors and ties too, over several blocks, as a join of all rows has them."""
    rng = random.Random(3)
    inf = float("inf")
    odd = [None, [], [0.0] * 4, [1.0, None, 0.0, 2.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [inf, 1.0, 0.0, 1.0], [1.0, 2.0]]
    vectors = [[rng.choice((-1.0, 0.5, 2.0)) for _ in range(4)] for _ in range(150)] + [[rng.gauss(0, 1) for _ in range(4)] for _ in range(150)] + odd * 2
    rng.shuffle(vectors)
    rows = spark.createDataFrame([(i if i % 29 else i // 2, i % 7 if i % 11 else None, v) for i, v in enumerate(vectors)] + [(None, 1, [1.0, 0.0, 0.0, 0.0])], "vec_id long, label int, v array<float>")
    queries = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("v").alias("q"))
    monkeypatch.setattr(nearest, "ROWS", 64)
    monkeypatch.setattr(nearest, "ASKS", 32)
    monkeypatch.setattr(nearest, "SCORES", 500)
    order = (F.round("score", 6).desc(), "vec_id")
    pairs = in_blocks(rows, queries, "query_id").where("vec_id <> query_id").withColumn("score", cosine(F.col("q"), F.col("v"))).drop("q", "v")
    best = lambda p: rank.top_k(p, "query_id", 5, *order).select("query_id", "rank", F.round("score", 6).alias("s"))
    rows_of = lambda df: sorted(map(str, df.collect()))
    assert rows_of(best(nearest.nearest(rows, queries, 5))) == rows_of(best(pairs))
    one = spark.createDataFrame([(i, i % 7, v) for i, v in enumerate(vectors)], "vec_id long, label int, v array<float>")
    ask = one.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    every = in_blocks(one, ask, "query_id").where("vec_id <> query_id").withColumn("score", cosine(F.col("q"), F.col("v")))
    assert rows_of(rank.top_k(nearest.nearest(one, ask, 5), "query_id", 5, *order)) == rows_of(rank.top_k(every.select("query_id", "vec_id", "label", "score"), "query_id", 5, *order))
    groups = lambda p: rank.top_k(p.groupBy("query_id", "label").agg(F.max(F.round("score", 6)).alias("score")), "query_id", 3, F.desc("score"), "label")
    assert rows_of(groups(nearest.nearest(rows, queries, 3, by="label"))) == rows_of(groups(pairs))
    half = [0.1234565, 1.0000005, -0.1234565, 2.5e-07, 5e-07, -5e-07, 0.9999995, 0.3]
    got = spark.createDataFrame([(x,) for x in half], "x double").select(F.round("x", 6)).collect()
    assert [round(float(x)) for x in nearest.half_up(np.array(half), 6)] == [round(r[0] * 1e6) for r in got]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_best_of_all_pairs(spark, monkeypatch, kind):
    """The first by each ranker and by fusion, with many ties, in several blocks, as rankings of all pairs have them."""
    r = random.Random(4)
    words = ["lion", "zebra", "plant", "sea", "sky", "gnu", "ant", "elk", "emu", "owl"]
    texts = [" ".join(r.choices(words[: r.randint(1, 10)], k=r.randint(1, 6))) for _ in range(400)] + ["", None, "none of them"]
    key = F.col("doc").cast(kind)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string").repartition(3).select(key.alias("doc"), "text")
    q = spark.createDataFrame([(i, " ".join(r.sample(words, r.randint(1, 5)))) for i in range(9)] + [(9, "unheard"), (10, "")], "q int, text string")
    monkeypatch.setattr(rankings, "BLOCK", 4)
    pairs = rank.postings(docs, q, "doc", "q")
    both = rank.bm25_of(pairs, "doc", "q").withColumnRenamed("score", "bm25").join(rank.shared_of(pairs, "doc", "q").withColumnRenamed("score", "terms"), ["q", "doc"])
    every = both.withColumn("none", F.lit(0.0))
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    found = rankings.found(docs, q, "doc", "q")
    assert len(found) > 1
    got = rankings.best(found, {"bm25": 5, "terms": 4, "none": 3})
    for name, k in (("bm25", 5), ("terms", 4), ("none", 3)):
        want = rank.top_k(every, "q", k, F.round(name, 9).desc(), "doc").select("q", "doc", "rank", F.round("bm25", 9), F.col("terms").cast("long"))
        assert rows_of(got.where(F.col("ranker") == name).select("q", "doc", "rank", F.round("score", 9), "shared")) == rows_of(want)
    fused = rank.fused(every.select("q", "doc", F.col("bm25").alias("score")), every.select("q", "doc", F.col("terms").alias("score")), "q", "doc")
    first = lambda s: rows_of(rank.top_k(s, "q", 5, F.round("score", 9).desc(), "doc").select("q", "doc", "rank", F.round("score", 9)))
    assert first(rankings.fused(found, 5)) == first(fused)


def test_pieces_go_on_in_parts(spark):
    """A worker holds the pieces of a few texts, not of a whole batch."""
    got = list(segment.chunked(3).func(iter([pd.Series(["ab cd", None] * 600)])))
    assert max(map(len, got)) <= segment.PART and [list(x) if x else None for y in got for x in y] == [["ab", "cd"], None] * 600


def test_selectors_cut_texts_once(spark, sf):
    from quillon.plans import catalog

    catalog.load()
    plan = catalog.QUERIES["task_b_selectors"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 1


def test_texts_are_not_sorted_for_numbers(spark, sf):
    """Places of chunks, and the paragraphs that are cited, are found without the texts."""
    from quillon.operators import context
    from quillon.plans import catalog

    catalog.load()
    plan = catalog.QUERIES["cited_paragraphs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation [doc_id" not in plan  # what is left are the few pages that hold them
    pages = spark.createDataFrame([("a", 2, "x " * 1200), ("a", 1, "y " * 700), ("b", 1, ""), ("b", 2, "z"), ("b", 3, None), ("b", 4, "w")], "doc string, page int, text string")
    got = context.pieces(pages)
    want = got.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy("page", "piece_no")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 6
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert all("text#" not in below for line, below in zip(lines, lines[1:]) if "Window [" in line)


def test_features_of_labelled_texts_only(spark, sf):
    from quillon.plans import catalog

    catalog.load()
    lines = catalog.QUERIES["accuracy_by_tag"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = min(i for i, x in enumerate(lines) if "Join Inner" in x)
    searched = [i for i, x in enumerate(lines) if "RLIKE" in x]
    assert searched and max(searched) < joined


def test_fuzzy():
    assert fuzzy.partial_ratio("abcd", "xxabcdyy") == 100.0
    assert fuzzy.partial_ratio("abcd", "xxabxdyy") == pytest.approx(75.0)
    r = random.Random(1)
    for _ in range(30):
        a, b = ("".join(r.choice("abc") for _ in range(n)) for n in (6, 14))
        spans = [b[:k] for k in range(1, 6)] + [b[i : i + 6] for i in range(9)] + [b[-k:] for k in range(1, 6)]
        assert fuzzy.partial_ratio(a, b) == pytest.approx(max([100.0 * (a in b), *(fuzzy.similarity(a, w) for w in spans)]))


def test_fuzzy_pairs_are_all_pairs(spark):
    """Passages within the other text, on either side, with edits, short and repetitive ones."""
    r = random.Random(5)
    say = lambda n: "".join(r.choice("abcdefgh ijklmnop") for _ in range(n))

    def edited(t, step):
        return "".join("#" if i % step == step - 1 else c for i, c in enumerate(t))

    left = [(i, say(r.choice([60, 200, 390]))) for i in range(12)] + [(20, "abcde"), (21, "ab" * 30), (22, None)]
    right = [(f"in{i}", t[7:52]) for i, t in left[:12]] + [(f"ed{i}", say(40) + edited(t, 11) + say(30)) for i, t in left[:12]]
    right += [(f"cut{i}", t[: len(t) * 9 // 10]) for i, t in left[:12]] + [("abc", "xxabcde"), ("ba", "ba" * 28 + "xab"), ("far", say(300)), ("null", None), ("end", left[0][1][: 52] + say(9))]
    got = fuzzy.fuzzy_pairs(spark.createDataFrame(left, "i long, t string"), spark.createDataFrame(right, "p string, s string"), ("i", "t"), ("p", "s")).collect()
    want = {(i, p): fuzzy.partial_ratio(t, s) for i, t in left for p, s in right if t is not None and s is not None}
    want = {k: x for k, x in want.items() if x >= 90}
    assert {(x.i, x.p): x.ratio for x in got} == pytest.approx(want)
    assert {k[1][:2] for k in want} >= {"in", "ed", "cu"}


def test_words_meet_many_stretches():
    """Texts on both sides, over several pieces, stretches and blocks of words: what is near is found, little else is."""
    r = random.Random(11)
    say = lambda n: "".join(r.choice("abcdefghijklmnop é😀") for _ in range(n))
    asked = [say(n) for n in (1, 5, 63, 64, 65, 130, 300, 390)]
    long = [say(r.randint(0, 600)) + "".join(c for c in t if r.random() > 0.06) + say(r.randint(0, 600)) for t in asked for _ in range(4)]
    short = [t[lo : lo + r.randint(1, len(t))] for t in asked for lo in (0, len(t) // 3)]
    found = [t for t in long + short + [say(n) for n in (1, 50, 64, 76, 436, 437, 512, 513, 900)] if t]
    codes = np.zeros(0x110000, np.uint8)
    letters = np.unique(fuzzy.points("".join(asked)))
    codes[letters] = np.arange(1, len(letters) + 1)
    held = fuzzy.Together(found, codes, len(letters) + 1, 391, 90.0)
    n, hits = np.array([len(t) for t in found]), 0
    for t in asked:
        got = {*held.near_short(fuzzy.Short(t, 90.0, codes, len(letters) + 1), n >= len(t)), *held.near_long(t, n < len(t))}
        for j, f in enumerate(found):
            a, b = sorted((t, f), key=len)
            within = [fuzzy.nearest_end(p, fuzzy.letters(p), b) <= fuzzy.edits(len(a), 90.0) * len(p) // len(a) for p in fuzzy.cut(a)]
            assert (j in got) == any(within)
            best = fuzzy.partial_ratio(t, f, 90.0)
            assert best == (fuzzy.partial_ratio(t, f, 90.0, fuzzy.ends_within(a, b, fuzzy.edits(len(a), 90.0))) if a not in b else 100.0)
            assert best < 90 or j in got
            hits += best >= 90
    assert hits > 30


def test_edits_to_the_nearest_stretch():
    r = random.Random(7)
    texts = ["".join(r.choice("abcd é😀") for _ in range(r.choice([1, 5, 33, 63, 64]))) for _ in range(60)]

    def plain(a, b):
        row = list(range(len(a) + 1))
        best = row[-1]
        for c in b:
            new = [0]
            for i, x in enumerate(a, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (x != c)))
            row, best = new, min(best, new[-1])
        return best

    long = "".join(r.choice("abcd é😀") for _ in range(150))
    want = [plain(t, long) for t in texts]
    assert [fuzzy.nearest_end(t, fuzzy.letters(t), long) for t in texts] == want
    assert fuzzy.Words(texts).nearest_ends(long).tolist() == want


def test_tolerant_lines(spark, tmp_path):
    (tmp_path / "in.jsonl").write_bytes(b'\xef\xbb\xbf{"id": 1, "booklet": {}}\r\n\r{"id": "1", "reference": {}}\nnot json\n{"id": 1, "reference": {}}\r{"x": 1}\n{"id": {"b": 1, "a": 2}, "t": "\xff"}')
    got = jsonl.json_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.id for r in got] == ["1", '"1"', None, "1", None, '{"a": 2, "b": 1}']
    assert {r.id: r.task for r in jsonl.cases(spark, str(tmp_path)).collect()} == {"1": "A", '"1"': "B", '{"a": 2, "b": 1}': "invalid"}


def test_manifests_and_resume(spark, tmp_path):
    for name in ("a", "b/c"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "run.json").write_text(json.dumps({"label": name}, indent=1))
    got = jsonl.manifests(spark, str(tmp_path), "label string").collect()
    assert {(r.label, r.run) for r in got} == {("a", "a"), ("b/c", "b/c")}
    assert [r.id for r in jsonl.resumed(spark.range(3), spark.range(2)).collect()] == [2]


def test_streams(spark, tmp_path):
    rows = [Row(id=i % 3, ts=f"2026-01-01 00:0{i}:00") for i in range(6)]
    spark.createDataFrame(rows).withColumn("ts", F.to_timestamp("ts")).write.json(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "id long, ts timestamp")
    streams.run_available(streams.first_wins(stream, "id", "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    seen = []
    streams.each_batch(streams.tumbling(stream, "ts", "2 minutes", "1 hour"), lambda df, n: seen.extend(r.n for r in df.collect()), str(tmp_path / "c2"))
    assert sum(seen) == 6


def test_order_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = segment.paragraphs(docs, "doc_id").agg(F.sum(F.xxhash64("doc_id", "para_no", "paragraph").cast("decimal(38,0)"))).first()
    b = segment.paragraphs(docs.orderBy(F.rand(3)).repartition(8), "doc_id").agg(F.sum(F.xxhash64("doc_id", "para_no", "paragraph").cast("decimal(38,0)"))).first()
    assert a == b


def test_contexts(spark):
    from quillon.operators import context

    pages = spark.createDataFrame([("b", i, f"{i} Steuern und Abgaben\n" + ("solar power " if i == 3 else "other words ") * 5) for i in range(1, 5)] + [("c", 1, "solar power")], "doc string, page int, text string")
    claims = spark.createDataFrame([(1, "b", "Solar power wins")], "claim int, doc string, text string")
    got = {name: sorted({r.page for r in context.select(name, pages, claims).collect()}) for name in context.VARIANTS}
    assert got["full"] == [1, 2, 3, 4] and got["closed-book"] == []
    first = context._bm25(context.pieces(pages), claims).orderBy(F.desc("score")).first()
    assert (first.doc, first.place) == ("b", 3) and 3 in got["bm25"] and 3 in got["hybrid"] and got["vote-section"] == [3, 4]
    with pytest.raises(ValueError, match="unknown context"):
        context.select("none such", pages, claims)


def test_store(spark, tmp_path):
    import struct

    import numpy as np
    from quillon.sources import store

    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "id int, line_no int, last string")
    assert {r.id: r.last for r in store.last_by_id(rows, "id", "line_no").collect()} == {1: "b", 2: "c"}
    files = spark.createDataFrame([(b"p1|p2",), (b"q",), (b"q",)], "content binary")
    reads = lambda b: b.decode().split("|")
    assert sorted((r.page, r.text) for r in store.cached_pages(files, str(tmp_path / "c"), reads).collect()) == [(1, "p1"), (1, "q"), (2, "p2")]

    def never(b):
        raise RuntimeError("read again")

    assert store.cached_pages(files.limit(1), str(tmp_path / "c"), never).count() == 2
    m = np.arange(12, dtype="<f4").reshape(3, 4)
    head = json.dumps({"w": {"dtype": "F32", "shape": [3, 4], "data_offsets": [0, m.nbytes]}}).encode()
    (tmp_path / "t.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + m.tobytes())
    got = store.tensor_rows(spark, str(tmp_path / "t.safetensors"), "w", 2).orderBy("row").collect()
    assert [list(r.vector) for r in got] == [[0.0, 1.0], [4.0, 5.0], [8.0, 9.0]]
    (tmp_path / ".env").write_text("# no\nexport A='1'\nB=2\n")
    assert store.settings_file(tmp_path / ".env", {"B": "3", "C": "4"}) == {"A": "1", "B": "3"}
    lines = [r.line for r in store.markdown_table(spark.createDataFrame([("x|y", 1)], "a string, b int")).orderBy("line_no").collect()]
    assert lines == ["| a | b |", "|---|---|", "| x\\|y | 1 |"]


def test_normal_forms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(T.plain(F.lit("ﬁne  Ｌ’É\xadté"))) == "fine l'été" and one(T.loose(F.lit("a-\nb"))) == "a- b" and one(T.evidence_form(F.lit("ｓo-\n so"))) == "soso"
    import unicodedata

    every = [chr(i) for i in range(0x250) if not 0xD800 <= i < 0xE000] + list("–—‘’“”„…•€‹›‰")
    rows = spark.createDataFrame([(c,) for c in every], "c string").select("c", T.nfkc(F.col("c")).alias("n"), F.col("c").rlike(T.PLAIN).alias("p")).collect()
    assert all(r.n == unicodedata.normalize("NFKC", r.c).replace("\xad", "") for r in rows) and all(r.n == r.c for r in rows if r.p)
    assert one(T.row_of(F.lit("v1.1-row-123-B"))) == (123, "B") and one(T.row_of(F.lit("x"))) == (None, None)


def test_booklets(spark):
    """A missing heading, a conflict of list and heading, and a shared overview cost their parts alone."""
    from quillon.operators import booklet

    text = {p: f"body {p}" for p in range(1, 31)}
    text[2] = "Klima\nIn Kürze 4-5\nÜbersicht 7\nIm Detail 8\nArgumente 12\nAbstimmungstext 16\nSteuern\nEn bref 6\nEn détail 18\nArguments 22\nTextes soumis au vote 26"
    heads = {4: "In Kürze", 6: "En bref", 8: "Im Detail\nArgumente Initiativkomitee 12\nArgumente Bundesrat 1 4", 12: "Argumente\nArgumente Initiativkomitee", 13: "Argumente Bundesrat", 16: "§ 1", 18: "En détail", 22: "Arguments du comité d'initiative", 24: "Arguments du Conseil fédéral", 26: "soumis au vote"}
    text |= {p: f"{h}\nbody" for p, h in heads.items()}
    pages = spark.createDataFrame([("b", p, t) for p, t in text.items()], "doc string, page int, text string")
    got = {r.vote_no: r for r in booklet.parse(pages).collect()}
    one, two = got[1], got[2]
    assert one.parts["summary"] == [4, 5] and one.parts["detail"] == [7, 8, 9, 10, 11] and one.parts["law"] == [16, 17] and "council" not in one.parts
    assert one.problems == ["council: list and heading differ"] and one.valid == ["detail", "law", "summary"]
    assert two.problems == [] and two.title == "Steuern" and two.parts["committee"] == [22, 23] and two.parts["council"] == [24, 25] and two.parts["law"] == [26, 27, 28, 29]
    boxed = spark.createDataFrame([("b", 4, "Ja\nEine Minderheit des Parlaments will die Vorlage unbedingt annehmen.\nparlament.ch/x\nNein\nzu kurz\n12 Ja")], "doc string, page int, text string")
    found = booklet.boxes(boxed, spark.createDataFrame([("b", 1, {"summary": [4]}, ["summary"])], "doc string, vote_no int, parts map<string,array<int>>, valid array<string>")).collect()
    assert sorted((r.voice, r.text[:8]) for r in found) == [("parliament", "12 Ja"), ("parliament", "Ja\nEine ")]
    names = spark.createDataFrame([("b", "Klima"), ("b", "Verkehr"), ("c", "Klima")], "doc string, name string")
    assert {(r.doc, r.name): r.vote_no for r in booklet.find_votes(names, booklet.parse(pages)).collect()} == {("b", "Klima"): 1, ("b", "Verkehr"): None, ("c", "Klima"): None}


def test_case_kinds(spark):
    from quillon.operators import dispatch

    rows = [("A", "law", ["law"]), ("A", None, ["law"]), ("A", "law", []), ("A", "law", ["detail"]), ("A", None, []), ("B", None, []), (None, "law", ["law"])]
    df = spark.createDataFrame(rows, "task string, part string, valid array<string>")
    assert [r[0] for r in df.select(dispatch.kind(F.col("task"), F.col("part"), F.col("valid"))).collect()] == ["paragraphs", "ask-part", "ask-structure", "pages", "pages", "passage", "done"]
    assert dispatch.effective("e5+BM25", {"e5"}) == "BM25" and dispatch.effective("S", {"S"}) == "none" and dispatch.effective("S", {"e5"}) == "S"
    with pytest.raises(ValueError, match="unknown ranker"):
        dispatch.effective("x")
    assert dispatch.schema("excerpt")["properties"]["finding"]["enum"] == ["same", "different", "nothing"]
