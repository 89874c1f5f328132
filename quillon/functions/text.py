"""Text as Column expressions: normal forms, tokens, grams, numbers, tags.

Everything here runs inside the JVM but what nfkc() changes, for which Spark has no built-in.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Lengths that tokens, headers and openings are cut to.
STEM, HEADER, OPENING = 7, 160, 300
#: The most common short words by which languages are told apart, in tie order.
STOPWORDS: dict[str, tuple[str, ...]] = {
    "de": ("der", "die", "das", "und", "ist", "nicht", "mit", "von", "den", "dem", "des", "ein", "eine", "auf", "für", "werden", "wird", "sich", "auch", "dass", "bei", "nach"),
    "fr": ("le", "la", "les", "et", "est", "des", "une", "pour", "dans", "que", "qui", "pas", "sur", "par", "au", "aux", "du", "ne", "sont", "avec", "cette", "être"),
    "it": ("il", "la", "le", "e", "è", "di", "che", "per", "una", "non", "con", "del", "della", "dei", "gli", "nel", "sono", "alla", "anche", "come", "questo", "essere"),
}


#: Characters that stand in compatibility form already, whatever stands beside them.
PLAIN = (
    "^[\\x00-\\x7f\\u00a1-\\u00a7\\u00a9\\u00ab\\u00ac\\u00ae\\u00b0\\u00b1\\u00b6\\u00b7\\u00bb\\u00bf-\\u0131"
    "\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e\\u2010\\u2012-\\u2016\\u2018-\\u2022\\u2030\\u2039\\u203a\\u20ac]*$"
)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).replace("\xad", ""))


def nfkc(text: Column) -> Column:
    """Unicode compatibility form, without soft hyphens; null stays null.

    Texts that are in it already, as nearly all in Latin scripts are, never reach Python.
    """
    done = text.rlike(PLAIN)
    return F.when(done, text).otherwise(_nfkc(F.when(~done, text)))


def join_hyphens(text: Column, *, spaced: bool = True) -> Column:
    """Joins words that a hyphen splits over a line break."""
    gap = r" ?-\s*\n\s*" if spaced else r"-\s*\n\s*"
    return F.regexp_replace(text, rf"([\p{{L}}\p{{N}}_]){gap}([\p{{L}}\p{{N}}_])", "$1$2")


def squeeze(text: Column) -> Column:
    """White space runs (no-break spaces too) become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, "[\\s\u00a0]+", " "))


def folded(text: Column) -> Column:
    """plain() of a text in compatibility form."""
    return F.lower(squeeze(F.replace(text, F.lit("’"), F.lit("'"))))


def plain(text: Column) -> Column:
    """Compatibility form, lower case, typewriter apostrophes, single spaces: the norm of headings."""
    return folded(nfkc(text))


def retrieval_form(text: Column) -> Column:
    """Lower case, single spaces, words joined over line breaks."""
    return F.lower(squeeze(join_hyphens(text, spaced=False)))


def evidence_form(text: Column) -> Column:
    """Compatibility form, lower case, single spaces, words joined over line breaks."""
    return F.lower(squeeze(join_hyphens(nfkc(text))))


def loose(text: Column) -> Column:
    """Compatibility form, lower case, single spaces; line breaks split words as they do."""
    return F.lower(squeeze(nfkc(text)))


def display(text: Column) -> Column:
    return squeeze(join_hyphens(text))


def opening(text: Column) -> Column:
    """A claim's opening as the router reads it: plain, without leading quotes and dashes."""
    return F.regexp_replace(plain(F.replace(text, F.lit("`"), F.lit("'"))), "^[\\s\"'«»„“”‚‘’‹›–—-]+", "")


def header(text: Column) -> Column:
    """The first characters of a page, without a leading page number."""
    return F.substring(plain(F.regexp_replace(text, r"^\s*\d+\s*", "")), 1, HEADER)


def stem_tokens(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]{2,})"), 1)
    return F.transform(words, lambda w: F.substring(w, 1, STEM))


def title_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{4,})"), 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it, in lambdas too."""
    return F.transform(F.array(value), use)[0]


def char_grams(text: Column, n: int = 4) -> Column:
    """The set of character n-grams of the text without punctuation; empty if it is shorter."""
    flat = squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))

    def grams(f: Column) -> Column:
        # A look-ahead matches at every place and captures the n characters from there.
        return F.array_distinct(F.filter(F.regexp_extract_all(f, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1), lambda g: F.length(g) == n))

    return grams(flat)


def number_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,']\d+)*)"), 1))


def decimals(text: Column) -> Column:
    """Numbers with their decimals: [(value, decimals)], thousands separators removed."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,3}(?:[',]\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"), 1)
    clean = F.transform(found, lambda x: F.regexp_replace(x, "[',]", ""))
    return F.transform(clean, lambda x: F.struct(x.cast("double").alias("value"), F.when(F.contains(x, F.lit(".")), F.length(F.substring_index(x, ".", -1))).otherwise(0).alias("decimals")))


def first_line(text: Column) -> Column:
    return F.trim(F.split(F.trim(F.regexp_replace(text, r"^\s+", "")), "\n", 2)[0])


def language(text: Column, stopwords: Mapping[str, Sequence[str]] = STOPWORDS, default: str = "de") -> Column:
    """The language whose stopwords are most; ties to the first, none at all to the default."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)

    def among(known: Sequence[str]) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known)))

    counts = {k: among(v) for k, v in stopwords.items()}
    most = F.greatest(*counts.values())
    out = F.when(most == 0, default)
    for k, c in counts.items():
        out = out.when(c == most, k)
    return out


def tags(text: Column, rules: Mapping[str, str]) -> Column:
    """The names of the rules (regular expressions) that match, in their order."""
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(r), F.lit(k)) for k, r in rules.items())))


def cause(problem: Column) -> Column:
    """A problem without its particulars: lists become [...], numbers N."""
    return F.regexp_replace(F.regexp_replace(problem, r"\[[^\]]*\]", "[...]"), r"\d+", "N")


def strip_code(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"`[^`]*`", " "), r"https?://\S+", " ")


def cell(text: Column) -> Column:
    """Text for a table cell: line breaks, pipes and backticks replaced."""
    out = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    return F.replace(out, F.lit("`"), F.lit("'"))


def page_markers(pages: Column) -> Column:
    """Pages [(page, text)] as one text in page order, each under its marker."""
    return F.array_join(F.transform(F.array_sort(pages), lambda x: F.concat(F.lit("=== PAGE "), x["page"].cast("string"), F.lit(" ===\n"), x["text"])), "\n\n")


def row_of(name: Column) -> Column:
    """The number and task in a row's name like v1.1-row-123-B: (row, task); null where it has none."""
    form = r"-row-(\d+)(?:-([A-Za-z]+))?$"
    task = F.regexp_extract(name, form, 2)
    return F.struct(F.regexp_extract(name, form, 1).try_cast("int").alias("row"), F.when(task != "", task).alias("task"))


def numbered(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n\n")


def halves(text: Column) -> Column:
    """The text's two halves, cut after the sentence end nearest its middle; none inside: empty."""
    none = F.array().cast("array<string>")

    def ends(t: Column) -> Column:
        """Places after a sentence's last mark, before white space, as running sums of lengths."""
        parts = F.split(t, r"(?<=[.!?])(?=\s)")
        sums = F.aggregate(parts, F.array().cast("array<int>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + F.length(x))))
        return F.filter(sums, lambda e: e < F.length(F.rtrim(t)))

    def cut(p: Column) -> Column:
        t = p["t"]
        near = F.array_min(F.transform(p["ends"], lambda e: F.struct(F.abs(e * 2 - F.length(t)).alias("far"), e.alias("at"))))["at"]
        both = let(near, lambda at: F.array(F.trim(F.substr(t, F.lit(1), at)), F.trim(F.substr(t, at + 1, F.length(t)))))
        return F.when(F.size(p["ends"]) > 0, F.filter(both, lambda h: h != "")).otherwise(none)

    return let(let(text, lambda t: F.struct(t.alias("t"), ends(t).alias("ends"))), cut)


def verbatim(needle: Column, hay: Column) -> Column:
    """The place where hay has needle: exactly, else but for white space, else in either case.

    Returns hay's own characters, or null. Exact hits never reach Python.
    """
    return F.when(F.contains(hay, needle), needle).otherwise(_loose(needle, hay))


@F.pandas_udf(StringType())
def _loose(needle: pd.Series, hay: pd.Series) -> pd.Series:
    import re

    def find(n: str | None, h: str | None) -> str | None:
        words = (n or "").split()
        if not words or h is None:
            return None
        pattern = r"\s+".join(map(re.escape, words))
        m = re.search(pattern, h) or re.search(pattern, h, re.I)
        return m[0] if m else None

    return pd.Series([find(n, h) for n, h in zip(needle, hay)], dtype=object)
