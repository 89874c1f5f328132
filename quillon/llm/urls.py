"""URL filters: pattern rules behind an index of their rarest literal tokens (operator 8).

A pattern is literal text with `*` for anything and `^` for a boundary (the start, the end or a
character that is neither letter nor digit). Its literal tokens are the runs of letters and
digits between boundaries, so a URL that fits has each of them among its own tokens. A grouped
aggregation counts the patterns' tokens over the URLs; each pattern is filed under its rarest
one. A URL's tokens fetch the candidate patterns, and only those run as regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The method's own patterns; those with @@ are exceptions.
PATTERNS = (
    "^casino^", "^poker^", "^slots^", "^lottery^", "^viagra^", "^pills^", "^xxx^", "^porn^", "^escort^", "^malware^", "^phishing^",
    "^adserver^", "^doubleclick^", "^popunder^", "^warez^", "^crack^*^download^", "^free^money^", "^torrent^*^download^", "@@^casino^*^museum^",
)
_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def compiled(pattern: str) -> str:
    """The pattern as a regular expression (of a form that Java, RE2 and Python read alike)."""
    to = {"*": ".*", "^": "(?:^|$|[^0-9a-z])"}
    return "(?s)" + "".join(to.get(c) or re.escape(c) for c in pattern.removeprefix("@@"))


def tokens(pattern: str) -> list[str]:
    return re.findall(r"(?<=\^)[0-9a-z]+(?=\^)", pattern.removeprefix("@@"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), *_AZ), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fitting(rules: Sequence[tuple[str, str, str]]):
    """A function from host and path to (rule, verdict) of the longest rule that fits, else (None, None)."""
    by_host: dict[str, list[tuple[int, int, str, str]]] = {}
    for i, (said, host, path) in enumerate(rules):
        by_host.setdefault(host, []).append((len(host + path), i, path, said))

    def find(host: str, path: str) -> tuple[str | None, str | None]:
        best, at = None, 0
        while True:
            name = host[at:]
            for size, i, start, said in by_host.get(name, ()):
                if path.startswith(start) and (best is None or (size, i) > best[:2]):
                    best = (size, i, name + start, said)
            at = host.find(".", at) + 1
            if not at:
                return best[2:] if best else (None, None)

    return find


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, patterns: Sequence[str] = PATTERNS) -> DataFrame:
    """The verdict on each URL: that of the longest rule that fits, else that of the patterns.

    Returns page_id, host, path, rule (like `net/`; null if none fits), verdict (allow or block)
    and pattern (the first that matched, else null). Of rules of one length the last listed wins.
    One row for each input row, repeated rows and null ids included; a null URL or one without
    :// has an empty host and path and falls to the patterns, which allow what they don't match.
    Both lists are configuration: their size doesn't grow with the pages. A URL meets the rules of
    its host and of the domains above it, and the patterns filed under one of its tokens.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    low = F.translate(F.coalesce("url", F.lit("")), *_AZ)
    words = F.array_distinct(F.regexp_extract_all(low, F.lit("([0-9a-z]+)"), 1))
    known = sorted({t for p in patterns for t in tokens(p)})
    asked = F.broadcast(spark.createDataFrame([(t,) for t in known], "token string"))
    counted = urls.select(F.explode(words).alias("token")).join(asked, "token").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    often = {r.token: r.n for r in counted.collect()}  # a row for each token of the patterns at most
    index: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        found = tokens(p)
        index.setdefault(min(found, key=lambda t: (often.get(t, 0), t)) if found else "", []).append(i)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests, rule_of = [re.compile(compiled(p)) for p in patterns], _fitting(rules)
        split = re.compile("[0-9a-z]+").findall
        for batch in batches:
            hits, fits = [], []
            for host, path, url in zip(*(c.to_pylist() for c in batch.columns[1:])):
                asked = sorted({i for t in {"", *split(url)} for i in index.get(t, ())})
                found = [patterns[i] for i in asked if tests[i].search(url)]
                hits.append(next((p for p in found if p.startswith("@@")), found[0] if found else None))
                rule, said = rule_of(host, path)
                fits.append((rule, said or ("allow" if hits[-1] is None or hits[-1].startswith("@@") else "block")))
            rule, said = (pa.array([x[k] for x in fits], pa.string()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], rule, said, pa.array(hits, pa.string())], names=["page_id", "host", "path", "rule", "verdict", "pattern"])

    made = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), low.alias("low"))
    return made.mapInArrow(match, "page_id long, host string, path string, rule string, verdict string, pattern string")


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES, patterns: Sequence[str] = PATTERNS) -> str:
    """The same in DuckDB SQL, by running every pattern on every URL."""
    hit = "CASE " + " ".join(f"WHEN regexp_matches(low, '{compiled(p)}') THEN '{p}'" for p in sorted(patterns, key=lambda p: not p.startswith("@@"))) + " END"
    rule, verdict = "NULL", "CASE WHEN pattern IS NULL OR pattern LIKE '@@%' THEN 'allow' ELSE 'block' END"
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{host}{path}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{said}' ELSE {verdict} END"
    az = f"'{_AZ[0]}', '{_AZ[1]}'"
    return f"""WITH a AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {az}) AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, translate(coalesce(url, ''), {az}) AS low FROM pages),
b AS (SELECT page_id, host, path, {hit} AS pattern FROM a)
SELECT page_id, host, path, CAST({rule} AS VARCHAR) AS rule, {verdict} AS verdict, pattern FROM b"""
