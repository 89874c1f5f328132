"""Secret scans with corpus-wide ownership frequency (operator 6).

One pass finds the base spans and more candidates (key blocks, tokens of known forms, words of
high entropy). Each candidate's value is hashed, and the hashes are aggregated over the corpus:
documents, distinct repositories, distinct owners. A value that many owners share is a widely
copied example; one that stays with an owner looks live. The base spans always stay; of the
further candidates those are added that look live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import bounded, fresh, settle, small_batches, texts, trim

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Forms that are added to the base ones, by kind.
FORMS = {
    "pem": re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----"),
    "jwt": re.compile(r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_.-]{38,}"),  # a maximal run; see tokens()
    "prefixed": re.compile(r"(?:gh[pousr]_|xox[baprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}"),
    "entropy": re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}(?![A-Za-z0-9+/_=-])"),
}
KINDS = ("assign", "access", "hex", *FORMS)
#: From so many distinct owners, or repositories, on a value counts as widely copied.
OWNERS, REPOSITORIES = 3, 5


def base(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base spans."""
    out = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _random_looking(word: str) -> bool:
    if not (any(c.isdigit() for c in word) and any(c.islower() for c in word) and any(c.isupper() for c in word)):
        return False
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) >= 3.5


def tokens(run: str) -> Iterator[tuple[int, int]]:
    """Start and end of the JWTs in a run of parts and dots, of any length, in one pass."""
    parts, starts, at = run.split("."), [], 0
    for p in parts:
        starts.append(at)
        at += len(p) + 1
    i = 0
    while i + 2 < len(parts):
        head, payload, mark = parts[i : i + 3]
        first = head.find("eyJ")
        if first >= 0 and len(head) - first >= 13 and payload.startswith("eyJ") and len(payload) >= 13 and len(mark) >= 10:
            yield starts[i] + first, starts[i + 2] + len(mark)
            i += 3
        else:
            i += 1


def found_by(kind: str, form: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in form.finditer(text):
        if kind == "jwt":
            for s, e in tokens(m[0]):
                yield m.start() + s, m.start() + e
        elif kind != "entropy" or _random_looking(m[0]):
            yield m.start(), m.end()


def more(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Further candidates that overlap no span found before."""
    out: list[tuple[int, int, int, str]] = []
    taken: bytearray | None = None
    for k, (kind, form) in enumerate(FORMS.items(), 3):
        for s, e in found_by(kind, form, text):
            if taken is None:
                taken = bytearray(len(text))
                for x, _, y, _ in spans:
                    taken[x:y] = b"\1" * (y - x)
            if taken.find(1, s, e) < 0:
                taken[s:e] = b"\1" * (e - s)
                out.append((s, k, e, text[s:e]))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    me, row = TaskContext.get().partitionId() << 40, 0
    item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64())])
    for batch in batches:
        uid, counts, shas, found = [], ([], [], []), [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            spans = base(text)
            for k in range(3):
                counts[k].append(sum(x[1] == k for x in spans))
            shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans).encode()).hexdigest())
            found.append([(s, k, e, int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big", signed=True)) for s, k, e, v in sorted(spans + more(text, spans))])
            uid.append(me + row)
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(uid, pa.int64()), batch.column(0), batch.column(2), batch.column(3), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(found, pa.list_(item))], names=["uid", "doc_id", "source", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "found"])
    trim()


def scan(docs: DataFrame, *, with_key: bool = False) -> DataFrame:
    """Spans of secrets for each document, judged by who else has the same value.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end by start, then
    kind; code points, end exclusive), n_live and n_example (spans by ownership). Repository is
    the column source, owner its part before a slash. One row for each input row: a null or
    empty text has no spans, a null source counts as one more repository, repeated rows count
    as documents of the same owner.
    """
    found = settle(
        texts(docs, "source").withColumn("text_key", F.xxhash64("text")).mapInArrow(
            _scan, "uid long, doc_id long, source string, text_key long, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:long,kind:int,end:long,value:long>>"
        )
    )
    each = found.where(F.size("found") > 0).select("uid", "source", F.explode("found").alias("x")).select("uid", F.coalesce("source", F.lit("")).alias("source"), "x")
    # A row for each value and repository first: a hot repository's rows combine before the shuffle.
    held = each.groupBy(F.col("x.value").alias("value"), "source").agg(F.count(F.lit(1)).alias("n"))
    held = held.groupBy("value").agg(F.count(F.lit(1)).alias("repos"), F.countDistinct(F.substring_index("source", "/", 1)).alias("owners"))
    wide = held.where((F.col("owners") >= OWNERS) | (F.col("repos") >= REPOSITORIES)).select("value", F.lit(True).alias("wide"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), F.col("x.kind") + 1)
    judged = each.withColumn("value", F.col("x.value")).join(wide, "value", "left").withColumn("wide", F.coalesce("wide", F.lit(False)))
    label = F.concat_ws(":", kind, F.col("x.start"), F.col("x.end"))
    judged = judged.groupBy("uid").agg(
        F.collect_list(F.when(~F.col("wide") | (F.col("x.kind") < 3), F.struct("x.start", "x.kind", label.alias("label")))).alias("kept"),
        F.sum((~F.col("wide")).cast("long")).alias("n_live"),
        F.sum(F.col("wide").cast("long")).alias("n_example"),
    )
    judged = judged.withColumn("spans", F.concat_ws(",", F.transform(F.array_sort("kept"), lambda x: x["label"]))).drop("kept")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return found.join(judged, "uid", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), zero("n_live"), zero("n_example"), *["text_key"] * with_key)


def masked(text: str, spans: str, mark: str) -> str:
    """The text with `mark` in place of each span; overlapping spans are replaced together."""
    out, at = [], 0
    for a, b in sorted((int(a), int(b)) for _, a, b in (x.split(":") for x in spans.split(",") if x)):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, *, mark: str = "[SECRET]") -> DataFrame:
    """docs with all spans of scan() replaced by `mark` in their texts; other columns stay.

    Rows are found again by doc_id (null is one more id) and a hash of their text; a null text
    stays null.
    """
    doc, key, to = (fresh(docs, x) for x in ("span_doc", "span_key", "span_list"))
    spans = settle(scan(docs, with_key=True).where("spans <> ''").select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("spans").alias(to)).distinct())
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def replaced(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([masked(t, s, mark) if s else t for t, s in zip(text, spans)])

    joined = docs.join(bounded(spans, to), same, "left")
    columns = (F.when(F.col(to).isNotNull(), replaced("text", to)).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns)
    return joined.select(*columns)
