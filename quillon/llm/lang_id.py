"""Language identification by Bayesian fusion of evidence (operator 9).

The text gives a likelihood for each language (hashed byte n-grams, fitted on a bounded sample
of labelled rows). The declared markup language and the address suffix each give a likelihood
from grouped counts over the corpus. The host gives a prior, smoothed level by level: a host's
counts toward its domain's, those toward the whole corpus's. The posterior is their product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm._common import row_key, settle, small_batches, trim
from quillon.llm._shingle import by_bytes, mix, utf8

_U = np.uint64
#: Labelled rows that the text model is fitted on at most, drawn for each label by a hash.
SAMPLE = 2000
SLOTS = 1 << 16
#: Bytes of text that are scored at a time; each takes dozens of bytes of memory for a while.
BATCH = 500_000
#: The class of what fits no known language: bytes as likely as any other.
UNKNOWN = "und"
#: Weight of a parent level, in documents, for host and domain; and of the text's n-grams,
#: which overlap and so count less than independent evidence would.
PARENT = 20.0
TEMPER = 1 / 3


def _slots(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A slot for each trigram of lower-cased letters that lies within a text, and its text.

    Bytes other than letters become one blank, so figures and marks say nothing of the language.
    """
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    low = np.where(((low >= 97) & (low <= 122)) | (low >= 128), low, 32).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(g)]
    ok = (np.arange(len(g)) + 3 <= off[1:][row]) & ((low[:-2] != 32) | (low[1:-1] != 32)) & ((low[1:-1] != 32) | (low[2:] != 32))
    return (g[ok] * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64), row[ok]


class TextModel:
    """Log likelihoods of texts; the last class is UNKNOWN."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = [*languages, UNKNOWN], logs

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> TextModel:
        languages = sorted(set(labels))
        counts = np.zeros((SLOTS, len(languages) + 1))
        for k, x in enumerate(languages):
            slot, _ = _slots(*utf8(pa.array([t for t, y in zip(texts, labels) if y == x], pa.string())))
            counts[:, k] = np.bincount(slot, minlength=SLOTS)
        logs = np.log((counts + 0.05) / (counts.sum(0) + 0.05 * SLOTS))
        logs[:, -1] = -np.log(SLOTS)
        return cls(languages, logs.astype(np.float32))

    def score(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """A row of log likelihoods for each text, and how many trigrams they rest on."""
        data, off = utf8(column)
        slot, row = _slots(data, off)
        ends = np.searchsorted(row, np.arange(len(off)))
        out = np.zeros((len(off) - 1, len(self.languages)))
        for at in range(0, len(slot), 1 << 20):  # sums stay exact to many digits in pieces
            part, r = self.logs[slot[at : at + (1 << 20)]].astype(np.float64), row[at : at + (1 << 20)]
            edges = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            np.add.at(out, r[edges], np.add.reduceat(part, edges, 0))
        return out, np.diff(ends)


def _quotas(counts: dict[str, int], total: int) -> dict[str, int]:
    """Rows to draw of each label, `total` in all: as many of each, where it has them, and one at least."""
    out: dict[str, int] = {}
    left = total
    for k, x in enumerate(sorted(counts, key=lambda x: (counts[x], x))):
        out[x] = max(1, min(counts[x], left // (len(counts) - k)))
        left -= out[x]
    return out


def fit_text(labelled: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> TextModel:
    """The text model of at most `sample` labelled rows, dealt evenly over all labels there are.

    Of each label the first by a hash of key and text. Every label has a row, whatever its share:
    more labels than `sample` give one row each.
    """
    rows = labelled.where(F.col(label).isNotNull() & (F.length(text) > 0)).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(key, text).alias("h"))
    # Hashes first: tasks send those alone, and texts only of about the rows drawn.
    seen = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("distinct"), F.min("h").alias("least")).collect()
    if not seen:
        return TextModel.fit([], [])
    quota = _quotas({r.label: r.n for r in seen}, sample)
    most = (1 << 63) - 1
    upto = {r.label: max(r.least, min(most, int((1 << 64) * 1.5 * (quota[r.label] + 20) / max(1, r.distinct)) - (1 << 63))) for r in seen}
    limits = labelled.sparkSession.createDataFrame(list(upto.items()), "label string, upto long")
    got = rows.join(F.broadcast(limits), "label").where("h <= upto").dropDuplicates(["label", "h"]).select("label", "h", "text").collect()
    drawn: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.label, r.h)):
        mine = drawn.setdefault(r.label, [])
        if len(mine) < quota[r.label]:
            mine.append(r.text)
    return TextModel.fit([t for x in drawn.values() for t in x], [k for k, x in drawn.items() for _ in x])


def visible(html: Column) -> Column:
    """A page's text: without scripts, styles, comments, tags and entities."""
    cut = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#0-9A-Za-z]{1,10};", " ")
    return F.coalesce(cut, F.lit(""))


def declared(html: Column) -> Column:
    """The primary subtag that the markup's root element declares, lower-cased; else empty."""
    return F.coalesce(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})\b""", 1)), F.lit(""))


def evidence_key(docs: DataFrame) -> Column:
    """row_key() of documents with what else is judged: the source."""
    return row_key(F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string"))


def suffix_of(host: Column) -> Column:
    """The last label of an address of several labels that isn't a number, without a port; else empty."""
    last = F.regexp_extract(host, r"\.([^.:@]*[^.:@0-9][^.:@]*)(?::\d*)?$", 1)
    return F.coalesce(last, F.lit(""))


def identify(rows: DataFrame, model: TextModel, *, least: float = 0.3) -> DataFrame:
    """Fuses the evidence of rows (key, text, declared, host): (key, lang, confidence, accepted).

    `declared` is the markup's language and `host` the host's name; either may be null or empty
    and then says nothing, as does a host without a suffix of its suffix. The counts behind their
    likelihoods and priors come from all rows, by what their texts alone say. A null or empty
    text, or one without letters, is judged by the other evidence. lang is 'und' where no known
    language explains the text better than bytes drawn evenly: that is so for languages that no
    labelled row has, unless a known one is close. Equal posteriors go to the language first by
    name. accepted says that lang is known and its posterior is `least` at least. One row for each
    input row; repeated rows count each. A column row_key of rows goes through.
    """
    spark = rows.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # SLOTS times the languages, whatever the data
    n = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for b in by_bytes(whole, 1, BATCH):
                scores, count = m.score(b.column(1))
                logs = (scores - scores.max(1, keepdims=True)) * TEMPER
                best = np.where(count > 0, scores.argmax(1), -1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(2), b.column(3), b.column(4), pa.array(logs.tolist(), pa.list_(pa.float64())), pa.array(best, pa.int32())],
                    names=["key", "declared", "host", "row_key", "logs", "best"],
                )
        trim()

    text = F.coalesce("text", F.lit(""))
    through = F.col("row_key") if "row_key" in rows.columns else F.lit(0).cast("long")
    plain = rows.select(F.col("key").cast("long").alias("key"), text.alias("text"), F.lower(F.coalesce("declared", F.lit(""))).alias("declared"), F.lower(F.coalesce("host", F.lit(""))).alias("host"), through.alias("row_key"))
    read = settle(plain.mapInArrow(run, "key long, declared string, host string, row_key long, logs array<double>, best int").withColumn("suffix", suffix_of(F.col("host"))))
    seen = read.where("best >= 0").select("declared", "suffix", F.substring_index("host", ".", -2).alias("domain"), "host", "best")
    # One pass makes the finest counts; every coarser table sums those.
    fine = settle(seen.groupBy("suffix", "domain", "host", "declared", "best").agg(F.count(F.lit(1)).alias("n")))

    def counts(*by: str) -> DataFrame:
        """(by, c): the documents of each language, as an array."""
        one = F.array(*(F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)).cast("double") for k in range(n)))
        return fine.groupBy(*by).agg(one.alias("c"))

    def smoothed(c: Column, parent: Column) -> Column:
        """(counts + PARENT * parent) / (their total + PARENT)."""
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + x) + PARENT
        return F.zip_with(c, parent, lambda x, p: (x + p * PARENT) / total)

    whole = fine.agg(F.array(*(F.coalesce(F.sum(F.when(F.col("best") == k, F.col("n")).otherwise(0)), F.lit(0)).cast("double") for k in range(n))).alias("c")).first().c
    total = sum(whole) + PARENT
    base = F.array(*(F.lit((x + PARENT / n) / total) for x in whole))
    prior = counts("domain").select("domain", smoothed(F.col("c"), base).alias("p_domain"))
    prior = counts("domain", "host").join(prior, "domain").select("host", F.when(F.col("host") == F.col("domain"), F.col("p_domain")).otherwise(smoothed(F.col("c"), F.col("p_domain"))).alias("prior"))
    joined = read.join(prior, "host", "left")
    post = F.transform(F.coalesce("prior", base), lambda x: F.log(x))
    # How often documents of each language declare this, or have this suffix, against all: what a
    # declaration or a suffix of its own says, whatever else is known.
    for by in ("declared", "suffix"):
        said = counts(by).where(F.col(by) != "").select(by, smoothed(F.col("c"), base).alias("p"))
        joined = joined.join(said.select(by, F.zip_with("p", base, lambda x, p: F.log(x / p)).alias(f"says_{by}")), by, "left")
        post = F.zip_with(post, F.coalesce(f"says_{by}", F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    post = F.zip_with(post, "logs", lambda a, b: a + b)
    top = F.array_max("post")
    names = F.array(*map(F.lit, model.languages))
    out = joined.withColumn("post", post).withColumn("at", F.array_position("post", top).cast("int"))
    mass = F.aggregate("post", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = out.select("key", F.element_at(names, F.col("at")).alias("lang"), (F.lit(1.0) / mass).alias("confidence"), "row_key")
    out = out.withColumn("accepted", (F.col("lang") != UNKNOWN) & (F.col("confidence") >= least))
    return out.select("key", "lang", "confidence", "accepted", *(["row_key"] if "row_key" in rows.columns else []))


def identify_documents(docs: DataFrame, *, least: float = 0.3, with_key: bool = False) -> DataFrame:
    """identify() for documents: the source is the host, and nothing is declared.

    The model is fitted on the documents' own labels (lang); without any, all is 'und'. A table
    without `source` has one unknown host. with_key adds row_key, the evidence_key() of the row.
    """
    null = F.lit(None).cast("string")
    plain = docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else null).alias("lang"), (F.col("source").cast("string") if "source" in docs.columns else null).alias("source"))
    model = fit_text(plain, "doc_id", "text", "lang")
    key = [evidence_key(plain).alias("row_key")] if with_key else []
    rows = plain.select(F.col("doc_id").alias("key"), "text", F.lit("").alias("declared"), F.col("source").alias("host"), *key)
    return identify(rows, model, least=least).withColumnRenamed("key", "doc_id")


def identify_pages(pages: DataFrame, labelled: DataFrame, *, least: float = 0.3) -> DataFrame:
    """identify() for raw pages, with the text model of labelled documents.

    Null or empty html has no text and declares nothing; a null url has no host; such a page has
    the other evidence alone, or the whole corpus's prior.
    """
    from quillon.llm.urls import host_of

    model = fit_text(labelled, "doc_id", "text", "lang")
    html = F.col("html")
    rows = pages.select(F.col("page_id").alias("key"), visible(html).alias("text"), declared(html).alias("declared"), host_of(F.col("url")).alias("host"))
    return identify(rows, model, least=least).withColumnRenamed("key", "page_id")
