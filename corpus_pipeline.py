"""Corpus pipeline: language ID, near-dedup, suffix dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return docs'
columns, with the stage's decisions applied. Rows are told apart by doc_id (null is one more id)
and a hash of their text, so that a row that shares its doc_id with a rejected one stays. A null
text counts as empty; extra columns, whatever their names, go through; `source`, `lang` and
`n_chars` may be missing; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm._common import bounded, fresh, row_key, settle, shared_folder, without
from quillon.llm.lang_id import evidence_key, identify_documents
from quillon.llm.near_dup import near_duplicates
from quillon.llm.packing import pack
from quillon.llm.queries import vocabulary
from quillon.llm.secrets import redact
from quillon.llm.suffix_dedup import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those that language ID rejects go.

    Rows of one doc_id, text and source share a verdict. A null or empty text is judged by its
    source's other documents.
    """
    judged = identify_documents(docs, with_key=True).where("NOT accepted")
    return without(docs, judged, evidence_key(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a similarity of 0.8 or more: that with the smallest doc_id.

    Where rows repeat that doc_id in the group, the one with the smallest hash of its text; where
    they repeat the text as well, one of them. Null ids come last. Texts without words are no group
    and all stay.
    """
    found = settle(near_duplicates(docs, percent=80, with_key=True))
    kept = without(docs, found.where("NOT first"), row_key())
    again = found.where("first AND n_shingles > 0").groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = settle(again.select("doc_id", "row_key"))
    if again.isEmpty():
        return kept
    # Rows that repeat both doc_id and text of a kept document: one of each.
    a, b, n = fresh(docs, "again_id"), fresh(docs, "again_key"), fresh(docs, "turn")
    named = bounded(again.select(F.col("doc_id").alias(a), F.col("row_key").alias(b)))
    same = (row_key() == F.col(b)) & F.col("doc_id").cast("long").eqNullSafe(F.col(a))
    order = Window.partitionBy(F.col("doc_id"), row_key()).orderBy(*(F.col(f"`{f.name}`") for f in docs.schema if f.dataType.typeName() in ("string", "long", "integer", "double")))
    single = kept.join(named, same, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*(f"`{c}`" for c in docs.columns))
    return kept.join(named, same, "left_anti").unionByName(single)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a smaller doc_id has too; n_chars follows.

    A null text becomes an empty one; a null doc_id neither loses text nor takes it from others.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = remove_repeats(docs, with_text=True, carry=others)
    to = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return kept.select(*(to.get(c, F.col(f"`own_{c}`")).alias(c) for c in docs.columns))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of secrets; n_chars follows. A null text stays null."""
    clean = redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's pieces stand in sequences of 2048 tokens; a null text is empty."""
    return pack(docs, vocabulary())


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
#: Tokens, byte strings across documents and sketches are beyond SQL; tests hold brute force against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what a stage made is written before the next one reads it."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
