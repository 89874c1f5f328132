"""Tolerant JSONL, manifests and page sources, and sinks that resume."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.sample import first_of


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, id, raw): a row for each readable line with an id; raw is its JSON text.

    A byte order mark is dropped; lines end with \\n, \\r\\n or \\r only; bytes that are not UTF-8
    are replaced. id is the id's canonical JSON, whatever its type. Unreadable lines have a null
    id; blank lines none at all.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = []
                text = bytes(content).removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace")
                for n, line in enumerate(re.split(r"\r\n|\n|\r", text), 1):
                    if not line.strip():
                        continue
                    try:
                        got = json.loads(line)
                        key = json.dumps(got["id"], sort_keys=True, ensure_ascii=False) if got["id"] is not None else None
                    except (ValueError, KeyError, TypeError):
                        key = None
                    rows.append((path, n, key, line))
                yield pd.DataFrame(rows, columns=["path", "line_no", "id", "raw"])

    return files.mapInPandas(run, "path string, line_no int, id string, raw string")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The readable lines, each id's first one, with their task: A has a booklet, B a reference."""
    got = first_of(json_lines(spark, path).where("id IS NOT NULL"), ["id"], "path", "line_no")
    a, b = (F.get_json_object("raw", f"$.{k}").isNotNull() for k in ("booklet", "reference"))
    return got.withColumn("task", F.when(a & ~b, "A").when(b & ~a, "B").otherwise("invalid"))


def manifests(spark: SparkSession, folder: str, schema: str, name: str = "run.json") -> DataFrame:
    """All manifests below a folder, with the folder of each as its run."""
    got = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(folder)
    return got.withColumn("run", F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?{re.escape(folder.rstrip('/'))}/|/{re.escape(name)}$", ""))


def page_text(html: F.Column) -> F.Column:
    """A page's text, a line for each block element."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)<(?:/p|/h[1-6]|/li|/div|/tr|br)\b[^>]*>", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"<[^>]*>", ""), r"[ \t]+", " "))


def resumed(work: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """The work that an earlier run's output does not hold yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def markdown(rows: DataFrame) -> DataFrame:
    """(line): each row as a line of a Markdown table."""
    cells = [F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
