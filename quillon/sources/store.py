"""Last-wins loads, cached pages, vectors from tensor files, line sinks, settings files."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_by_id(rows: DataFrame, key: str = "id", *order: str) -> DataFrame:
    """The last row of each key in a stated order, as a load into a dictionary would leave it."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    n = "last"
    while n in rows.columns:
        n += "_"
    return rows.withColumn(n, F.row_number().over(w)).where(F.col(n) == 1).drop(n)


def cached_pages(files: DataFrame, folder: str, read: Callable[[bytes], list[str]]) -> DataFrame:
    """(key, page, text) of files (content): read once for each content, by its SHA-256.

    What the folder holds is not read again; a page is a row, so that a filter on key or page
    reaches the Parquet scan and the other pages stay unread.
    """
    spark = files.sparkSession
    keyed = files.select(F.sha2("content", 256).alias("key"), "content").dropDuplicates(["key"])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    known = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    if known:
        keyed = keyed.join(spark.read.parquet(folder).select("key").distinct(), "key", "left_anti")

    @F.pandas_udf("array<string>")
    def pages(content: pd.Series) -> pd.Series:
        return content.map(lambda b: read(bytes(b)))

    made = keyed.select("key", F.posexplode(pages("content")).alias("page", "text")).withColumn("page", F.col("page") + 1)
    made.write.mode("append").parquet(folder)
    return spark.read.parquet(folder).join(files.select(F.sha2("content", 256).alias("key")).distinct(), "key", "left_semi")


def tensor_rows(spark: SparkSession, path: str, name: str, width: int) -> DataFrame:
    """(row, vector): a matrix of a safetensors file (a length, a JSON header, raw numbers), its first
    `width` columns."""
    kinds = {"F32": "<f4", "F16": "<f2", "F64": "<f8"}
    schema = "row long, vector array<float>"

    def run(frames):
        for f in frames:
            for content in f["content"]:
                raw = bytes(content)
                (n,) = struct.unpack("<Q", raw[:8])
                about = json.loads(raw[8 : 8 + n])[name]
                lo, hi = (8 + n + x for x in about["data_offsets"])
                m = np.frombuffer(raw[lo:hi], kinds[about["dtype"]]).reshape(about["shape"])[:, :width].astype(np.float32)
                for at in range(0, len(m), 10_000):
                    yield pd.DataFrame({"row": np.arange(at, min(at + 10_000, len(m))), "vector": list(m[at : at + 10_000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def json_lines_sink(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines; a job's files appear together, so an aborted one leaves none."""
    rows.write.mode("append").json(folder)


def markdown_table(rows: DataFrame) -> DataFrame:
    """(line_no, line): a Markdown table with its header, each row a line."""
    spark = rows.sparkSession
    clean = lambda c: F.replace(F.replace(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    head = spark.createDataFrame([(0, "| " + " | ".join(rows.columns) + " |"), (1, "|" + "---|" * len(rows.columns))], "line_no long, line string")
    body = rows.select((F.monotonically_increasing_id() + 2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", *(clean(c) for c in rows.columns)), F.lit(" |")).alias("line"))
    return head.unionAll(body)


def settings_file(path: str | Path, environment: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a file, without comments and quotes; what the environment has wins."""
    own = os.environ if environment is None else environment
    found: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        name, mark, value = line.strip().partition("=")
        if mark and not name.startswith("#"):
            found[name.removeprefix("export ").strip()] = value.strip().strip("\"'")
    return found | {k: v for k, v in own.items() if k in found}
