"""Streams of cases and events: first-wins per id, windows with late data, incremental sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "json", per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("maxFilesPerTrigger", per_trigger).load(folder)


def first_wins(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """A row for each key within the watermark; later repeats go."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def tumbling(stream: DataFrame, time: str, size: str, late: str, *by: str) -> DataFrame:
    """(window, by, n): counts in windows that close once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), *by).agg(F.count(F.lit(1)).alias("n"))


def session_counts(stream: DataFrame, time: str, pause: str, late: str, *by: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, pause), *by).agg(F.count(F.lit(1)).alias("n"))


def run_available(out: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there and stops; what was written before stays and is not written again."""
    query = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def each_batch(out: DataFrame, act: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    query = out.writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
