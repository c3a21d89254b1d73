"""Event-time windows over streams or tables of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, like: DataFrame, max_files: int = 64) -> DataFrame:
    """A stream of a folder's Parquet files with the schema of ``like``; ``max_files`` a batch holds the rate."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def windowed(df: DataFrame, time: str, length: str, aggs: Sequence[Column], keys: Sequence[str] = (), slide: str | None = None, late: str | None = None) -> DataFrame:
    """Tumbling or, with ``slide``, sliding windows; rows later than ``late`` are dropped from streams."""
    df = df.withWatermark(time, late) if late else df
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return df.groupBy(w.alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *[c for c in _names(df, aggs)])


def sessions(df: DataFrame, time: str, gap: str, aggs: Sequence[Column], keys: Sequence[str], late: str | None = None) -> DataFrame:
    """Windows that end when a key has had no event for ``gap``."""
    df = df.withWatermark(time, late) if late else df
    grouped = df.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggs)
    return grouped.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *_names(df, aggs))


def _names(df: DataFrame, aggs: Sequence[Column]) -> list[str]:
    return [f.name for f in df.agg(*aggs).schema] if not df.isStreaming else [c._jc.toString().rpartition(" AS ")[2].strip("`") for c in aggs]


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append", query_format: str = "memory"):
    """Runs a stream over what is there now, to its end, and stops."""
    query = df.writeStream.format(query_format).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_files(df: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream over what is there now, to its end, into Parquet files, each batch once."""
    df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
