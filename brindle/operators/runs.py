"""Run-length segments and bitmaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import unused
from .ordering import Key, sort_columns


def run_segments(df: DataFrame, value: str, order_by: Sequence[Key | str], partition_by: Sequence[str] = ()) -> DataFrame:
    """(partition_by, segment, value, start, length) of maximal runs of equal values, nulls being equal; start counts from 0.

    Without ``partition_by`` all rows form one order, which one task has to see.
    """
    keys = [k if isinstance(k, Key) else Key(k) for k in order_by]
    names = [unused(f"_key{i}", df) for i in range(len(keys))]
    v, at, first, last = (unused(c, df) for c in ("_value", "_at", "_first", "_last"))
    rows = df.select(*partition_by, F.col(value).alias(v), *[F.col(k.col).alias(n) for k, n in zip(keys, names, strict=True)])
    # all windows have one order and so one sort; only the ends of runs are kept, and no run is grouped
    w = Window.partitionBy(*partition_by).orderBy(*sort_columns([replace(k, col=n) for k, n in zip(keys, names, strict=True)]))
    # a partition's first and last rows have no neighbour, not even of null
    differs = lambda beside: beside(F.lit(1)).over(w).isNull() | ~F.col(v).eqNullSafe(beside(v).over(w))
    ends = rows.select("*", F.row_number().over(w).alias(at), differs(F.lag).alias(first), differs(F.lead).alias(last)).where(F.col(first) | F.col(last))
    # the end of a run is its first row or the next one kept
    length = F.when(F.col(last), F.lit(1)).otherwise(F.lead(at).over(w) - F.col(at) + 1)
    runs = ends.select("*", length.cast("long").alias("length"), F.sum(F.col(first).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("segment")).where(first)
    return runs.select(*partition_by, "segment", F.col(v).alias(value), (F.col(at) - 1).cast("long").alias("start"), "length")


def run_aggregate(segments: DataFrame, value: str) -> DataFrame:
    """Sum, count, minimum, maximum and average of the values of run-length segments."""
    x, n = F.col(value), F.col("length")
    total = F.sum(x * n)
    count = F.sum(F.when(x.isNotNull(), n))
    return segments.agg(total.alias("sum"), count.alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.try_divide(total, count).alias("avg"))


def bitmap(df: DataFrame, position: str, keep: Column) -> DataFrame:
    """(bucket, bits): bitmaps of the positions, from 1, of the rows to keep."""
    kept = df.where(keep).select(F.bitmap_bucket_number(position).alias("bucket"), F.bitmap_bit_position(position).alias("bit"))
    return kept.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def bitmap_or(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_and(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("bits", "_bits"), "bucket").select("bucket", F.array("bits", "_bits").alias("_two")).select("bucket", F.explode("_two").alias("bits"))
    return both.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def bitmap_not(maps: DataFrame, every: DataFrame) -> DataFrame:
    """The positions of ``every`` that aren't in ``maps``."""
    from pyspark.sql.types import BinaryType

    @F.pandas_udf(BinaryType())
    def without(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x if y is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b, strict=True)])

    both = every.join(maps.withColumnRenamed("bits", "_bits"), "bucket", "left")
    return both.select("bucket", without("bits", "_bits").alias("bits"))


def bitmap_keep(df: DataFrame, position: str, maps: DataFrame) -> DataFrame:
    """The rows of ``df`` whose position, from 1, is set."""
    at = F.bitmap_bit_position(position)
    # byte at // 8 of the map, from 1, and its bit
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(position)).join(maps, F.col("_bucket") == F.col("bucket"))
    return joined.where(F.pmod(F.floor(byte / F.pow(F.lit(2), at % 8)), F.lit(2)) == 1).select(*df.columns)


def bitmap_size(maps: DataFrame) -> DataFrame:
    """One row: n, how many positions are set."""
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
