"""Grouped aggregation; partial sums before the shuffle are Spark's."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import Agg, PartialAggregate, build
from ..plans.expressions import Col, to_column
from .joins import broadcast_if_small

SALTED = {"sum": "sum", "count": "sum", "count_distinct": "sum", "min": "min", "max": "max"}


def aggregate(df: DataFrame, keys: Sequence, aggs: Sequence[Agg]) -> DataFrame:
    """One row a group, or one in all without keys. Keys are names, expressions or (expression, alias)."""
    named = []
    for k in keys:
        e, alias = k if isinstance(k, tuple) else (k, k.name if isinstance(k, Col) else k)
        named.append(to_column(e, df).alias(alias))
    built = [
        build(a, None if a.col is None else to_column(a.col, df), None if a.order_by is None else to_column(a.order_by, df)).alias(a.alias or f"{a.fn}_{a.col if isinstance(a.col, str) else i}")
        for i, a in enumerate(aggs)
    ]
    return df.groupBy(*named).agg(*built) if named else df.agg(*built)


def salted_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], salts: int = 8) -> DataFrame:
    """The same for sums, counts, minima, maxima and averages, in two steps: a hot key is first dealt over ``salts`` groups.

    Rows are dealt by the partition they are in, which needs no column and is the same
    when a lost task is run again. DISTINCT sums, counts and averages are dealt by their
    value, so that equal values meet; two of them over different columns raise.
    """
    first, second = [], []
    by_value = {str(a.col): a.col for a in aggs if a.distinct and a.fn in ("sum", "count", "avg") or a.fn == "count_distinct"}
    if len(by_value) > 1:
        raise ValueError("only one column can have DISTINCT aggregates put together from parts")
    for i, a in enumerate(aggs):
        x = F.lit(1) if a.col is None else to_column(a.col, df)
        alias = a.alias or f"{a.fn}_{i}"
        if a.fn == "avg":
            first += [F.sum_distinct(x).alias(f"_s{i}"), F.count_distinct(x).alias(f"_n{i}")] if a.distinct else [F.sum(x).alias(f"_s{i}"), F.count(x).alias(f"_n{i}")]
            second.append(F.try_divide(F.sum(f"_s{i}"), F.sum(f"_n{i}")).alias(alias))
        elif a.fn in SALTED:
            first.append(build(a, None if a.col is None else x, None).alias(f"_{i}"))
            second.append(F.call_function(SALTED[a.fn], F.col(f"_{i}")).alias(alias))
        else:
            raise ValueError(f"{a.fn} can't be put together from parts")
    salt = F.spark_partition_id() if not by_value else F.xxhash64(to_column(*by_value.values(), df))
    name = unused("_salt", df)
    return df.withColumn(name, F.pmod(salt, F.lit(salts))).groupBy(*keys, name).agg(*first).groupBy(*keys).agg(*second)


def unused(name: str, *dfs: DataFrame) -> str:
    """The name, made longer until no column of the tables has it."""
    while any(name.lower() in (c.lower() for c in df.columns) for df in dfs):
        name += "_"
    return name


def custom_aggregate(df: DataFrame, keys: Sequence[str], column: str, fn: PartialAggregate, alias: str) -> DataFrame:
    """One row a group with a caller's own aggregate of a column, null values left out.

    Each Arrow batch gives one state a group, so only states are shuffled and no task
    holds a group's rows. Values all null give null; without rows there is no group.
    """
    kinds = dict(df.dtypes)
    fields = [f"`{k}` {kinds[k]}" for k in keys]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), pickle.dumps(fn.partial(v[column].dropna())) if v[column].notna().any() else None) for k, v in batch.groupby(list(keys), dropna=False)]
            yield pd.DataFrame(rows, columns=[*keys, "state"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        states = [pickle.loads(s) for s in group["state"] if s is not None]
        row = group[list(keys)].head(1).copy()
        row[alias] = [fn.finish(reduce(fn.merge, states)) if states else None]
        return row

    states = df.select(*keys, column).mapInPandas(partial, ", ".join([*fields, "state binary"]))
    return states.groupBy(*keys).applyInPandas(merged, ", ".join([*fields, f"`{alias}` {fn.result}"]))


def exact_percentile(df: DataFrame, keys: Sequence[str], column: str, share: float, alias: str, accuracy: int = 10_000) -> DataFrame:
    """One row a group with the interpolated percentile of a column, for groups that no task can hold.

    An approximate percentile with a known error of rank bounds the place; values below
    the bounds are only counted, and of those between them a row a distinct value is
    kept, whose running count finds the two neighbours. Null values don't count.
    """
    x, gap = F.col(column), 4.0 / accuracy
    low_, high_, n_ = (unused(c, df) for c in ("_low", "_high", "_n"))
    rows = df.select(*keys, x.alias(alias)).where(F.col(alias).isNotNull())
    v = F.col(alias)
    ends = F.percentile_approx(v, [max(0.0, share - gap), min(1.0, share + gap)], accuracy)
    bounds = rows.groupBy(*keys).agg(ends.alias("_ends"), F.min(v).alias("_min"), F.max(v).alias("_max"), F.count("*").alias(n_))
    # of few values the error is less than a rank, but the neighbours may be outside
    few = F.col(n_) < accuracy
    bounds = bounds.select(*keys, F.when(few, F.col("_min")).otherwise(F.col("_ends")[0]).alias(low_), F.when(few, F.col("_max")).otherwise(F.col("_ends")[1]).alias(high_), n_)
    pairs = [k for k in keys]
    near = rows.join(broadcast_if_small(bounds.withColumnsRenamed({k: f"_k_{k}" for k in pairs})), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in pairs], F.lit(True)))
    inside = (v >= F.col(low_)) & (v <= F.col(high_))
    counted = near.withColumn("_v", F.when(inside, v)).groupBy(*keys, "_v", (v < F.col(low_)).alias("_below"), n_).agg(F.count("*").alias("_c"))
    counted = counted.where("_v is not null or _below")
    upto = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto)).where("_v is not null")
    place = F.lit(share) * (F.col(n_) - 1)
    at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
    found = ranked.groupBy(*keys, n_).agg(at(F.floor(place)).alias("_a"), at(F.ceil(place)).alias("_b"))
    part = place - F.floor(place)
    return found.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias(alias))
