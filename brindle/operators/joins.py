"""Equi-joins, joins on any condition, broadcast with a checked size, salted joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
STRATEGIES = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash"}
#: A side that is to be broadcast may have so many bytes by Spark's own estimate.
BROADCAST_LIMIT = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """Spark's estimate of a plan's size; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """The side with a broadcast hint if its estimated size is within the limit, else as it is."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def _condition(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str], null_safe: bool) -> Column:
    pairs = zip(lk, rk, strict=True)
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b] for a, b in pairs])


def join(left: DataFrame, right: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None, how: str = "inner", null_safe: bool = False, strategy: str | None = None) -> DataFrame:
    """Rows of equal keys, with the columns of both sides (of the left for semi and anti).

    Null keys match nothing, or each other with ``null_safe``. A ``strategy`` is a hint;
    "broadcast" is followed for a right side within BROADCAST_LIMIT only.
    """
    if strategy == "broadcast":
        right = broadcast_if_small(right)
    elif strategy:
        right = right.hint(STRATEGIES[strategy])
    return left.join(right, _condition(left, right, left_keys, right_keys or left_keys, null_safe), HOW[how])


def join_on(left: DataFrame, right: DataFrame, condition: Any, how: str = "inner") -> DataFrame:
    """A join on any condition: a column or SQL text over both sides' columns, such as a range."""
    return left.join(right, F.expr(condition) if isinstance(condition, str) else condition, HOW[how])


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int = 8, how: str = "inner") -> DataFrame:
    """An inner or left join whose left side has hot keys: its rows are dealt over ``salts`` copies of the right's.

    Rows are dealt by the partition they are in, so no other column is read for it. Spark's
    estimate of a side's size leaves out that it is copied, and a broadcast of all copies
    would be held by each task, so both sides are shuffled and merged.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins can be salted on the left")
    name = "_salt"
    while name in left.columns or name in right.columns:
        name += "_"
    dealt = left.withColumn(name, F.pmod(F.spark_partition_id(), F.lit(salts)).cast("int"))
    copies = right.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies.hint(STRATEGIES["merge"]), [key, name], how).drop(name)
