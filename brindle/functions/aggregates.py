"""Aggregate functions by name, with SQL's treatment of nulls.

Variance and deviation are those of a population and null for fewer than two
values. First, last, concatenation and arrays take an order, so that results don't
depend on how rows were dealt out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_CUSTOM: dict[str, Callable[..., Column]] = {}


@dataclass(frozen=True)
class Agg:
    """``fn`` of ``col`` as ``alias``; ``col`` None or ``include_nulls`` makes count a count of rows."""

    fn: str
    col: Any = None
    alias: str | None = None
    include_nulls: bool = False
    distinct: bool = False
    order_by: Any = None
    arg: Any = None
    extra: tuple = field(default=())


@dataclass(frozen=True)
class PartialAggregate:
    """A caller's own aggregate: a state from values (a pandas series without nulls), one from two, a result of SQL type ``result`` from the last."""

    partial: Callable[[Any], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]
    result: str = "double"


def register_aggregate(name: str, build: Callable[..., Column]) -> None:
    """Adds a custom aggregate: a function from a column to an aggregate column, such as a grouped-agg pandas UDF."""
    _CUSTOM[name.lower()] = build


def _several(x: Column, value: Column) -> Column:
    return F.when(F.count(x) > 1, value)


def build(agg: Agg, x: Column | None, order: Column | None) -> Column:
    """The aggregate column of ``x``, which ``order`` puts in order where that counts."""
    fn = agg.fn.lower()
    if fn == "count":
        if x is None or agg.include_nulls:
            return F.count(F.lit(1))
        return F.count_distinct(x) if agg.distinct else F.count(x)
    if x is None:
        raise TypeError(f"{fn} needs a column")
    order = x if order is None else order
    simple: dict[str, Callable[[], Column]] = {
        "sum": lambda: F.sum_distinct(x) if agg.distinct else F.sum(x),
        "avg": lambda: F.call_function("avg", x) if not agg.distinct else F.sum_distinct(x) / F.count_distinct(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "count_distinct": lambda: F.count_distinct(x),
        "variance": lambda: _several(x, F.var_pop(x)),
        "stddev": lambda: _several(x, F.stddev_pop(x)),
        "first": lambda: F.min_by(x, order),
        "last": lambda: F.max_by(x, order),
        "concat": lambda: F.array_join(_ordered(x.cast("string"), order), agg.arg if agg.arg is not None else ","),
        "array_agg": lambda: _ordered(x, order),
        "bit_and": lambda: F.bit_and(x),
        "bit_or": lambda: F.bit_or(x),
        "bit_xor": lambda: F.bit_xor(x),
        "geometric_mean": lambda: F.exp(F.avg(F.ln(x))),
        "harmonic_mean": lambda: F.try_divide(F.count(x), F.sum(F.try_divide(F.lit(1.0), x))),
        "median": lambda: F.median(x),
        "mode": lambda: F.mode(x, True),
        "percentile": lambda: F.percentile(x, F.lit(0.5 if agg.arg is None else agg.arg)),
        "collect_set": lambda: F.array_sort(F.collect_set(x)),
    }
    simple["collect_list"] = simple["array_agg"]
    if fn in simple:
        return simple[fn]()
    if fn in _CUSTOM:
        return _CUSTOM[fn](x)
    raise KeyError(f"there is no aggregate {agg.fn!r}")


def _ordered(x: Column, order: Column) -> Column:
    """The non-null values of x as an array in the given order."""
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.alias("x")))))
    return F.transform(pairs, lambda p: p["x"])


NAMES = ["sum", "count", "avg", "min", "max", "count_distinct", "variance", "stddev", "first", "last", "concat", "array_agg", "bit_and", "bit_or", "bit_xor", "geometric_mean", "harmonic_mean", "median", "mode", "percentile", "collect_list", "collect_set"]
