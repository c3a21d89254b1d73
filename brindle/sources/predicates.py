"""Predicates that readers push to files: a column, a kind and text values."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("eq", "gt", "ge", "lt", "le", "between", "in", "is_null", "is_not_null", "like")


@dataclass(frozen=True)
class Predicate:
    """``values`` may be text; they are cast to the column's type, so numbers compare as numbers."""

    column: str
    kind: str
    values: tuple = ()


def to_filter(p: Predicate, df: DataFrame) -> Column:
    c = F.col(p.column)
    kind = df.schema[p.column].dataType
    v = [F.lit(x).cast(kind) for x in p.values]
    match p.kind:
        case "eq":
            return c == v[0]
        case "gt":
            return c > v[0]
        case "ge":
            return c >= v[0]
        case "lt":
            return c < v[0]
        case "le":
            return c <= v[0]
        case "between":
            return (c >= v[0]) & (c <= v[1])
        case "in":
            return c.isin(*v)
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
        case "like":
            return c.like(p.values[0])
    raise ValueError(f"there is no predicate {p.kind!r}; known are {', '.join(KINDS)}")


def apply(df: DataFrame, predicates: tuple[Predicate, ...] | list[Predicate]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [to_filter(p, df) for p in predicates])) if predicates else df
