"""Filter, project, column pruning and distinct."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.expressions import Col, Expr, columns, to_column
from .ordering import Key, sort_columns


def filter_(df: DataFrame, predicate: Any) -> DataFrame:
    """The rows for which the predicate is true; null isn't."""
    return df.filter(to_column(predicate, df))


def project(df: DataFrame, exprs: Sequence[Any], names: Sequence[str] | None = None) -> DataFrame:
    """The expressions' values, named; a bare column keeps its name."""
    names = names or [e.name if isinstance(e, Col) else e if isinstance(e, str) else f"c{i}" for i, e in enumerate(exprs)]
    return df.select(*[to_column(e, df).alias(n) for e, n in zip(exprs, names, strict=True)])


def needed_columns(exprs: Sequence[Expr]) -> list[str]:
    """The columns that expressions read; Catalyst prunes the scan to them by itself."""
    return list(dict.fromkeys(c for e in exprs for c in columns(e)))


def distinct(df: DataFrame, cols: Sequence[str] | None = None, keep: Sequence[Key] | None = None) -> DataFrame:
    """Distinct rows, or one row for each value of ``cols``, nulls being equal.

    With ``keep`` that is the first row in its order, otherwise any.
    """
    if cols is None:
        return df.distinct()
    if keep is None:
        return df.dropDuplicates(list(cols))
    w = Window.partitionBy(*cols).orderBy(*sort_columns(keep))
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def distinct_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: n_rows, n_distinct, n_duplicates."""
    groups = df.groupBy(*cols).agg(F.count("*").alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return groups.agg(total.alias("n_rows"), F.count("*").alias("n_distinct"), (total - F.count("*")).alias("n_duplicates"))
