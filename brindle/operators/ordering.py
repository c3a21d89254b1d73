"""Sort, top-N, limit and offset."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Key:
    """A sort key; where nulls go is always said."""

    col: str
    asc: bool = True
    nulls_first: bool = False

    def column(self) -> Column:
        c = F.col(self.col)
        if self.asc:
            return c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last()
        return c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()


def sort_columns(keys: Sequence[Key | str]) -> list[Column]:
    return [(k if isinstance(k, Key) else Key(k)).column() for k in keys]


def sort(df: DataFrame, keys: Sequence[Key | str]) -> DataFrame:
    """All rows in a total order: ranges of the keys, sorted each in its task."""
    return df.orderBy(*sort_columns(keys))


def top_n(df: DataFrame, keys: Sequence[Key | str], n: int) -> DataFrame:
    """The first n rows; each task keeps n, so nothing is sorted as a whole."""
    return df.orderBy(*sort_columns(keys)).limit(n)


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """n rows after the first ``offset``; which ones is only certain after a sort."""
    df = df.offset(offset) if offset else df
    return df if n is None else df.limit(n)
