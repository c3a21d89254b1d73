"""Finding keys that hold much of a table; see salted_aggregate and salted_join for dealing with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float) -> DataFrame:
    """(keys, n, share) of keys with more than that share of the rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.join(F.broadcast(total)).where(F.col("n") > share * F.col("_total")).select(*keys, "n", (F.col("n") / F.col("_total")).alias("share"))
