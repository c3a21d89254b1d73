"""How rows are dealt out to partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import broadcast_if_small



def _text(keys: Sequence[str]) -> Column:
    """The keys as one text; a null is the code point 0, and keys end in 1."""
    return F.concat(*[F.concat(F.coalesce(F.col(k).cast("string"), F.lit("\0")), F.lit("\1")) for k in keys])


HASHES = {
    "simple": lambda *keys: F.crc32(_text(keys)),
    "murmur3": F.hash,
    "city": lambda *keys: F.conv(F.substring(F.md5(_text(keys)), 1, 15), 16, 10).cast("long"),
    "xx": F.xxhash64,
}


def exchange(df: DataFrame, strategy: str, keys: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """``broadcast`` (if small), ``hash``, ``range``, ``round_robin`` or ``single``."""
    match strategy:
        case "broadcast":
            return broadcast_if_small(df)
        case "hash":
            return df.repartition(n, *keys) if n else df.repartition(*keys)
        case "range":
            return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
        case "round_robin":
            return df.repartition(n or df.sparkSession.sparkContext.defaultParallelism)
        case "single":
            return df.repartition(1)  # coalesce(1) would run what comes before it in one task too
    raise ValueError(f"there is no exchange {strategy!r}")


def shuffle_id(keys: Sequence[str], n: int, hash_function: str = "xx") -> Column:
    """The partition, 0 to n - 1, that rows of equal keys share; null keys hash as nulls. Without keys rows go round."""
    if not keys:
        return F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    return F.pmod(HASHES[hash_function](*keys), F.lit(n)).cast("int")
