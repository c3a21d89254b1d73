"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every (record key, shard) pair has a pseudo-random draw u in (0, 1); a record
goes to the shard with the largest -weight / ln(u). A shard that is added wins
some records from all others and no record moves between old shards; a record
moves on a weight change only from or to the shard whose weight changed.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load, utf8_bytes

#: Rows of one shard are numbered in this many independent runs, so that no task has to sort a whole shard.
RUNS = 64
BITS = 52


def _draw(key: Column, shard: Column) -> Column:
    """The first 52 bits of xxhash64('key:shard'), as a double in (0, 1)."""
    word = F.xxhash64(F.concat(key, F.lit(":"), shard.cast("string")))
    return (F.shiftrightunsigned(word, 64 - BITS).cast("double") + 0.5) / float(1 << BITS)


def shard_of(key: Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key. Weights of 0 or less get nothing; a null key counts as the text 'null'."""
    live = {int(s): float(w) for s, w in weights.items() if w > 0}
    if not live:
        raise ValueError("no shard has a positive weight")
    shards = F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(w).alias("weight")) for s, w in sorted(live.items())])
    key = F.coalesce(key.cast("string"), F.lit("null"))
    scored = F.transform(
        shards,
        lambda s: F.struct((-s["weight"] / F.ln(_draw(key, s["shard"]))).alias("score"), (-s["shard"]).alias("nearest")),
    )
    return (-F.array_max(scored)["nearest"]).cast("int")


def assign(docs: DataFrame, weights: Mapping[int, float], grown: Mapping[int, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the UTF-8 bytes of the text plus 16; a null text has no bytes and
    the checksum of none. ``slot`` numbers the rows of a shard without gaps from 0:
    each shard is numbered in RUNS independent runs whose sizes are summed first,
    so the largest sort is 1 / RUNS of a shard. Repeated keys share a shard and
    get a slot each, the order among equal rows being free. An empty table gives
    no rows; other columns are not read, whatever their names.
    """
    body = utf8_bytes(text)
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + F.lit(16)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    rows = (
        rows.withColumn("shard", shard_of(F.col(key), weights))
        .withColumn("grown_shard", shard_of(F.col(key), grown))
        .withColumn("_run", F.pmod(F.xxhash64(F.col(key), F.lit("run")), F.lit(RUNS)))
    )
    runs = rows.groupBy("shard", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("shard", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_run").orderBy(F.col(key), "text_crc32")
    # at most len(weights) * RUNS rows, whatever the table holds
    return (
        rows.withColumn("_at", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", "_run"])
        .select(
            F.col(key),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("_start") + F.col("_at")).cast("long").alias("slot"),
            "grown_shard",
        )
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 equal shards by the law ``key``; grown_shard has 41."""
    return assign(load(spark, sf_dir, "documents"), dict.fromkeys(range(40), 1.0), dict.fromkeys(range(41), 1.0))
