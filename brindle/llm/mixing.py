"""Mixing sources to target weights by Pfair scheduling.

A source's rows are put in blocks. With a weight w of W in all, its block j is
released at floor(j W / w) and due at ceil((j + 1) W / w); in every slot the earliest
due among the released next blocks of all sources goes out. So at any time each
source has had its weight's part of the slots to within less than one block. Weights
are exact integers, so this holds however long a phase is.

The number of blocks that each source has had tells all that follows. The driver
runs through the slots once and keeps these numbers at the start of every piece of
PIECE slots; tasks work the pieces out again and write the slot of each block.

When a source runs out, a new phase begins: the weights of those that are left
count alone, with slots, releases and deadlines counted from its start. No row is
dropped or repeated.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import load

BLOCK_ROWS = 16
#: Slots that a task works out at once.
PIECE = 1 << 14
#: Rows that are numbered together.
RUN_ROWS = 2048
#: The default target weight of a source is its number of rows to this power.
TEMPERATURE = 0.5
NO_SOURCE = "\0none"
FEW_SOURCES = 256


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole slots of a period for each source, by largest remainders, one at least; the schedule itself takes exact weights."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    by_need = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    at = 0
    while (gap := period - sum(out.values())) != 0:
        s = by_need[at % len(by_need)] if gap > 0 else max(out, key=lambda x: (out[x] - exact[x], x))
        if gap < 0 and out[s] == 1:
            s = max(out, key=lambda x: (out[x], x))
        out[s] += 1 if gap > 0 else -1
        at += 1
    return out


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Integers in exactly the proportions of the weights."""
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*[p.denominator for p in parts.values()])
    whole = {s: int(p * unit) for s, p in parts.items()}
    least = math.gcd(*whole.values())
    return {s: w // least for s, w in whole.items()}


def release(j: int, weight: int, total: int) -> int:
    return j * total // weight


def deadline(j: int, weight: int, total: int) -> int:
    return -(-(j + 1) * total // weight)


def _slots(weight: Mapping[str, int], begin: int, had: Mapping[str, int]) -> Iterator[str]:
    """Which source has each slot from ``begin`` on, after each had so many: the released block with the earliest deadline."""
    total = sum(weight.values())
    wait = [(release(had[s], weight[s], total), s, had[s]) for s in sorted(weight)]
    heapq.heapify(wait)
    ready: list[tuple[int, str, int]] = []
    t = begin
    while True:
        while wait and wait[0][0] <= t:
            _, s, j = heapq.heappop(wait)
            heapq.heappush(ready, (deadline(j, weight[s], total), s, j))
        _, s, j = heapq.heappop(ready)
        yield s
        heapq.heappush(wait, (release(j + 1, weight[s], total), s, j + 1))
        t += 1


def pattern(weight: Mapping[str, int], length: int) -> list[str]:
    """Which source has each of the first slots of a phase."""
    return [s for s, _ in zip(_slots(weight, 0, dict.fromkeys(weight, 0)), range(length))]


@dataclass(frozen=True)
class Piece:
    """``length`` slots of a phase that begins at ``slot`` with the blocks ``first``; ``had`` are those since then, up to ``begin``."""

    number: int
    slot: int
    weight: dict[str, int]
    first: dict[str, int]
    begin: int
    had: dict[str, int]
    length: int


@dataclass(frozen=True)
class Phase:
    """Blocks ``first`` to ``end`` of a source go out from slot ``slot`` on, ``share`` in each ``period``, at ``places`` of it."""

    source: str
    number: int
    first: int
    end: int
    slot: int
    share: int
    period: int
    places: list[int]


def cut(blocks: Mapping[str, int], weights: Mapping[str, float], size: int = PIECE) -> Iterator[Piece]:
    """The pieces of the schedule of so many blocks of each source; a phase ends with the last block of a source."""
    left, done, slot, number = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, 0
    while left:
        weight, first = exact({s: weights[s] for s in left}), {s: done[s] for s in left}
        had = dict.fromkeys(left, 0)
        begin, before, t = 0, dict(had), 0
        for t, s in enumerate(_slots(weight, 0, had), 1):
            had[s] += 1
            over = had[s] == left[s]
            if over or t - begin == size:
                yield Piece(number, slot, weight, first, begin, before, t - begin)
                begin, before = t, dict(had)
            if over:
                break
        for s, n in had.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
        slot, number = slot + t, number + 1


def placed(piece: Piece) -> list[Phase]:
    """The blocks of each source in a piece and their slots."""
    places: dict[str, list[int]] = {s: [] for s in piece.weight}
    for t, s in zip(range(piece.length), _slots(piece.weight, piece.begin, piece.had)):
        places[s].append(t)
    out = []
    for s, at in places.items():
        first = piece.first[s] + piece.had[s]
        out.append(Phase(s, piece.number, first, first + len(at), piece.slot + piece.begin, len(at), piece.length, at))
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, float]) -> list[Phase]:
    """The whole schedule of so many blocks of each source, piece by piece."""
    return [p for piece in cut(blocks, weights) for p in placed(piece)]


def _timetable(spark: SparkSession, blocks: Mapping[str, int], weights: Mapping[str, float]) -> DataFrame:
    """(_source, block, phase, slot, release, deadline), one row per block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("piece").to_pylist():
                piece = pickle.loads(packed)
                total = sum(piece.weight.values())
                for p in placed(piece):
                    js, w = range(p.first - piece.first[p.source], p.end - piece.first[p.source]), piece.weight[p.source]
                    columns = {
                        "_source": pa.array([p.source] * len(js), pa.string()),
                        "block": pa.array(range(p.first, p.end), pa.int64()),
                        "phase": pa.array([p.number] * len(js), pa.int32()),
                        "slot": pa.array([p.slot + at for at in p.places], pa.int64()),
                        "release": pa.array([piece.slot + release(j, w, total) for j in js], pa.int64()),
                        "deadline": pa.array([piece.slot + deadline(j, w, total) for j in js], pa.int64()),
                    }
                    yield pa.RecordBatch.from_pydict(columns)

    pieces = [(pickle.dumps(piece),) for piece in cut(blocks, weights, PIECE)]
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = spark.createDataFrame(pieces, "piece binary").repartition(max(1, min(parts, len(pieces))))
    return dealt.mapInArrow(run, "_source string, block bigint, phase int, slot bigint, release bigint, deadline bigint")


def scheduled(docs: DataFrame, weights: Mapping[str, float] | None = None, key: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, source, block, phase, slot, release, deadline, position), one row per input row.

    ``position`` orders the rows: slots in turn, within a block by the number of the
    row. Rows of a source are numbered in an order that depends on a hash of the key,
    in runs of bounded size. A null source is a source of its own, with the weight of
    the key None. Repeated rows each have a place. Without ``weights`` a source's
    weight is its number of rows to the power TEMPERATURE; a source that has no
    weight, or one of 0 or less, gets the smallest positive one. An empty table has
    no rows. The driver holds a number a source for each phase and each PIECE slots.
    """
    rows = docs.select(F.col(key), F.coalesce(F.col(source), F.lit(NO_SOURCE)).alias("_source"))
    counts = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    given = {NO_SOURCE if s is None else s: w for s, w in (weights or {}).items()}
    least = min([w for w in given.values() if w > 0], default=1.0)
    target = {s: given.get(s, 0) if given.get(s, 0) > 0 else least for s in counts} if weights else {s: n**TEMPERATURE for s, n in counts.items()}
    spark = docs.sparkSession
    slots = _timetable(spark, {s: -(-n // block_rows) for s, n in counts.items()}, target)

    # a table of a row a source is broadcast as long as sources are few
    side = F.broadcast if len(counts) <= FEW_SOURCES else lambda df: df
    sizes = spark.createDataFrame([(s, max(1, n // RUN_ROWS)) for s, n in counts.items()], "_source string, _runs long")
    rows = rows.join(side(sizes), "_source")
    rows = rows.withColumn("_run", F.pmod(F.xxhash64(key), F.col("_runs")))
    before = Window.partitionBy("_source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_source", "_run").agg(F.count("*").alias("_n")).select("_source", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_source", "_run").orderBy(F.xxhash64(key, F.lit(1)), key)
    rows = rows.withColumn("_at", F.row_number().over(within) - 1).join(starts, ["_source", "_run"]).withColumn("_index", F.col("_start") + F.col("_at"))
    rows = rows.select(F.col(key).alias("_key"), "_source", "_index", F.floor(F.col("_index") / block_rows).cast("long").alias("block"))

    return rows.join(slots, ["_source", "block"]).select(
        F.col("_key").alias(key),
        F.nullif("_source", F.lit(NO_SOURCE)).alias(source),
        "block",
        "phase",
        "slot",
        "release",
        "deadline",
        (F.col("slot") * block_rows + F.col("_index") % block_rows).cast("long").alias("position"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scheduled(load(spark, sf_dir, "documents"))
