"""Row counts and selectivity of operators, measured while the query runs, and comparison of timings."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Measured:
    """An operator between two observed points; read the figures after an action."""

    before: Observation
    after: Observation
    result: DataFrame

    def figures(self) -> dict[str, float]:
        rows_in, rows_out = self.before.get["rows"], self.after.get["rows"]
        return {"rows_in": rows_in, "rows_out": rows_out, "selectivity": rows_out / rows_in if rows_in else 0.0}


def measured(df: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> Measured:
    before, after = Observation(), Observation()
    out = operator(df.observe(before, F.count(F.lit(1)).alias("rows")))
    return Measured(before, after, out.observe(after, F.count(F.lit(1)).alias("rows")))


def timed(run: Callable[[], object], repeats: int = 3) -> dict[str, float]:
    """Seconds of a call: least, median and mean."""
    took = []
    for _ in range(repeats):
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return {"min": min(took), "median": statistics.median(took), "mean": statistics.fmean(took)}


def regressions(before: Mapping[str, float], now: Mapping[str, float], threshold: float = 0.1) -> dict[str, float]:
    """Queries whose time rose by more than ``threshold`` of what it was, and by how much."""
    change = {q: (now[q] - before[q]) / before[q] for q in now if before.get(q)}
    return {q: c for q, c in change.items() if c > threshold}


def fingerprint(df: DataFrame) -> str:
    """The same for plans that compute the same from the same sources, whatever their columns' internal ids."""
    return f"{df.semanticHash() & 0xFFFFFFFF:08x}"


def running(spark: SparkSession) -> list[dict[str, int]]:
    """The active stages: tasks in all, active, completed and failed."""
    tracker = spark.sparkContext.statusTracker()
    found = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
    return [{"stage": s.stageId, "tasks": s.numTasks, "active": s.numActiveTasks, "completed": s.numCompletedTasks, "failed": s.numFailedTasks} for s in found if s]


def suggested_partitions(df: DataFrame, target_bytes: int = 128 << 20) -> int:
    """How many partitions of about ``target_bytes`` a plan's estimated size makes, one a core at least."""
    from .joins import estimated_bytes

    return max(df.sparkSession.sparkContext.defaultParallelism, -(-estimated_bytes(df) // target_bytes))
