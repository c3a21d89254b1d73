"""Pipelines: tasks over DataFrames with dependencies, priorities and conditions, run side by side.

Tasks that don't wait for each other run at the same time; Spark's FAIR scheduler,
where it is on, shares the cluster among the pools of their priorities.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

PRIORITIES = ("low", "normal", "high", "critical")


@dataclass(frozen=True)
class Task:
    """``run`` gets the results of ``after``, in that order; with ``when`` the task is skipped unless it is true of them."""

    id: str
    run: Callable[..., Any]
    after: tuple = ()
    priority: str = "normal"
    when: Callable[..., bool] | None = None


class Skipped:
    """The result of a task that wasn't run, and of those that need it."""

    def __repr__(self) -> str:
        return "skipped"


SKIPPED = Skipped()


class Pipeline:
    def __init__(self, tasks: Sequence[Task]):
        self.tasks = {t.id: t for t in tasks}
        if len(self.tasks) != len(tasks):
            raise ValueError("two tasks have one id")
        for t in tasks:
            if t.priority not in PRIORITIES:
                raise ValueError(f"{t.id}: there is no priority {t.priority!r}")
            for a in t.after:
                if a not in self.tasks:
                    raise ValueError(f"{t.id} waits for {a}, which isn't there")
        self.order()

    def ready(self, done: set[str], begun: set[str] = frozenset()) -> list[Task]:
        """Tasks that can begin, the most urgent first."""
        found = [t for t in self.tasks.values() if t.id not in done and t.id not in begun and done.issuperset(t.after)]
        return sorted(found, key=lambda t: -PRIORITIES.index(t.priority))

    def order(self) -> list[str]:
        """An order in which the tasks can run one by one; a cycle raises."""
        out: list[str] = []
        while len(out) < len(self.tasks):
            found = self.ready(set(out))
            if not found:
                raise ValueError(f"a cycle among {', '.join(sorted(set(self.tasks) - set(out)))}")
            out.append(found[0].id)
        return out

    def run(self, spark: SparkSession, at_once: int = 4) -> dict[str, Any]:
        """The results by task; the first error stops tasks that haven't begun and is raised."""
        results: dict[str, Any] = {}
        running: dict[Future, str] = {}

        def one(t: Task) -> Any:
            inputs = [results[a] for a in t.after]
            if any(x is SKIPPED for x in inputs) or (t.when is not None and not t.when(*inputs)):
                return SKIPPED
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", t.priority)
            return t.run(*inputs)

        with ThreadPoolExecutor(at_once) as pool:
            while len(results) < len(self.tasks):
                for t in self.ready(set(results), set(running.values()))[: at_once - len(running)]:
                    running[pool.submit(one, t)] = t.id
                finished, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in finished:
                    results[running.pop(f)] = f.result()
        return results
