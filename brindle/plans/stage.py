"""Stage plans: operators with dependencies, checked and folded into one DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregate as agg_ops
from ..operators import basic, exchange, joins, ordering, runs, sets, skew, windows
from ..sources.lake import ScanSpec, scan
from ..sources.sinks import SinkSpec, sink


@dataclass(frozen=True)
class Node:
    """An operator by name, its arguments and the ids of its inputs."""

    id: str
    op: str
    args: dict = field(default_factory=dict)
    inputs: tuple = ()


def _scan(spark: SparkSession, args: dict) -> DataFrame:
    spec = args.get("spec") or ScanSpec.from_uri(args["path"], **{k: v for k, v in args.items() if k not in ("path", "predicate", "table")})
    df = scan(spark, spec)
    return basic.filter_(df, args["predicate"]) if args.get("predicate") is not None else df


ONE: dict[str, Callable[..., DataFrame]] = {
    "filter": basic.filter_,
    "project": basic.project,
    "aggregate": agg_ops.aggregate,
    "salted_aggregate": agg_ops.salted_aggregate,
    "sort": ordering.sort,
    "top_n": ordering.top_n,
    "limit": ordering.limit,
    "window": windows.window,
    "distinct": basic.distinct,
    "distinct_stats": basic.distinct_stats,
    "exchange": exchange.exchange,
    "heavy_keys": skew.heavy_keys,
    "run_segments": runs.run_segments,
}
TWO: dict[str, Callable[..., DataFrame]] = {"join": joins.join, "join_on": joins.join_on, "salted_join": joins.salted_join, "set_op": sets.set_op}


class StagePlan:
    """Nodes in any order; the only node that no other reads is the result."""

    def __init__(self, nodes: Sequence[Node]):
        self.nodes = {n.id: n for n in nodes}
        if len(self.nodes) != len(nodes):
            raise ValueError("two nodes have one id")

    def order(self) -> list[Node]:
        """The nodes, inputs first; unknown inputs, wrong numbers of inputs and cycles raise."""
        for n in self.nodes.values():
            for i in n.inputs:
                if i not in self.nodes:
                    raise ValueError(f"{n.id} reads {i}, which isn't there")
            want = 0 if n.op in ("scan", "table") else 2 if n.op in TWO else 1
            if n.op not in (*ONE, *TWO, "scan", "table", "sink", "custom"):
                raise ValueError(f"{n.id}: there is no operator {n.op!r}")
            if n.op != "custom" and len(n.inputs) != want:
                raise ValueError(f"{n.id}: {n.op} takes {want} inputs, not {len(n.inputs)}")
        done: list[Node] = []
        placed: set[str] = set()
        left = dict(self.nodes)
        while left:
            ready = [n for n in left.values() if placed.issuperset(n.inputs)]
            if not ready:
                raise ValueError(f"a cycle among {', '.join(sorted(left))}")
            for n in ready:
                done.append(n)
                placed.add(n.id)
                del left[n.id]
        return done

    def entries(self) -> list[str]:
        return [n.id for n in self.nodes.values() if not n.inputs]

    def exits(self) -> list[str]:
        read = {i for n in self.nodes.values() for i in n.inputs}
        return [i for i in self.nodes if i not in read]

    def build(self, spark: SparkSession) -> DataFrame:
        """The result's DataFrame; nothing runs but the sinks."""
        made: dict[str, Any] = {}
        for n in self.order():
            inputs = [made[i] for i in n.inputs]
            if n.op == "scan":
                made[n.id] = _scan(spark, n.args)
            elif n.op == "table":
                made[n.id] = n.args["df"]
            elif n.op == "sink":
                sink(inputs[0], n.args.get("spec") or SinkSpec(**n.args))
                made[n.id] = inputs[0]
            elif n.op == "custom":
                made[n.id] = n.args["run"](*inputs)
            elif n.op in TWO:
                made[n.id] = TWO[n.op](*inputs, **n.args)
            else:
                made[n.id] = ONE[n.op](*inputs, **n.args)
        last = self.exits()
        if len(last) != 1:
            raise ValueError(f"a plan has one result, not {len(last)}: {', '.join(last)}")
        return made[last[0]]
