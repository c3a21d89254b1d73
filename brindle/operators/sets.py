"""Set operations; nulls equal each other."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

KINDS = ("union_all", "union", "intersect", "except", "intersect_all", "except_all")


def set_op(left: DataFrame, right: DataFrame, kind: str, mode: str = "sql") -> DataFrame:
    """Columns go by place. ``mode="bag_left"`` keeps the left's duplicates in intersect and except."""
    if len(left.columns) != len(right.columns):
        raise ValueError(f"{len(left.columns)} columns against {len(right.columns)}")
    if mode == "bag_left" and kind in ("intersect", "except"):
        right = right.toDF(*[f"_r{i}" for i in range(len(right.columns))]).distinct()
        same = reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in zip(left.columns, right.columns, strict=True)])
        return left.join(right, same, "left_semi" if kind == "intersect" else "left_anti")
    if mode not in ("sql", "bag_left"):
        raise ValueError(f"there is no mode {mode!r}")
    match kind:
        case "union_all":
            return left.unionAll(right)
        case "union":
            return left.union(right).distinct()
        case "intersect":
            return left.intersect(right)
        case "except":
            return left.subtract(right)
        case "intersect_all":
            return left.intersectAll(right)
        case "except_all":
            return left.exceptAll(right)
    raise ValueError(f"there is no set operation {kind!r}; known are {', '.join(KINDS)}")
