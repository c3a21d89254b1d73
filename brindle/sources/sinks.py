"""Where results go."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from . import arrow_ipc


@dataclass(frozen=True)
class SinkSpec:
    """``kind``: file (format, path), database (url, table), memory (name), arrow (path) or network (send)."""

    kind: str
    path: str = ""
    format: str = "parquet"
    mode: str = "errorifexists"
    partition_by: tuple = ()
    table: str = ""
    send: Callable[[Any], None] | None = None
    options: dict = field(default_factory=dict)


def sink(df: DataFrame, spec: SinkSpec) -> dict[str, Any]:
    """Writes all rows and returns how many there were; the count comes with the write, not from a second run."""
    if spec.kind == "network":
        return _sent(df, spec.send)
    seen = Observation()
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    match spec.kind:
        case "file":
            writer = df.write.format(spec.format).mode(spec.mode).options(**spec.options)
            (writer.partitionBy(*spec.partition_by) if spec.partition_by else writer).save(spec.path)
        case "database":
            df.write.jdbc(spec.path, spec.table, mode=spec.mode, properties={k: str(v) for k, v in spec.options.items()})
        case "memory":
            # cached where it is and registered by name; nothing comes to the driver
            df.cache().createOrReplaceTempView(spec.table)
            df.count()
        case "arrow":
            arrow_ipc.write(df, spec.path, spec.options.get("compression")).count()
        case _:
            raise ValueError(f"there is no sink {spec.kind!r}")
    return dict(seen.get)


def _sent(df: DataFrame, send: Callable[[Any], None]) -> dict[str, Any]:
    """Gives each partition's rows to ``send`` and counts them; Spark observes no such action, and a partition that is run again counts again."""
    rows = df.sparkSession.sparkContext.accumulator(0)

    def each(partition: Any) -> None:
        def counted() -> Any:
            for row in partition:
                rows.add(1)
                yield row

        send(counted())

    df.foreachPartition(each)
    return {"rows": rows.value}
