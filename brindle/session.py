"""Sessions with the settings that the engine's semantics rely on."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import SparkSession

#: UTC and ANSI fix results; the others let Spark re-plan at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "brindle", master: str | None = None, **extra: str) -> SparkSession:
    """A session with SETTINGS; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): str(v) for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settings_from_yaml(path: str | Path) -> dict[str, str]:
    """Flat ``a.b.c`` settings of a nested YAML file of scalars, by indentation; lists and anchors aren't read."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith("#"):
            continue
        depth = len(body) - len(body.lstrip())
        name, _, value = body.strip().partition(":")
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, name.strip()))
        if value.strip():
            out[".".join(n for _, n in stack)] = value.strip().strip("\"'")
    return out


def apply(spark: SparkSession, settings: Mapping[str, str]) -> None:
    """Sets those of the settings that begin with ``spark.`` and may change at run time."""
    for key, value in settings.items():
        if key.startswith("spark.") and spark.conf.isModifiable(key):
            spark.conf.set(key, value)
