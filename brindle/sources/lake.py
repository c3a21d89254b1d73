"""One reader for all table formats: columns, predicates, time travel, increments, metadata."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from typing import Any
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_ipc, iceberg
from .predicates import Predicate, apply

FILES = ("parquet", "orc", "csv", "json", "text", "avro")
#: Formats that need a connector on the class path, and its source name.
CONNECTORS = {"paimon": "paimon", "hudi": "hudi", "delta": "delta"}


@dataclass(frozen=True)
class ScanSpec:
    """What to read. At most one of the snapshot fields; ``since`` and ``until`` bound an increment."""

    path: str
    format: str = "parquet"
    columns: tuple = ()
    predicates: tuple = ()
    snapshot_id: int | None = None
    as_of: str | None = None
    branch: str | None = None
    tag: str | None = None
    since: Any = None
    until: Any = None
    partitions: tuple = ()  # of (column, value): only these
    options: dict = field(default_factory=dict)

    @staticmethod
    def from_uri(uri: str, **more: Any) -> ScanSpec:
        """``parquet:///a/b``, ``orc://..``, ``arrow://..``, ``iceberg:///warehouse/db/t`` or a bare path of Parquet."""
        known = (*FILES, *CONNECTORS, "iceberg", "arrow")
        scheme = urlparse(uri).scheme
        if scheme in known:
            return ScanSpec(path=uri[len(scheme) + 3 :], format=scheme, **more)
        return ScanSpec(path=uri, **more)


def _travels(spec: ScanSpec) -> bool:
    return any(x is not None for x in (spec.snapshot_id, spec.as_of, spec.branch, spec.tag))


def _base(spark: SparkSession, spec: ScanSpec) -> DataFrame:
    fmt = spec.format
    if fmt == "iceberg":
        return iceberg.read(spark, spec.path, spec.predicates, snapshot_id=spec.snapshot_id, as_of=spec.as_of, ref=spec.branch or spec.tag, since=spec.since, until=spec.until)
    if fmt in CONNECTORS:
        reader = spark.read.format(CONNECTORS[fmt]).options(**spec.options)
        named = {"versionAsOf": spec.snapshot_id, "timestampAsOf": spec.as_of, "branch": spec.branch, "tag": spec.tag, "start-snapshot-id": spec.since, "end-snapshot-id": spec.until}
        for k, v in named.items():
            reader = reader if v is None else reader.option(k, v)
        try:
            return reader.load(spec.path)
        except Exception as e:
            if isinstance(e, AnalysisException) or "ClassNotFound" in str(e) or "DATA_SOURCE_NOT_FOUND" in str(e):
                raise RuntimeError(f"reading {fmt} needs its Spark connector on the class path") from e
            raise
    if _travels(spec):
        raise ValueError(f"{fmt} files have no snapshots; since and until bound them by modification time")
    if fmt == "arrow":
        return arrow_ipc.read(spark, spec.path)
    if fmt not in FILES:
        raise ValueError(f"there is no format {fmt!r}")
    reader = spark.read.format(fmt).options(**spec.options)
    if spec.since is not None:
        reader = reader.option("modifiedAfter", spec.since)
    if spec.until is not None:
        reader = reader.option("modifiedBefore", spec.until)
    return reader.load(spec.path)


def scan(spark: SparkSession, spec: ScanSpec) -> DataFrame:
    """The rows; predicates and columns are left to Catalyst, which takes them to the files."""
    df = _base(spark, spec)
    df = apply(df, [Predicate(c, "eq", (v,)) for c, v in spec.partitions])
    df = apply(df, spec.predicates)
    return df.select(*spec.columns) if spec.columns else df


class LakeReader:
    """The same, step by step."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet", **options: str):
        self.spark, self.spec = spark, ScanSpec(path, format, options=options)

    def _with(self, **change: Any) -> LakeReader:
        other = LakeReader(self.spark, self.spec.path, self.spec.format)
        other.spec = replace(self.spec, **change)
        return other

    def select(self, *columns: str) -> LakeReader:
        return self._with(columns=columns)

    def where(self, *predicates: Predicate) -> LakeReader:
        return self._with(predicates=(*self.spec.predicates, *predicates))

    def partition(self, column: str, value: Any) -> LakeReader:
        return self._with(partitions=(*self.spec.partitions, (column, value)))

    def at(self, snapshot_id: int | None = None, as_of: str | None = None, branch: str | None = None, tag: str | None = None) -> LakeReader:
        return self._with(snapshot_id=snapshot_id, as_of=as_of, branch=branch, tag=tag)

    def between(self, since: Any = None, until: Any = None) -> LakeReader:
        return self._with(since=since, until=until)

    def read(self) -> DataFrame:
        return scan(self.spark, self.spec)

    def schema(self):
        return self.read().schema

    def metadata(self) -> dict[str, Any]:
        """Format, path, schema and, for Iceberg, snapshots, partition fields and properties."""
        out: dict[str, Any] = {"format": self.spec.format, "path": self.spec.path, "schema": self.schema()}
        if self.spec.format == "iceberg":
            out |= iceberg.metadata(self.spark, self.spec.path)
        return out

    def statistics(self, *columns: str) -> dict[str, Any]:
        """Files and rows and, for the columns asked for, minimum, maximum and nulls."""
        df = self.read()
        aggs = [F.count("*").alias("rows")]
        for c in columns:
            aggs += [F.min(c).alias(f"{c}.min"), F.max(c).alias(f"{c}.max"), F.count_if(F.col(c).isNull()).alias(f"{c}.nulls")]
        return {"files": len(df.inputFiles()), **df.agg(*aggs).first().asDict()}


def columns_of(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*names)
