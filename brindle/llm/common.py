"""Tables, the shared folder and written intermediate tables."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes that Spark hands to a Python worker at a time; its default is too much for several workers an executor.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limit of an Arrow batch to BATCH_BYTES, unless somebody has set another than Spark's own."""
    name, own = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, own) == own:
        spark.conf.set(name, str(BATCH_BYTES))


@contextlib.contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Here a query's shuffle files are deleted when it has run."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Where that is unset, local tests get a temporary folder; on a cluster that is an error.
    """
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there.rstrip("/")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Tables written to the shared folder, so that lost executors recompute from files, not from long lineages."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bytes(self, name: str) -> int:
        """The size of a written table."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return int(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength())

    def drop(self, *names: str) -> None:
        """Deletes these tables; nothing may read them afterwards."""
        for name in names:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def keep(self, *names: str) -> None:
        """Deletes all tables but these, as a result reads no others."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for there in fs.listStatus(at) if fs.exists(at) else ():
            if there.getPath().getName() not in names:
                fs.delete(there.getPath(), True)


def utf8_bytes(text: str) -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
