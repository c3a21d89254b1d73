"""A folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the cluster's spark.checkpoint.dir; where that is unset, local sessions get a temporary folder."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="brindle-"))
        there = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
