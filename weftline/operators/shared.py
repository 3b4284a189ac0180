"""The folder that the driver and all executors see, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def scratch(spark, name: str) -> str:
    """A new path in the folder that all executors see; only a local master may do without spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{found.rstrip('/')}/weftline-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: later reads do not depend on any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
