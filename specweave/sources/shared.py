"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session leaves it unset, a local master gets a
    temporary folder that goes with the process; a cluster has to set it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.conf.get("spark.master", "local").startswith("local"):
        if "dir" not in _local:
            _local["dir"] = tempfile.mkdtemp(prefix="specweave-")
            atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
        return f"file://{_local['dir']}"
    raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/specweave/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there: a table that is used twice is made once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
