"""Cutting lineage through the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_run = uuid.uuid4().hex


def _root(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="lodestack-"))
    return _fallback[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: the session's ``spark.checkpoint.dir``, a temporary one only where that is unset
    and Spark runs in one process."""
    return f"{_root(spark)}/lodestack-tables/{_run}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as Parquet and read back: iterative plans stay short and survive a lost executor, and a later plan
    reads only the columns that it needs."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete all that ``cut`` and ``scratch`` wrote in this process: for the end of a job, when its results are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{_root(spark)}/lodestack-tables/{_run}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
