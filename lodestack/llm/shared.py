"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []
_run = uuid.uuid4().hex


class _Made(threading.local):
    """Tables kept by this thread, so that operators that run in several threads drop their own."""

    def __init__(self) -> None:
        self.paths: list[str] = []


_made = _Made()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset and Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="lodestack-"))
    return _fallback[0]


def ship(spark: SparkSession) -> None:
    """Let local Python workers import this package from where the driver did (a cluster gets it by --py-files), and
    keep Arrow batches of whole texts small: a default of 10,000 rows is lowered to 2,000."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def keep(df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the files, so no lineage is recomputed
    and a lost executor costs nothing already written. rows_a_file: at most so many (0: no bound)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestack/{_run}/{name}-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    _made.paths.append(path)
    return out


def sized(df: DataFrame, rows: int, a_task: int = 250_000) -> DataFrame:
    """``df``, known to have at most so many rows, in no more tasks than these are worth: a small table of an iterative
    plan is not dealt over all shuffle partitions and written as as many files. It only merges partitions."""
    return df.coalesce(max(1, -(-rows // a_task)))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables that ``keep`` wrote and that no returned DataFrame still reads."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            _delete(df.sparkSession, path)


def kept_so_far() -> int:
    return len(_made.paths)


def drop_kept_since(spark: SparkSession, mark: int, *but: DataFrame) -> None:
    """Delete the tables that ``keep`` wrote since ``mark = kept_so_far()``, but for those that are still read."""
    read = {df._kept_at for df in but}
    for path in _made.paths[mark:]:
        if path not in read:
            _delete(spark, path)
    _made.paths[mark:] = [p for p in _made.paths[mark:] if p in read]


def drop_all_kept(spark: SparkSession) -> None:
    """Delete every table that ``keep`` wrote in this process: for the end of a job, when its results are stored. Results
    are lazy and read such tables, so operators delete only what their result no longer reads."""
    _delete(spark, f"{shared_dir(spark)}/lodestack/{_run}")
