"""A continuous index: versions of files come as a stream, are told apart by their content, and replace each other.

An index is a folder of two tables, partitioned by the epoch (micro-batch) that wrote them. ``files`` (path, sha256,
n_chunks) has a row for each version that was taken, n_chunks null where the file was removed; ``chunks`` (path,
chunk_index, chunk_count, text) has its pieces. A version counts if ``files`` lists it and no later epoch has the path, so
a shorter version leaves no tail of the one before. An epoch is written with overwrite and looks at earlier epochs only:
one that is replayed after a failure writes the same again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.textops import CHUNK_BYTES, chunks
from lodestack.sources.readers import exists

VERSION = "path string, text string, modified timestamp"
FILES = "path string, sha256 string, n_chunks int, epoch long"
CHUNKS = "path string, chunk_index int, chunk_count int, text string, epoch long"


def _table(spark: SparkSession, target: str, name: str, schema: str) -> DataFrame:
    at = f"{target}/{name}"
    return spark.read.schema(schema).option("basePath", at).parquet(at) if exists(spark, at) else spark.createDataFrame([], schema)


def latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(path, epoch, sha256, n_chunks) of the version of each file that counts, removed files with null; before: as it was
    at the begin of an epoch."""
    rows = _table(spark, target, "files", FILES)
    rows = rows if before is None else rows.filter(F.col("epoch") < before)
    return rows.groupBy("path").agg(F.max(F.struct("epoch", "sha256", "n_chunks")).alias("f")).select("path", "f.*")


def files(spark: SparkSession, target: str) -> DataFrame:
    """The files that are in the index."""
    return latest(spark, target).filter("n_chunks is not null")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks that are in the index: (path, chunk_index, chunk_count, text, sha256)."""
    return _table(spark, target, "chunks", CHUNKS).join(files(spark, target).select("path", "epoch", "sha256"), ["path", "epoch"]).drop("epoch")


def changed(versions: DataFrame, known: DataFrame) -> DataFrame:
    """(path, text, sha256) of the last version of each path, by its time, then content, if it is not what is known. A null
    text removes a file; removing what is not there changes nothing."""
    sha = F.sha2("text", 256).alias("sha256")
    last = versions.filter("path is not null").groupBy("path").agg(F.max(F.struct("modified", "text")).alias("v")).select("path", "v.text").withColumn("sha256", sha)
    both = last.join(known.filter("n_chunks is not null").select("path", F.col("sha256").alias("old")), "path", "left")
    return both.filter(~F.col("sha256").eqNullSafe(F.col("old"))).drop("old")


def write_epoch(versions: DataFrame, epoch: int, target: str, most: int = CHUNK_BYTES) -> None:
    """Index the versions of one epoch. Chunks are written first: what ``files`` does not list yet is not seen."""
    spark = versions.sparkSession
    new = changed(versions, latest(spark, target, epoch)).withColumn("parts", F.when(F.col("text").isNotNull(), chunks(F.col("text"), most)))
    new.select("path", F.posexplode("parts").alias("chunk_index", "text"), F.size("parts").alias("chunk_count")).select("path", "chunk_index", "chunk_count", "text").write.mode("overwrite").parquet(f"{target}/chunks/epoch={epoch}")
    new.select("path", "sha256", F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_chunks")).write.mode("overwrite").parquet(f"{target}/files/epoch={epoch}")


def follow(spark: SparkSession, source: str, target: str, checkpoint: str, most: int = CHUNK_BYTES) -> None:
    """Index what versions(path, text, modified) have come to a folder, and stop when all are done."""
    stream = spark.readStream.schema(VERSION).parquet(source)
    stream.writeStream.foreachBatch(lambda batch, epoch: write_epoch(batch, epoch, target, most)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def compacted(spark: SparkSession, target: str, fresh: str) -> None:
    """Write the present state to a new folder, as one epoch before all others: what was replaced or removed is gone."""
    now, pieces = files(spark, target), current(spark, target)
    pieces.select("path", "chunk_index", "chunk_count", "text").write.parquet(f"{fresh}/chunks/epoch=-1")
    now.select("path", "sha256", "n_chunks").write.parquet(f"{fresh}/files/epoch=-1")
