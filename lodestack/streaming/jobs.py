"""Structured Streaming jobs: lifecycle state, run metrics, continuous indexing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "note_id long, kind string, at timestamp"


def lifecycle(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Keyed state from a stream of (note_id, kind: promote or supersede, at): the first event by time decides, later ones
    are no-ops. An aggregation: state is one small row a note and is kept for good, as a note may be named again at any
    time and must then stay as it was decided; the watermark bounds no state here."""
    return events.withWatermark("at", late).groupBy("note_id").agg(F.min_by("kind", "at").alias("first_kind"), F.count(F.lit(1)).alias("n_events")).select("note_id", F.when(F.col("first_kind") == "promote", "confirmed").otherwise("superseded").alias("status"), "n_events")


def metrics(events: DataFrame) -> DataFrame:
    return events.groupBy("event", "runner").agg(F.count(F.lit(1)).alias("n"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("at", late).groupBy(F.window("at", width), "event").agg(F.count(F.lit(1)).alias("n"))


def continuous_index(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Index new files of a folder as they come, once each, and stop when all that are there are done."""
    from lodestack.operators.search import file_index

    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        file_index(batch).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
