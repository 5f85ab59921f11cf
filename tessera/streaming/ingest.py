"""Resumable ingest: a file source drained by ``availableNow``, each batch merged by key into a table.

A batch writes its own folder, named by its number, so a batch run again after a crash replaces itself and nothing is
marked done before it is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str, pattern: str = "*.parquet", max_files: int = 1000) -> None:
    """Append new rows of ``source`` to ``target``, once for each key within a batch; returns when all files are read.

    Rows of one key in several batches are told apart by ``batch``; :func:`current` reads the first.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", max_files).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates([key]).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, target: str, key: str) -> DataFrame:
    """One row for each key: that of its first batch. Partial aggregation, so a hot key is no bottleneck."""
    rows = spark.read.option("basePath", target).parquet(target)
    rest = [c for c in rows.columns if c not in (key, "batch")]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), "batch").alias("r"))
    return first.select(key, *[F.col("r")[c].alias(c) for c in rest])


def event_counts(events: DataFrame, at: str, kind: str, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Windowed counts by kind with a watermark; ``at`` without zone is read as UTC."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.groupBy(F.window("__at", every).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "kind", "n")


def count_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, at: str, kind: str, pattern: str = "*.parquet", every: str = "1 day") -> DataFrame:
    """:func:`event_counts` of all files there are, kept as a table that each batch replaces, and read from it."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    counts = event_counts(stream, at, kind, every)
    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)
