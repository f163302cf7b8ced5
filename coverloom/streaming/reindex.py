"""Incremental scan: changed files arrive as a stream and their rows replace those of the same path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.registry import Adapter, read


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of (path, content, version) rows from Parquet files of changes."""
    return spark.readStream.schema("path string, content binary, version long").parquet(folder)


def reindex(changes: DataFrame, adapter: Adapter, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the rows of each micro-batch with its files' versions; latest() keeps the newest of a path."""

    def write(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by("content", "version").alias("content"), F.max("version").alias("version"))
        rows = read(newest.select("path", "content"), adapter)
        paths = newest.select("path", "version")
        paths.join(rows, "path", "left").write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    rows = spark.read.parquet(target)
    newest = rows.groupBy("path").agg(F.max("version").alias("version"))
    return rows.join(newest, ["path", "version"], "left_semi").where("source is not null")
