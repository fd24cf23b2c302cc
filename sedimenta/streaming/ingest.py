"""Incremental ingest and event windows as streams."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..plans.staging import fresh_folder


def stream_ingest(spark: SparkSession, source: str, schema: str, key: str = "chunk_id", order: str = "chunk_row", files_per_batch: int = 4, base: str | None = None) -> DataFrame:
    """Reads a growing parquet folder to its end; each micro-batch appends rows whose key is not stored yet.

    Of rows with one key in a batch the first in ``order`` is stored.  Store and
    progress live under ``base`` (without it, in a new folder of the shared one):
    a later call with the same base reads only files that are new since then.  A
    batch writes a folder of its own, which a repeated batch overwrites, so that
    a restart stores nothing twice.
    """
    base = base or fresh_folder(spark, "stream")
    store = f"{base}/store"
    fields = spark.createDataFrame([], schema).schema
    keys = spark.createDataFrame([], schema).select(key).schema

    def stored(columns, before: int | None = None) -> DataFrame:
        rows = spark.read.schema(StructType([*columns.fields, StructField("batch", LongType())])).parquet(store)
        return rows if before is None else rows.filter(F.col("batch") != before)

    def append(batch: DataFrame, number: int) -> None:
        known = stored(keys, number).select(key)
        first = batch.groupBy(key).agg(F.min(order).alias("_o"))
        fresh = batch.join(first, key).filter(F.col(order) == F.col("_o")).drop("_o").dropDuplicates([key]).join(known, key, "left_anti")
        fresh.select(*fields.names).write.mode("overwrite").parquet(f"{store}/batch={number}")

    spark.createDataFrame([], fields).write.mode("ignore").parquet(f"{store}/batch=-1")
    reader = spark.readStream.schema(fields).option("maxFilesPerTrigger", files_per_batch)
    if os.path.isfile(source):  # a stream reads folders: of a single file, its folder by name
        reader, source = reader.option("pathGlobFilter", os.path.basename(source)), os.path.dirname(source)
    stream = reader.parquet(source)
    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stored(fields).drop("batch")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; works on a stream (late rows beyond the watermark are dropped) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
