"""Cutting lineage through tables in the shared folder of the cluster.

The folder is the one that ``spark.checkpoint.dir`` names.  Only where that is
unset, as in tests on one machine, a folder of the local machine is made.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; also sets it as checkpoint folder where there is none yet."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def fresh_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder in the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a frame once as a zstd parquet table in the shared folder and return a scan of it.

    Later readers neither recompute it nor depend on executors that ran before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the folder of a staged frame, or of the one part of it that df reads, when nothing will read it again."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clear_staged(spark: SparkSession) -> None:
    """Deletes the tables that this application staged; results that are read from them lazily have to be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/staged/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has at most so many (short) rows, counted now; else unmarked, for a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a scan has fewer partitions than there are cores, as with one small file; else as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
