"""Session set-up and table access."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "sedimenta", cpus: int | str = "*", partitions: int = 8, memory: str = "8g", shared: str | None = None) -> SparkSession:
    """A local session with the settings that the queries expect (UTC, AQE, Arrow).

    ``shared`` is the folder for staged tables (spark.checkpoint.dir); without it
    one of this machine is made when it is first needed.
    """
    builder = SparkSession.builder.config("spark.checkpoint.dir", shared) if shared else SparkSession.builder
    return (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of a session, once, where they couldn't import it from a shared path."""
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_sedimenta_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sedimenta-"), "sedimenta.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("sedimenta", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._sedimenta_shipped = True
