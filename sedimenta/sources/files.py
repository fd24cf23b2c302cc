"""Scans and sinks: page folders with manifest, chunk and example files, vector tables, scripts."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

CHUNK_SCHEMA = "chunk_id string, content string, source_url string, source_title string, section string, section_label string, token_count int, heading_hierarchy array<string>, breadcrumb array<string>, has_code boolean"
PAGE_SCHEMA = "url string, title string, section string, section_label string, content string, code_blocks array<string>, headings array<string>, breadcrumb array<string>, url_hash string"


def save_pages(pages: DataFrame, path: str) -> None:
    """Pages as JSON by section, and a manifest (file key, url, title, section)."""
    keyed = pages.withColumn("filename", F.concat_ws("_", "section", "url_hash"))
    keyed.write.mode("overwrite").partitionBy("section").json(f"{path}/pages")
    keyed.select("filename", "url", "title", "section").write.mode("overwrite").json(f"{path}/manifest")


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages that the manifest names; a missing page is skipped, a missing manifest is an error."""
    manifest = spark.read.schema("filename string, url string, title string, section string").json(f"{path}/manifest")
    pages = spark.read.schema(PAGE_SCHEMA + ", filename string").option("ignoreMissingFiles", "true").json(f"{path}/pages")
    return pages.join(manifest.select("filename"), "filename", "left_semi").drop("filename")


def save_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line, UTF-8 as it is."""
    rows.write.mode("overwrite").json(path)


def load_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines with their schema; blank lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "PERMISSIVE").json(path).filter("chunk_id is not null")


def load_examples(spark: SparkSession, path: str, schema: str = "instruction string, output string") -> DataFrame:
    """Examples by suffix: .jsonl has one object a line, .json an array; others are an error."""
    suffix = os.path.splitext(path)[1]
    if suffix not in (".jsonl", ".json"):
        raise ValueError(f"unsupported file: {path}")
    return spark.read.schema(schema).option("multiLine", suffix == ".json").json(path)


def unwrap_payload(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, instruction, output: the examples in an answer, an array itself or the first array under a usual name."""
    kind = "array<struct<instruction:string, output:string>>"
    names = ("examples", "variations", "data", "items", "results")
    inside = F.from_json(payload, "struct<" + ", ".join(f"{n}:{kind}" for n in names) + ">")
    none = F.array().cast(kind)
    listed = F.when(F.ltrim(payload).startswith("["), F.coalesce(F.from_json(payload, kind), none)).otherwise(F.coalesce(*[inside[n] for n in names], none))
    return rows.select(key, F.explode(listed).alias("e")).select(key, "e.*")


def save_with_stats(rows: DataFrame, stats: DataFrame, path: str) -> None:
    """Rows as JSON lines and their statistics (a row or a few) beside them."""
    save_lines(rows, f"{path}/rows")
    stats.coalesce(1).write.mode("overwrite").json(f"{path}/stats")


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, and their count, tokens, average, code chunks and sections."""
    from ..operators.chunking import chunk_stats

    save_with_stats(chunks, chunk_stats(chunks), path)


def save_split(train: DataFrame, evaluation: DataFrame, path: str) -> None:
    """The two parts of a training set, one folder each."""
    save_lines(train, f"{path}/train")
    save_lines(evaluation, f"{path}/eval")


def save_results(runs: DataFrame, path: str, run: str = "run", category: str = "category") -> None:
    """Results of runs(run, category, passed, ...) as JSON lines, beside their mean, least and most pass rate over runs."""
    from ..operators.evaluation import cross_run

    save_with_stats(runs, cross_run(runs, run, category), path)


def save_scripts(scripts: DataFrame, configs: DataFrame, path: str, key: str = "row_id") -> None:
    """One table of name, config and script; the name is a slug of the description and the key.

    A file for each configuration would be millions of them; ``export_script`` writes
    one to disk where it is to be run.
    """
    from ..functions.text import dir_slug

    named = configs.select(key, F.concat_ws("-", dir_slug(F.coalesce("description", F.lit("output"))), F.col(key).cast("string")).alias("name"), "config")
    named.join(scripts, key).write.mode("overwrite").parquet(path)


def export_script(spark: SparkSession, path: str, name: str, folder: str) -> str:
    """Writes the config and the executable script of one name into folder/name and returns that."""
    row = spark.read.parquet(path).filter(F.col("name") == name).first()
    if row is None:
        raise KeyError(name)
    out = os.path.join(folder, os.path.basename(name))
    os.makedirs(out, exist_ok=True)
    for file, text in (("config.yaml", row["config"]), ("script.py", row["script"])):
        with open(os.path.join(out, file), "w", encoding="utf-8") as f:
            f.write(text or "")
    os.chmod(os.path.join(out, "script.py"), 0o755)
    return out


class VectorTable:
    """A vector collection as a parquet table: rows (chunk_id, content, embedding, ...)."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # a table that isn't there yet is empty
            if "PATH_NOT_FOUND" in str(e):
                return self.spark.createDataFrame([], self.schema)
            raise

    def ingest(self, new: DataFrame, key: str = "chunk_id", replace: bool = False) -> int:
        """Appends rows with new keys and returns how many there were; ``replace`` starts over."""
        from pyspark.sql import Observation

        fresh = new if replace else new.join(self.rows().select(key).distinct(), key, "left_anti")
        seen = Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite" if replace else "append").parquet(self.path)
        return seen.get["n"]

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


@dataclass
class Settings:
    """Settings with typed defaults; SEDIMENTA_<NAME> in the environment overrides."""

    chunk_size: int = 1000
    chunk_overlap: int = 150
    min_chunk_size: int = 100
    top_k: int = 6
    context_tokens: int = 3000
    eval_share: float = 0.1
    template: str = "mistral"

    @classmethod
    def from_env(cls) -> Settings:
        got = {}
        for f in fields(cls):
            raw = os.environ.get(f"SEDIMENTA_{f.name.upper()}")
            if raw is not None:
                got[f.name] = type(f.default)(raw)
        return cls(**got)
