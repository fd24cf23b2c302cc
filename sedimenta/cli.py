"""Command line: ``python -m sedimenta.cli VERB ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.embedders import create_embedder, embed
from .functions.html import extract_pages, scraped_pages
from .operators import chunking, configs, evaluation, retrieval, scripts
from .session import build_session, ship
from .sources import files

STORE = files.CHUNK_SCHEMA + ", embedding array<float>"


def scrape(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Fetches the pages of a list of addresses (a text file) and saves them by section."""
    from .sources.web import fetch_pages

    urls = [r[0] for r in spark.read.text(a.urls).collect()]  # a list that a person wrote
    pages = scraped_pages(extract_pages(fetch_pages(spark, urls, a.delay))).withColumns({"section": F.lit(a.section), "section_label": F.lit(a.section)})
    files.save_pages(pages.select(*[f.split()[0] for f in files.PAGE_SCHEMA.split(", ")]), a.out)
    return spark.read.json(f"{a.out}/manifest")


def chunk(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Cuts saved pages into chunks."""
    files.save_chunks(chunking.chunk_pages(files.load_pages(spark, a.pages), a.size, a.overlap), a.out)
    return spark.read.json(f"{a.out}/stats")


def ingest(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Embeds chunks that the store doesn't have yet and appends them."""
    rows = files.load_chunks(spark, f"{a.chunks}/rows").withColumn("embedding", embed(F.col("content"), create_embedder(a.embedder)))
    n = files.VectorTable(spark, a.store, STORE).ingest(rows, replace=a.replace)
    return spark.createDataFrame([(n,)], "ingested long")


def pipeline(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Saved pages to a filled store."""
    chunk(spark, argparse.Namespace(pages=a.pages, out=a.out, size=a.size, overlap=a.overlap))
    return ingest(spark, argparse.Namespace(chunks=a.out, store=a.store, embedder=a.embedder, replace=a.replace))


def query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The best chunks for a question, or one context of them."""
    store = files.VectorTable(spark, a.store, STORE).rows()
    found = retrieval.retriever(store, create_embedder(a.embedder), a.top_k, a.section, a.code_only)(a.question)
    return retrieval.context(found, a.tokens) if a.context else retrieval.previews(found)


def stats(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Chunks of a store by section."""
    return retrieval.store_stats(files.VectorTable(spark, a.store, STORE).rows()).orderBy("section")


def _configs(spark: SparkSession, path: str) -> DataFrame:
    texts = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("output"))
    return texts.withColumn("row_id", F.xxhash64("name"))


def validate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Validity, errors and warnings of configuration files."""
    rows = _configs(spark, a.configs)
    return configs.validate(rows).join(rows.select("row_id", "name"), "row_id").select("name", "is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


def plan(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """What the scripts of configuration files would do."""
    return scripts.script_summaries(configs.parse_configs(_configs(spark, a.configs)))


def apply(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Writes the scripts of valid configuration files as one table."""
    rows = _configs(spark, a.configs)
    parsed = configs.parse_configs(rows).join(configs.validate(rows).filter("is_valid").select("row_id"), "row_id", "left_semi")
    files.save_scripts(scripts.scripts(parsed), parsed.join(rows.select("row_id", F.col("output").alias("config")), "row_id"), a.out)
    return spark.read.parquet(a.out).select("name")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Rates of examples (.json or .jsonl) whose outputs parse and are valid."""
    rows = files.load_examples(spark, a.examples).withColumn("row_id", F.monotonically_increasing_id())
    return evaluation.compliance(configs.schema_eval(rows), "yaml_ok", "schema_ok")


def config(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The settings in force."""
    return spark.createDataFrame([(k, str(v)) for k, v in vars(files.Settings.from_env()).items()], "setting string, value string")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """A named query over a folder of tables."""
    from .plans import catalogue

    return catalogue.queries()[a.name](spark, a.tables)


VERBS = {
    "scrape": (scrape, ["urls", "out", "--section=pages", "--delay=0.5"]),
    "chunk": (chunk, ["pages", "out", "--size=1000", "--overlap=150"]),
    "ingest": (ingest, ["chunks", "store", "--embedder=hashing", "--replace"]),
    "pipeline": (pipeline, ["pages", "out", "store", "--size=1000", "--overlap=150", "--embedder=hashing", "--replace"]),
    "query": (query, ["store", "question", "--embedder=hashing", "--top-k=6", "--section=", "--code-only", "--context", "--tokens=3000"]),
    "stats": (stats, ["store"]),
    "validate": (validate, ["configs"]),
    "plan": (plan, ["configs"]),
    "apply": (apply, ["configs", "out"]),
    "eval": (evaluate, ["examples"]),
    "config": (config, []),
    "run": (run, ["name", "tables"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sedimenta", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for verb, (f, args) in VERBS.items():
        own = verbs.add_parser(verb, help=f.__doc__)
        for x in args:
            name, has_default, default = x.partition("=")
            if has_default:
                kind = int if default.isdigit() else float if default.replace(".", "", 1).isdigit() else str
                own.add_argument(name, type=kind, default=kind(default) if default else None)
            else:
                own.add_argument(name, **({"action": "store_true"} if x.startswith("--") else {}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(argv)
    spark = spark or build_session()
    ship(spark)
    out = VERBS[args.verb][0](spark, args)
    out.show(50, truncate=False)
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
