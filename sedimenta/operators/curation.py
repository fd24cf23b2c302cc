"""Cleaning, deduplicating and splitting instruction data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import is_blank, near_key, strip, token_estimate, words

MIN_WORDS, MAX_WORDS, MIN_CHARS, MAX_CHARS = 3, 200, 20, 10_000


def has_fields(instruction: str = "instruction", output: str = "output") -> Column:
    return ~is_blank(F.col(instruction)) & ~is_blank(F.col(output))


def length_reason(instruction: str = "instruction", output: str = "output") -> Column:
    """Why a row fails the length gate, or null: the first failing test counts; blanks at the ends don't."""
    n, m = F.size(words(F.coalesce(F.col(instruction), F.lit("")))), F.length(strip(F.coalesce(F.col(output), F.lit(""))))
    return (
        F.when(n < MIN_WORDS, "instruction_short").when(n > MAX_WORDS, "instruction_long")
        .when(m < MIN_CHARS, "output_short").when(m > MAX_CHARS, "output_long")
    )


def reject_reasons(rows: DataFrame, order: str = "row_id", instruction: str = "instruction", output: str = "output") -> DataFrame:
    """rows with ``reason``: empty, exact_duplicate, near_duplicate, a length reason, or null for kept rows.

    The stages apply in that order and each sees only what the ones before kept;
    of duplicates the first in ``order`` stays.  The first of each key is found
    by a grouped minimum, which combines before the shuffle, so a key that holds
    a large share of the rows costs no task more than others.
    """
    full = has_fields(instruction, output)
    keyed = rows.withColumn("_full", full).withColumn("_x", F.when(full, F.sha2(F.col(instruction), 256)))
    first = keyed.filter("_full").groupBy("_x").agg(F.min(order).alias("_first"), F.min(near_key(F.col(instruction))).alias("_key"))
    near = first.groupBy(F.sha2("_key", 256).alias("_k")).agg(F.min("_first").alias("_near_first"))
    marks = first.withColumn("_k", F.sha2("_key", 256)).join(near, "_k").select("_x", "_first", "_near_first")
    joined = keyed.join(marks, "_x", "left")
    reason = (
        F.when(~F.col("_full"), "empty")
        .when(F.col(order) != F.col("_first"), "exact_duplicate")
        .when(F.col(order) != F.col("_near_first"), "near_duplicate")
        .otherwise(length_reason(instruction, output))
    )
    return joined.withColumn("reason", reason).drop("_full", "_x", "_first", "_near_first")


def quality_report(reasons: DataFrame) -> DataFrame:
    """One row of counters over reject reasons, counted by reason first, so that each row's reason is worked out once."""
    by = reasons.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    n = lambda *r: total(F.col("reason").isin(*r))
    return by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_in"),
        n("empty").alias("empty"),
        n("exact_duplicate").alias("exact_duplicates"),
        n("near_duplicate").alias("near_duplicates"),
        n("instruction_short", "output_short").alias("too_short"),
        n("instruction_long", "output_long").alias("too_long"),
        total(F.col("reason").isNull()).alias("total_out"),
        total(F.col("reason").isNotNull()).alias("removed"),
    )


def formattable(max_tokens: int = 2048, instruction: str = "instruction", output: str = "output") -> Column:
    """Rows worth formatting: both fields filled and a quarter of their characters within the sequence length."""
    return has_fields(instruction, output) & (F.floor((F.length(instruction) + F.length(output)) / 4) <= max_tokens)


def train_eval_split(rows: DataFrame, key: str = "row_id", share: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with ``part``: floor(n * share) rows are eval, chosen by a seeded hash, the rest train.

    The exact size is kept without sorting all rows in one task: hashes are
    counted by their first two bytes, the bytes below the edge are eval whole,
    and only rows of the byte pair at the edge are ranked.
    """
    hashed = rows.withColumn("_h", F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")), 256)).withColumn("_b", F.substring("_h", 1, 4))
    sizes = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # at most 65,536 rows
    upto = sizes.withColumn("_upto", F.sum("_n").over(Window.orderBy("_b"))).withColumn("_want", F.floor(F.sum("_n").over(Window.partitionBy()) * F.lit(share)))
    edges = F.broadcast(upto.select("_b", (F.col("_want") - (F.col("_upto") - F.col("_n"))).alias("_room"), "_n"))
    placed = hashed.join(edges, "_b")
    inner = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    edge = placed.filter(inner).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    edge = edge.withColumn("part", F.when(F.col("_r") <= F.col("_room"), "eval").otherwise("train")).drop("_r")
    rest = placed.filter(~inner).withColumn("part", F.when(F.col("_room") >= F.col("_n"), "eval").otherwise("train"))
    return rest.unionByName(edge).drop("_h", "_b", "_room", "_n")


def dataset_stats(split: DataFrame, seeds: DataFrame, skipped: DataFrame) -> DataFrame:
    """total, train, eval, seeds, skipped: seeds join the training part only."""
    a = split.agg(F.count_if(F.col("part") == "train").alias("t"), F.count_if(F.col("part") == "eval").alias("e"))
    b, c = seeds.agg(F.count(F.lit(1)).alias("s")), skipped.agg(F.count(F.lit(1)).alias("k"))
    one = a.crossJoin(b).crossJoin(c)  # three single rows
    return one.select((F.col("t") + F.col("s") + F.col("e")).alias("total"), (F.col("t") + F.col("s")).alias("train"), F.col("e").alias("eval"), F.col("s").alias("seeds"), F.col("k").alias("skipped"))


def generation_summary(stats: DataFrame) -> DataFrame:
    """Counters of generation batches by source."""
    total = F.sum("total_generated")
    return stats.groupBy("source").agg(
        F.count(F.lit(1)).alias("batches"), total.alias("generated"), F.sum("schema_valid").alias("valid"),
        F.round(F.sum("schema_valid") / F.greatest(total, F.lit(1)) * 100, 4).alias("valid_pct"),
        F.sum("api_calls").alias("calls"), F.sum("api_errors").alias("errors"), F.round(F.sum(F.coalesce("api_cost_estimate_usd", F.lit(0.0))), 6).alias("cost"),
    )


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Dollars of a request by its tokens, at the rates of a small hosted model."""
    return (tokens_in * F.lit(0.15) + tokens_out * F.lit(0.60)) / F.lit(1e6)


def union_tagged(parts: dict[str, DataFrame], columns: list[str], tag: str = "origin") -> DataFrame:
    """All parts one under the other, each row tagged with the name of its part."""
    out = None
    for name, df in parts.items():
        own = df.select(*columns).withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own)
    return out


def training_parts(split: DataFrame, seeds: DataFrame, columns: list[str], seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, eval): the eval part as it is, and the rest with all seeds, each in a seeded order by hash."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(c) for c in columns])
    train = split.filter("part = 'train'").select(*columns).unionByName(seeds.select(*columns)).orderBy(F.sha2(text, 256))
    return train, split.filter("part = 'eval'").select(*columns).orderBy(F.sha2(text, 256))


__all__ = ["dataset_stats", "formattable", "generation_summary", "has_fields", "length_reason", "quality_report", "reject_reasons", "token_estimate", "train_eval_split"]
