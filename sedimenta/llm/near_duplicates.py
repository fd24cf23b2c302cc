"""Problem 1: groups of records that repeat each other with small edits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .alike import THRESHOLD, block_pairs, meetings, may_match, pair_text, postings, scan, sketch_of, verify
from .components import components


def near_duplicate_groups(records: DataFrame, id_col: str = "row_id", instruction: str = "instruction", output: str = "output", threshold: float = THRESHOLD) -> DataFrame:
    """One row (row_id, group_id) per record; group_id is the least row_id of the record's group.

    Method: distinct triples of a record are put in rare-first order; records
    are joined on the triples of their prefix, under length, positional and
    suffix filters, and each remaining pair of classes is verified once.  Groups
    are the components of the alike pairs.  Only classes of equal triple sets
    take part, so copies never multiply.

    Null or empty texts and texts with fewer than three words are alike to
    nothing and form groups of their own.  Rows with a null id are left out.
    Repeated ids count as one record's copies.  Columns beyond the three named
    ones are ignored, whatever their names.
    """
    rows = records.select(F.col(id_col).cast("bigint").alias("row_id"), pair_text(instruction, output).alias("text"), F.lit(0).alias("side")).filter("row_id is not null")
    signs, parts, bits = scan(rows)
    edges = alike_classes(rows, signs, sketch_of(parts, bits), threshold)
    roots = components(edges.select(F.col("sig_a").alias("u"), F.col("sig_b").alias("v")))
    of = signs.join(roots.withColumnRenamed("node", "sig"), "sig", "left")
    key = F.when(F.col("n") == 0, F.struct(F.lit(False).alias("k"), F.col("row_id").alias("x"))).otherwise(F.struct(F.lit(True).alias("k"), F.coalesce("root", "sig").alias("x")))
    of = of.select("row_id", key.alias("key"))
    least = of.groupBy("key").agg(F.min("row_id").alias("group_id"), F.count_distinct("row_id").alias("cnt"))
    return of.join(least, "key").select("row_id", "group_id", "cnt")


def alike_classes(rows: DataFrame, signs: DataFrame, cells: np.ndarray, threshold: float) -> DataFrame:
    """Alike pairs (sig_a, sig_b, similarity) of different classes."""
    post = postings(rows, cells, threshold).drop("side")
    met = meetings(post, ["gram"], ["sig", "n", "pos", "p0", "p1"], lambda a, b: may_match(a, b, threshold), "meetings", ["gram", "sig"])
    pairs = met.select(F.col("a.sig").alias("sig_a"), F.col("b.sig").alias("sig_b")).distinct()
    return verify(rows, signs, pairs, threshold)


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs of different records of one group, the smaller id first: the form that problem 1 asks for."""
    rows = groups.filter("cnt > 1").select("row_id", "group_id", "cnt").distinct()
    pairs = block_pairs(rows.select("group_id", "cnt", F.struct("row_id").alias("item")), ["group_id"], "item")
    return pairs.select(F.col("a.row_id").alias("row_id_a"), F.col("b.row_id").alias("row_id_b"))
