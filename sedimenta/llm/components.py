"""Connected components by alternating large-star and small-star steps.

Labels never leave the executors; each round is written to the shared folder,
so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import staged


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(u, v) -> (node, root): root is the least node of each component; only nodes with an edge come out.

    Empty input gives an empty result; self-loops and repeated edges do nothing.
    Rounds grow with the logarithm of the longest path.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        # large star: every larger neighbour is linked to the least of the neighbourhood
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v"))
        now = staged(small.filter("u <> v").distinct(), name)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == before or state[0] == 0:
            break
        before = tuple(state)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
