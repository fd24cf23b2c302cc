"""Breadth-first traversal of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.staging import staged


def crawl(links: DataFrame, roots: DataFrame, max_depth: int | None, max_pages: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """links(src, dst), roots(page) -> page, depth: every page within reach, at its least depth.

    One join per depth: the frontier meets the links, pages seen before fall out
    by an anti-join, and each level is written down, so the plan stays short.
    Without ``max_depth`` it goes on until nothing new is found.  ``max_pages``
    keeps that many pages, by depth and then by name.
    """
    edges = links.select(F.col(src).alias("src"), F.col(dst).alias("dst")).distinct()
    seen = staged(roots.select("page").filter("page is not null").distinct().withColumn("depth", F.lit(0)), "crawl")
    frontier = seen
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        found = frontier.select(F.col("page").alias("src")).join(edges, "src").select(F.col("dst").alias("page")).filter("page is not null").distinct()
        frontier = staged(found.join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(d)), "crawl")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen if max_pages is None else seen.orderBy("depth", "page").limit(max_pages)


def crawl_sections(links: DataFrame, bases: DataFrame, max_depth: int | None = None) -> DataFrame:
    """bases(page, section, priority[, max_depth]): page, depth, section, priority of the pages of all sections.

    All sections walk side by side, one join per depth, each up to its own depth
    (null: to ``max_depth``, or to the end).  A page reached from several belongs
    to the first by priority, then name.
    """
    edges = links.select(F.col("src"), F.col("dst")).filter("dst is not null").distinct()
    own = F.col("max_depth") if "max_depth" in bases.columns else F.lit(None)
    limit = F.coalesce(own, F.lit(max_depth)).cast("int").alias("max_depth")
    seen = staged(bases.select("section", "page", "priority", limit).filter("page is not null").distinct().withColumn("depth", F.lit(0)), "crawl")
    frontier = seen
    d = 0
    while True:
        d += 1
        more = frontier.filter(F.col("max_depth").isNull() | (F.col("max_depth") >= d))
        found = more.join(edges, F.col("page") == F.col("src")).select("section", F.col("dst").alias("page"), "priority", "max_depth").distinct()
        frontier = staged(found.join(seen.select("section", "page"), ["section", "page"], "left_anti").withColumn("depth", F.lit(d)), "crawl")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    first = F.min_by(F.struct("section", "depth", "priority"), F.struct("priority", "section"))
    return seen.groupBy("page").agg(first.alias("f")).select("page", "f.section", "f.depth", "f.priority")
