"""Vector tables, filtered cosine search, reranking and budgeted contexts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.text import context_block, token_estimate

#: Queries whose vectors may be sent to every task (256 MB of 1,000 doubles); more are searched in blocks.
QUERY_BLOCK = 32_768


def ingest(new: DataFrame, store: DataFrame, key: str = "chunk_id", replace: bool = False) -> DataFrame:
    """The store after an ingest: new keys are appended, known ones are left as they are; ``replace`` starts over."""
    return new if replace else store.unionByName(new.join(store.select(key).distinct(), key, "left_anti"))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine similarity with one query vector, in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    size = float(np.sqrt(np.square(np.asarray(query, dtype=float)).sum()))
    return dot / F.nullif(norm * F.lit(size), F.lit(0.0))


def top_k(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding", where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """The k most similar rows, ties by key; the filter comes before, the threshold after the cut.

    Null vectors and those of another length are never found.
    """
    rows = vectors.filter(where) if where is not None else vectors
    rows = rows.filter(F.size(vector) == len(query)).withColumn("score", F.round(cosine(F.col(vector), query), 6)).drop(vector)
    best = rows.orderBy(F.desc("score"), key).limit(k)
    return best.filter(F.col("score") >= threshold) if threshold is not None else best


def rerank(found: DataFrame, score: Column, k: int, key: str = "vec_id") -> DataFrame:
    """A second scoring of an over-fetched result: the new score replaces the old, order before breaks ties."""
    old = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
    return found.withColumn("_old", old).withColumn("score", score).orderBy(F.desc("score"), "_old").limit(k).drop("_old")


def knn(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every query row its k nearest other rows: query_id, key, rank, score.

    Exact search in blocks: the queries of a block travel to the tasks as one
    matrix (QUERY_BLOCK bounds it), each batch of rows is multiplied with it and
    gives each query's best k of the batch, and a grouped rank keeps the best.
    """
    ids = queries.filter(F.col(vector).isNotNull())
    blocks = max(1, -(-ids.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        own = ids if blocks == 1 else ids.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        part = _knn_block(vectors, own, k, key, vector)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", key, "rank", "score")


def _knn_block(vectors: DataFrame, queries: DataFrame, k: int, key: str, vector: str) -> DataFrame:
    got = queries.select(F.col(key).cast("bigint"), vector).toPandas()
    if not len(got):
        return vectors.sparkSession.createDataFrame([], f"query_id bigint, {key} bigint, score double")
    q_ids = got.iloc[:, 0].to_numpy()
    q = np.stack([np.asarray(v, dtype=float) for v in got.iloc[:, 1]])
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    sent = vectors.sparkSession.sparkContext.broadcast((q_ids, q))

    def search(batches):
        ids, m = sent.value
        for pdf in batches:
            pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) == m.shape[1])]
            if not len(pdf):
                continue
            x = np.stack([np.asarray(v, dtype=float) for v in pdf[vector]])
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            own = pdf[key].to_numpy()
            sims = np.round(m @ x.T, 6)
            sims[ids[:, None] == own[None, :]] = -np.inf
            take = min(k, sims.shape[1])
            edge = np.partition(sims, sims.shape[1] - take, axis=1)[:, sims.shape[1] - take]
            for i, row in enumerate(sims):
                best = np.flatnonzero(row >= edge[i])  # the best and all that tie with the last of them
                at = best[np.lexsort((own[best], -row[best]))[:take]]
                at = at[np.isfinite(row[at])]
                yield pd.DataFrame({"query_id": np.full(len(at), ids[i]), key: own[at], "score": row[at]})

    return vectors.select(F.col(key).cast("bigint").alias(key), vector).mapInPandas(search, f"query_id bigint, {key} bigint, score double")


def context(ranked: DataFrame, budget: int = 3000, rank: str = "rank", content: str = "content", url: str = "source_url", hierarchy: str = "heading_hierarchy") -> DataFrame:
    """One row ``context``: chunks in rank order while their tokens fit the budget, stopping at the first that doesn't.

    A first chunk over the budget gives an empty text, no chunk at all a sentence.
    ``ranked`` is a top-k result, so its size is bounded by k.
    """
    tokens = token_estimate(F.col(content))
    run = ranked.withColumn("_upto", F.sum(tokens).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)))
    block = context_block(F.coalesce(F.col(url), F.lit("")), F.col(hierarchy), F.col(content))
    kept = F.collect_list(F.when(F.col("_upto") <= budget, F.struct(F.col(rank).alias("r"), block.alias("b"))))
    text = F.array_join(F.transform(F.array_sort(kept), lambda x: x["b"]), "\n\n---\n\n")
    return run.agg(F.when(F.count(F.lit(1)) == 0, "No relevant documentation found.").otherwise(text).alias("context"))


def store_stats(chunks: DataFrame) -> DataFrame:
    """section, chunks, code_chunks; the grand total has section null; a missing section is 'unknown'."""
    named = chunks.withColumn("section", F.coalesce("section", F.lit("unknown")))
    out = named.rollup("section").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("has_code", F.lit(False))).alias("code_chunks"))
    return out


def retriever(store: DataFrame, embedder, k: int = 6, section: str | None = None, code_only: bool = False, threshold: float | None = None, rescore: Callable[[str], Column] | None = None, key: str = "chunk_id") -> Callable[[str], DataFrame]:
    """A function from a question to its best rows of store(key, content, section, has_code, embedding, ...), ranked.

    With ``rescore`` three times k rows are fetched and put in the order of the
    new score.  The question's vector has to be as long as those of the store.
    """
    where = F.lit(True)
    if section is not None:
        where = where & (F.col("section") == section)
    if code_only:
        where = where & F.col("has_code")

    def search(question: str) -> DataFrame:
        vector = [float(x) for x in embedder.embed_query(question)]
        found = top_k(store, vector, 3 * k if rescore else k, key, where=where, threshold=threshold)
        best = rerank(found, rescore(question), k, key) if rescore else found
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))

    return search


def previews(found: DataFrame, rank: str = "rank", content: str = "content", hierarchy: str = "heading_hierarchy") -> DataFrame:
    """Result rows as they are shown: rank, score with three decimals, heading, start of the text."""
    return found.select(
        F.col(rank).alias("rank"), F.format_string("%.3f", F.col("score")).alias("score"),
        F.substring(F.coalesce(F.array_join(hierarchy, " > "), F.lit("")), 1, 30).alias("heading"),
        F.concat(F.substring(F.translate(content, "\n", " "), 1, 120), F.lit("...")).alias("preview"),
    )
