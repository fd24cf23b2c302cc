"""Queries over the vector table and chunk store."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..session import table
from ..streaming.ingest import event_counts, stream_ingest

_COS = "round(list_sum(list_transform(generate_series(1, len(e.embedding)), lambda i: e.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) / (sqrt(list_sum(list_transform(e.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"
_SCORED = f"scored AS (SELECT e.vec_id, e.label, {_COS} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_BY_TIME = "(SELECT *, row_number() OVER (ORDER BY ingested_at, chunk_row) AS r, count(*) OVER () AS n FROM doc_chunk)"
_TOKENS = "CAST(trunc((length(content) - (length(content) - length(regexp_replace(content, '(?s)```.*?```', '', 'g')))) / 4.0::DOUBLE + (length(content) - length(regexp_replace(content, '(?s)```.*?```', '', 'g'))) / 3.2::DOUBLE) AS INT)"


def _query(s, d):
    return [float(x) for x in table(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


def _top(s, d, k=10, where=None, threshold=None):
    return R.top_k(table(s, d, "embeddings"), _query(s, d), k, where=where, threshold=threshold)


def _halves(s, d):
    """The chunk table as a store (rows before 2025-03 by ingest time) and a new delivery (the rest, with repeats)."""
    chunks = table(s, d, "doc_chunk")
    edge = F.lit("2025-02-01 00:00:00").cast("timestamp")
    return chunks.filter(F.col("ingested_at") < edge), chunks.filter(F.coalesce(F.col("ingested_at") >= edge, F.lit(True)))


def _ingest(s, d, replace=False):
    store, new = _halves(s, d)
    return R.ingest(new, store, replace=replace).select("chunk_row", "chunk_id")


def _rerank(s, d):
    return R.rerank(_top(s, d, 30), F.round(F.col("score") + F.col("label") * 0.1, 6), 10)


def _ranked(s, d):
    top = _top(s, d, 12).withColumn("chunk_row", F.col("vec_id") + 1)
    joined = table(s, d, "doc_chunk").join(F.broadcast(top), "chunk_row")
    return joined.withColumn("rank", F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v")))


def _context(s, d):
    return R.context(_ranked(s, d).filter("content is not null"), 600)


def _knn(s, d):
    rows = table(s, d, "embeddings")
    return R.knn(rows, rows.filter("vec_id % 100 = 0"), 5)


def _stream(s, d):
    source = f"{d}/doc_chunk.parquet"
    return stream_ingest(s, source, table(s, d, "doc_chunk").select("chunk_row", "chunk_id", "content").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).select("chunk_id").distinct()


QUERIES = {
    "vector_topk": _top,
    "vector_topk_filtered": lambda s, d: _top(s, d, where=F.col("label").isin(1, 3)),
    "vector_threshold": lambda s, d: _top(s, d, 50, threshold=0.2),
    "rerank_topk": _rerank,
    "knn_batch": _knn,
    "context_budget": _context,
    "ingest_incremental": _ingest,
    "ingest_replace": lambda s, d: _ingest(s, d, True),
    "store_stats": lambda s, d: R.store_stats(table(s, d, "doc_chunk")),
    "stream_ingest": _stream,
    "event_counts": lambda s, d: event_counts(table(s, d, "events")),
}
_EDGE = "TIMESTAMPTZ '2025-02-01 00:00:00+00'"
SQL = {
    "vector_topk": f"WITH {_SCORED} SELECT vec_id, label, score FROM scored ORDER BY score DESC, vec_id LIMIT 10",
    "vector_topk_filtered": f"WITH {_SCORED} SELECT vec_id, label, score FROM scored WHERE label IN (1, 3) ORDER BY score DESC, vec_id LIMIT 10",
    "vector_threshold": f"WITH {_SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 50) SELECT vec_id, label, score FROM t WHERE score >= 0.2",
    "rerank_topk": f"WITH {_SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 30) SELECT vec_id, label, round(score + label * 0.1, 6) AS score FROM t ORDER BY 3 DESC, t.score DESC, vec_id LIMIT 10",
    "knn_batch": f"WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, CAST(rank AS INT) AS rank, score FROM r WHERE rank <= 5",
    "context_budget": f"""WITH {_SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 12),
      c AS (SELECT t.score, t.vec_id, d.*, sum({_TOKENS}) OVER (ORDER BY t.score DESC, t.vec_id ROWS UNBOUNDED PRECEDING) AS upto FROM t JOIN doc_chunk d ON d.chunk_row = t.vec_id + 1 WHERE content IS NOT NULL)
      SELECT CASE WHEN count(*) = 0 THEN 'No relevant documentation found.' ELSE coalesce(string_agg('[Source: ' || coalesce(source_url, '') || ']' || CASE WHEN len(heading_hierarchy) > 0 THEN ' [' || array_to_string(heading_hierarchy, ' > ') || ']' ELSE '' END || chr(10) || content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, vec_id) FILTER (upto <= 600), '') END AS context FROM c""",
    "ingest_incremental": f"WITH old AS (SELECT chunk_row, chunk_id FROM doc_chunk WHERE ingested_at < {_EDGE}) SELECT * FROM old UNION ALL SELECT chunk_row, chunk_id FROM doc_chunk n WHERE coalesce(ingested_at >= {_EDGE}, true) AND NOT EXISTS (SELECT 1 FROM old WHERE old.chunk_id = n.chunk_id)",
    "ingest_replace": f"SELECT chunk_row, chunk_id FROM doc_chunk WHERE coalesce(ingested_at >= {_EDGE}, true)",
    "store_stats": "SELECT section, count(*) AS chunks, count(*) FILTER (coalesce(has_code, false)) AS code_chunks FROM (SELECT coalesce(section, 'unknown') AS section, has_code FROM doc_chunk) GROUP BY ROLLUP (section)",
    "stream_ingest": "SELECT DISTINCT chunk_id FROM doc_chunk WHERE chunk_id IS NOT NULL",
    "event_counts": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
