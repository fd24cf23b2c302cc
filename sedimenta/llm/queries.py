"""Named queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship, table
from .cross_split import cross_split_overlaps, overlap_pairs, overlap_report
from .defects import defect_labels, defect_posteriors, single_defects
from .history import removed_per_batch, replay
from .leakage import leaked_items
from .mixing import mix_sources
from .near_duplicates import group_pairs, near_duplicate_groups
from .page_frame import frame_of_pages, main_bodies
from .repeated_lines import frequent_sequences, repeated_line_places, without_repeated_lines
from .shared_spans import shared_share, shared_spans, span_pairs
from .splitting import page_and_chunk_items, split_oversized


def _prepared(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_pairs(near_duplicate_groups(table(spark, sf_dir, "eval_raw")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "eval_raw")).select("row_id", "group_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return single_defects(defect_posteriors(table(spark, sf_dir, "eval_raw")))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defect_labels(defect_posteriors(table(spark, sf_dir, "eval_raw")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_of_pages(table(spark, sf_dir, "scraped_page")).filter("frame").select("page_id", "line_no")


def p3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_bodies(table(spark, sf_dir, "scraped_page"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_line_places(table(spark, sf_dir, "scraped_page"))


def p4_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_sequences(table(spark, sf_dir, "scraped_page"))[0]


def p4_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(table(spark, sf_dir, "scraped_page"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_pairs(*cross_split_overlaps(table(spark, sf_dir, "eval_raw")))


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "eval_raw"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(page_and_chunk_items(table(spark, sf_dir, "scraped_page"), table(spark, sf_dir, "doc_chunk")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).select("kind", "item_id").distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay(table(spark, sf_dir, "eval_raw"), table(spark, sf_dir, "generation_stats")).select("batch_id", "row_id")


def p7_removed_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_per_batch(table(spark, sf_dir, "eval_raw"), table(spark, sf_dir, "generation_stats"))


def p7_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows with their kind and the share of their words in paragraphs of earlier deliveries."""
    return replay(table(spark, sf_dir, "eval_raw"), table(spark, sf_dir, "generation_stats"), covered=True).select("row_id", "kind", "coverage")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_prompt"))
    return found.select("doc_id", "item_id").distinct()


def p8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_prompt"))


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[0].select("doc_id", "source", "tokens", "copies")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"))[1]


def p9_shares_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter more tokens than the listed sources have: the exponent is bisected to keep to the repeats."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), budget_share=1.25)[1]


def p9_shares_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural shares flattened to nine tenths of the highest entropy."""
    return mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_target"), entropy_share=0.9)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_pairs(*shared_spans(table(spark, sf_dir, "documents")))


def p10_shared_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_share(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_labels": p2_labels,
    "p3_found": p3_found,
    "p3_bodies": p3_bodies,
    "p4_found": p4_found,
    "p4_patterns": p4_patterns,
    "p4_cleaned": p4_cleaned,
    "p5_found": p5_found,
    "p5_report": p5_report,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_found": p7_found,
    "p7_removed_per_batch": p7_removed_per_batch,
    "p7_coverage": p7_coverage,
    "p8_found": p8_found,
    "p8_passages": p8_passages,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p9_shares_budget": p9_shares_budget,
    "p9_shares_entropy": p9_shares_entropy,
    "p10_found": p10_found,
    "p10_shared_share": p10_shared_share,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _prepared(f) for k, f in QUERIES.items()}


# Exact definitions in SQL, by counting common triples of all pairs, comparing all windows, and so on:
# right on whole tables of the small scales, where they serve as a second opinion.
_WORDS = r"list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_PAIR = "coalesce(instruction, '') || ' ' || coalesce(output, '')"
_GRAMS = f"""w AS (SELECT row_id, lower(trim(split)) AS split, {_WORDS.format(_PAIR)} AS w FROM eval_raw),
  g AS (SELECT DISTINCT row_id, split, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
  n AS (SELECT row_id, count(*) AS n FROM g GROUP BY row_id)"""
_ALIKE = """c AS (SELECT x.row_id AS a, y.row_id AS b, count(*) AS o FROM g x JOIN g y ON x.g = y.g WHERE {0} GROUP BY 1, 2),
  e AS (SELECT a, b FROM c JOIN n p ON p.row_id = a JOIN n q ON q.row_id = b WHERE 10 * o >= 7 * (p.n + q.n - o))"""
_LINE = r"regexp_replace(lower(regexp_replace(regexp_replace(line, '[ \t\x{00A0}]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), '[0-9]+', '0', 'g')"
_CODE = "(length(content) - length(regexp_replace(content, '(?s)```.*?```', '', 'g')))"
# rows in order of arrival; of those with alike rows one after the other is accepted or lost
_REPLAY = f"""{_GRAMS}, {_ALIKE.format("x.row_id < y.row_id")},
  o AS MATERIALIZED (SELECT row_id, e.batch_id, row_number() OVER (ORDER BY coalesce(batch_seq, 9223372036854775807), row_id) AS k FROM eval_raw e LEFT JOIN generation_stats USING (batch_id)),
  l AS (SELECT greatest(x.k, y.k) AS k, list(least(x.k, y.k)) AS before FROM e JOIN o x ON x.row_id = e.a JOIN o y ON y.row_id = e.b GROUP BY 1),
  q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) AS i FROM l),
  z AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS lost UNION ALL SELECT q.i, CASE WHEN len(list_filter(q.before, lambda b: NOT list_contains(z.lost, b))) > 0 THEN list_append(z.lost, q.k) ELSE z.lost END FROM z JOIN q ON q.i = z.i + 1),
  gone AS MATERIALIZED (SELECT batch_id, row_id FROM o WHERE k IN (SELECT unnest(lost) FROM z WHERE i = (SELECT max(i) FROM z)))"""
SQL: dict[str, str] = {
    "p1_found": f"""WITH RECURSIVE {_GRAMS}, {_ALIKE.format("x.row_id < y.row_id")}, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
      r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b)
      SELECT a AS row_id_a, b AS row_id_b FROM r WHERE a < b""",
    "p4_found": f"""WITH l AS (SELECT page_id, section, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(0, len(string_split(content, chr(10))) - 1)) AS line_no FROM scraped_page WHERE content IS NOT NULL AND section IS NOT NULL),
      k AS (SELECT page_id, section, CAST(line_no AS INT) AS line_no, {_LINE} AS key FROM l),
      s AS (SELECT section, count(DISTINCT page_id) AS pages FROM scraped_page GROUP BY section),
      f AS (SELECT section, key FROM k JOIN s USING (section) WHERE length(key) >= 12 GROUP BY section, key, pages HAVING count(DISTINCT page_id) >= greatest(3, 0.05 * pages))
      SELECT page_id, line_no FROM k JOIN f USING (section, key)""",
    "p1_groups": f"""WITH RECURSIVE {_GRAMS}, {_ALIKE.format("x.row_id < y.row_id")}, s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
      r AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON s.a = r.b)
      SELECT row_id, least(row_id, coalesce((SELECT min(b) FROM r WHERE a = row_id), row_id)) AS group_id FROM eval_raw""",
    "p4_cleaned": f"""WITH l AS (SELECT page_id, section, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(0, len(string_split(content, chr(10))) - 1)) AS line_no FROM scraped_page WHERE content IS NOT NULL),
      k AS (SELECT page_id, section, line, line_no, {_LINE} AS key FROM l),
      s AS (SELECT section, count(DISTINCT page_id) AS pages FROM scraped_page GROUP BY section),
      f AS (SELECT section, key, true AS gone FROM k JOIN s USING (section) WHERE length(key) >= 12 GROUP BY section, key, pages HAVING count(DISTINCT page_id) >= greatest(3, 0.05 * pages)),
      c AS (SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (gone IS NULL), '') AS content, CAST(count(gone) AS INT) AS lines_removed FROM k LEFT JOIN f USING (section, key) GROUP BY page_id)
      SELECT page_id, c.content, coalesce(lines_removed, 0) AS lines_removed FROM scraped_page LEFT JOIN c USING (page_id)""",
    "p5_found": f"""WITH {_GRAMS}, {_ALIKE.format("x.split = 'train' AND y.split IN ('eval', 'test')")}
      SELECT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM e""",
    "p6_found": f"""SELECT kind, id AS item_id FROM (SELECT 'page' AS kind, page_id AS id, content FROM scraped_page UNION ALL SELECT 'chunk', chunk_row, content FROM doc_chunk)
      WHERE trunc((length(content) - {_CODE}) / 4.0::DOUBLE + {_CODE} / 3.2::DOUBLE) > 1000""",
    "p7_found": f"""WITH RECURSIVE {_REPLAY} SELECT batch_id, row_id FROM gone""",
    "p7_removed_per_batch": f"""WITH RECURSIVE {_REPLAY} SELECT batch_id, batch_seq, duplicates_removed AS reported, (SELECT count(*) FROM gone g WHERE g.batch_id = b.batch_id) AS duplicates_removed FROM generation_stats b""",
    "p8_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format("prompt")} AS w FROM eval_prompt),
      x AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 9), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
      y AS (SELECT item_id, unnest(list_transform(generate_series(1, len(w) - 9), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) >= 10)
      SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)""",
    "p10_found": """WITH w AS (SELECT DISTINCT doc_id, hash(unnest(list_transform(generate_series(1, length(text) - 299), lambda k: substr(text, k, 300)))) AS h FROM documents WHERE length(text) >= 300),
      r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1), s AS (SELECT doc_id, h FROM w SEMI JOIN r USING (h))
      SELECT DISTINCT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id""",
    "p10_shared_share": """WITH w AS (SELECT doc_id, unnest(generate_series(1, length(text) - 299)) AS k, unnest(list_transform(generate_series(1, length(text) - 299), lambda k: hash(substr(text, k, 300)))) AS h FROM documents WHERE length(text) >= 300),
      r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id)), c AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM w SEMI JOIN r USING (h)),
      s AS (SELECT doc_id, CAST(sum(CASE WHEN k - p < 300 THEN k - p ELSE 300 END) AS INT) AS shared FROM c GROUP BY doc_id)
      SELECT doc_id, CAST(length(coalesce(text, '')) AS INT) AS n_chars, coalesce(shared, 0) AS shared_chars, round(coalesce(shared, 0) / greatest(length(coalesce(text, '')), 1), 6) AS shared_share FROM documents LEFT JOIN s USING (doc_id)""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
