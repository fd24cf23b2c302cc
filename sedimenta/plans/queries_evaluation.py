"""Queries over evaluation results; flags come from patterns of the outputs, scores from the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import configs as G
from ..operators import evaluation as E
from ..session import table


def _results(s, d):
    out = F.coalesce("output", F.lit(""))
    return table(s, d, "eval_raw").select(
        "row_id", F.lower(F.trim("source")).alias("category"), F.lower(F.trim("split")).alias("difficulty"), F.substring_index("batch_id", "-", 1).alias("run"),
        out.rlike(r"(?m)^version:").alias("yaml_ok"), (out.rlike(r"(?m)^version:") & out.rlike(r"(?m)^steps:")).alias("schema_ok"),
        out.rlike(r"(?m)^rollback:").alias("has_rollback"), out.rlike(r"(?m)^  pre_checks:").alias("has_pre"), out.rlike(r"(?m)^  post_checks:").alias("has_post"), F.length(out).alias("n_chars"),
    ).withColumn("passed", F.col("schema_ok"))


def _scores(s, d):
    return table(s, d, "events").select("event_id", F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("dimension"), F.col("value").alias("score"))


def _errors(s, d):
    rows = table(s, d, "generation_stats").select("batch_seq", F.posexplode("invalid_examples").alias("i", "e"))
    return E.top_errors(rows.select((F.col("batch_seq") * 1000 + F.col("i")).alias("ord"), F.col("e.error").alias("error")))


def _quality(s, d):
    r = _results(s, d)
    return r.select("row_id", E.quality_score(F.col("schema_ok"), F.col("has_rollback"), F.col("has_pre"), F.col("has_post")).alias("quality"))


def _winner(s, d):
    means = _scores(s, d).groupBy("model", "dimension").agg(F.round(F.avg("score"), 6).alias("m"))
    return E.winner(means.withColumn("ord", F.substring("model", 2, 1).cast("int")), ["dimension"], "model", "m", "ord")


def _first_valid(s, d):
    """Rows of one seed as its attempts in order of their ids, each validated in full."""
    rows = table(s, d, "eval_raw").filter("seed_id is not null").select("row_id", "seed_id", "output")
    judged = rows.join(G.validate(rows).select("row_id", "is_valid"), "row_id")
    return G.first_valid_attempts(judged.select(F.col("seed_id").alias("request_id"), F.col("row_id").alias("attempt"), "is_valid"))


QUERIES = {
    "pass_rate_by_group": lambda s, d: E.pass_rates(_results(s, d), ["category", "difficulty"]),
    "cross_run_stats": lambda s, d: E.cross_run(_results(s, d), "run", "category"),
    "compliance_rate": lambda s, d: E.compliance(_results(s, d)),
    "top_errors": _errors,
    "judge_averages": lambda s, d: E.judge_means(_scores(s, d), "model", "dimension", "score"),
    "mean_of_means": lambda s, d: E.mean_of_means(_scores(s, d), "model", "dimension", "score"),
    "winner_overall": _winner,
    "schema_compliance": lambda s, d: E.compliance(G.schema_eval(table(s, d, "eval_raw").select("row_id", "output")), "yaml_ok", "schema_ok"),
    "first_schema_valid": _first_valid,
    "quality_score": _quality,
    "rate_bars": lambda s, d: E.with_bars(E.pass_rates(_results(s, d), ["category"])).select("dimension", "value", "bar"),
}
_R = r"""r AS (SELECT row_id, lower(trim(source)) AS category, lower(trim(split)) AS difficulty, split_part(batch_id, '-', 1) AS run, coalesce(output, '') AS o,
  regexp_matches(coalesce(output, ''), '(?m)^version:') AS yaml_ok, regexp_matches(coalesce(output, ''), '(?m)^version:') AND regexp_matches(coalesce(output, ''), '(?m)^steps:') AS passed,
  regexp_matches(coalesce(output, ''), '(?m)^rollback:') AS rb, regexp_matches(coalesce(output, ''), '(?m)^  pre_checks:') AS pre, regexp_matches(coalesce(output, ''), '(?m)^  post_checks:') AS post FROM eval_raw)"""
_Q = "CASE WHEN passed THEN 1 + rb::INT + pre::INT + post::INT ELSE 0 END"
_S = "s AS (SELECT 'm' || (user_id % 3) AS model, event_type AS dimension, value AS score FROM events)"
_RATE = "count(*) AS total, count(*) FILTER (passed) AS passed, round(count(*) FILTER (passed) / greatest(count(*), 1), 6) AS pass_rate"
SQL = {
    "pass_rate_by_group": f"WITH {_R} SELECT 'category' AS dimension, coalesce(category, 'unknown') AS value, {_RATE} FROM r GROUP BY category UNION ALL SELECT 'difficulty', coalesce(difficulty, 'unknown'), {_RATE} FROM r GROUP BY difficulty UNION ALL SELECT 'all', NULL, {_RATE} FROM r",
    "cross_run_stats": f"""WITH {_R}, p AS (SELECT run, coalesce(category, 'unknown') AS category, avg(passed::INT) AS rate FROM r GROUP BY run, category UNION ALL SELECT run, '(overall)', avg(passed::INT) FROM r GROUP BY run)
      SELECT category, count(*) AS runs, round(avg(rate), 6) AS mean_rate, round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate FROM p GROUP BY category""",
    "compliance_rate": f"WITH {_R} SELECT count(*) AS total, round(avg(yaml_ok::INT), 6) AS yaml_rate, round(avg(passed::INT), 6) AS schema_rate FROM r",
    "top_errors": """WITH e AS (SELECT batch_seq, unnest(invalid_examples) AS x, unnest(generate_series(0, len(invalid_examples) - 1)) AS i FROM generation_stats),
      k AS (SELECT batch_seq * 1000 + i AS ord, CASE WHEN instr(x.error, ']') > 0 THEN split_part(x.error, ']', 1) || ']' ELSE substr(x.error, 1, 80) END AS kind FROM e)
      SELECT kind, count(*) AS n FROM k GROUP BY kind ORDER BY n DESC, min(ord), kind LIMIT 5""",
    "judge_averages": f"WITH {_S} SELECT model, dimension, round(avg(score), 6) AS avg_score, count(*) AS n FROM s GROUP BY ALL",
    "mean_of_means": f"WITH {_S}, m AS (SELECT model, dimension, avg(score) AS m FROM s GROUP BY ALL) SELECT model, round(avg(m), 6) AS overall, count(*) AS dimensions FROM m GROUP BY model",
    "winner_overall": f"WITH {_S}, m AS (SELECT model, dimension, round(avg(score), 6) AS m FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY m DESC, model) AS n FROM m) SELECT dimension, model AS winner FROM k WHERE n = 1",
    "quality_score": f"WITH {_R} SELECT row_id, {_Q} AS quality FROM r",
    "rate_bars": f"WITH {_R} SELECT 'category' AS dimension, coalesce(category, 'unknown') AS value, repeat('█', CAST(trunc(round(count(*) FILTER (passed) / count(*), 6) * 10) AS INT)) AS bar FROM r GROUP BY category UNION ALL SELECT 'all', NULL, repeat('█', CAST(trunc(round(count(*) FILTER (passed) / count(*), 6) * 10) AS INT)) FROM r",
}
