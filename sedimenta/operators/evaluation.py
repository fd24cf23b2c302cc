"""Rates, averages, winners and reports over evaluation results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bar, error_key


def rate(flag: Column) -> Column:
    """Share of true rows, nulls counting as false; 0 over no rows."""
    return F.sum(F.coalesce(flag, F.lit(False)).cast("int")) / F.greatest(F.count(F.lit(1)), F.lit(1))


def pass_rates(results: DataFrame, groups: list[str], passed: str = "passed") -> DataFrame:
    """dimension, value, total, passed, pass_rate: by each of the columns and over all rows ('all'), in one pass."""
    sets = ", ".join(f"({g})" for g in groups)
    cols = ", ".join(groups)
    named = "CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in groups) + " ELSE 'all' END"
    value = "CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN coalesce({g}, 'unknown')" for g in groups) + " END"
    return results.sparkSession.sql(
        f"SELECT {named} AS dimension, {value} AS value, count(*) AS total, count_if({passed}) AS passed, round(count_if({passed}) / greatest(count(*), 1), 6) AS pass_rate "
        f"FROM {{r}} GROUP BY {cols} GROUPING SETS ({sets}, ())",
        r=results,
    )


def cross_run(results: DataFrame, run: str, category: str, passed: str = "passed") -> DataFrame:
    """category (null: overall), runs, mean, least and most pass rate over runs, each run weighing the same."""
    per = results.rollup(run, category).agg(rate(F.col(passed)).alias("rate"), F.grouping(run).alias("g1"), F.grouping(category).alias("g2")).filter("g1 = 0")
    label = F.when(F.col("g2") == 1, "(overall)").otherwise(F.coalesce(category, F.lit("unknown")))
    return per.groupBy(label.alias("category")).agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.round(F.min("rate"), 6).alias("min_rate"), F.round(F.max("rate"), 6).alias("max_rate")
    )


def compliance(results: DataFrame, parsed: str = "yaml_ok", valid: str = "schema_ok") -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total"), F.round(rate(F.col(parsed)), 6).alias("yaml_rate"), F.round(rate(F.col(valid)), 6).alias("schema_rate"))


def top_errors(errors: DataFrame, text: str = "error", order: str = "ord", k: int = 5) -> DataFrame:
    """The k most frequent kinds of error, ties by first appearance."""
    return errors.groupBy(error_key(F.col(text)).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen", "kind").limit(k).select("kind", "n")


def judge_means(scores: DataFrame, model: str, dimension: str, score: str) -> DataFrame:
    return scores.groupBy(model, dimension).agg(F.round(F.avg(score), 6).alias("avg_score"), F.count(F.lit(1)).alias("n"))


def mean_of_means(scores: DataFrame, model: str, dimension: str, score: str) -> DataFrame:
    """Per model the mean over dimensions of each dimension's mean."""
    per = scores.groupBy(model, dimension).agg(F.avg(score).alias("m"))
    return per.groupBy(model).agg(F.round(F.avg("m"), 6).alias("overall"), F.count(F.lit(1)).alias("dimensions"))


def judge_rows(answers: DataFrame, key: str, answer: str, dimensions: list[str]) -> DataFrame:
    """key, dimension, score, reasoning from a judge's JSON: a row per dimension, missing ones with score 0."""
    parsed = F.from_json(answer, "map<string, struct<score:int, reasoning:string>>")
    each = F.explode(F.array(*[F.lit(d) for d in dimensions]))
    rows = answers.select(key, parsed.alias("_p"), each.alias("dimension"))
    got = F.try_element_at("_p", F.col("dimension"))
    return rows.select(key, "dimension", F.coalesce(got["score"], F.lit(0)).alias("score"), F.coalesce(got["reasoning"], F.lit("No reasoning provided")).alias("reasoning"))


def winner(overall: DataFrame, groups: list[str], model: str, score: str, order: str) -> DataFrame:
    """The best model of each group; of equals the first in ``order``."""
    best = F.max_by(model, F.struct(F.col(score), (-F.col(order)).alias("o")))
    return overall.groupBy(*groups).agg(best.alias("winner")) if groups else overall.agg(best.alias("winner"))


def quality_score(valid: Column, *flags: Column) -> Column:
    """Number of true flags, 0 for an invalid result."""
    total = sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))
    return F.when(F.coalesce(valid, F.lit(False)), total + 1).otherwise(0)


def head_to_head(a_name: Column, a_score: Column, a_seconds: Column, b_name: Column, b_score: Column, b_seconds: Column) -> Column:
    """The better of two; at equal scores the faster, marked so; else a tie."""
    return (
        F.when(a_score > b_score, a_name).when(b_score > a_score, b_name)
        .when(a_seconds < b_seconds, F.concat(a_name, F.lit(" (faster)"))).when(b_seconds < a_seconds, F.concat(b_name, F.lit(" (faster)"))).otherwise("tie")
    )


#: Metrics of a backend's result, in the order of the table; of the last two less is better.
METRICS = ("quality", "schema_valid", "steps", "rollback", "pre_checks", "post_checks", "attempts", "seconds")
LESS_IS_BETTER = ("attempts", "seconds")


def backend_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """keys and METRICS of results(keys, success, attempts, seconds, n_steps, n_rollback, n_pre, n_post); a failed result scores nothing but its attempts and time."""
    ok = F.coalesce(F.col("success"), F.lit(False))
    some = lambda c: ok & (F.coalesce(F.col(c), F.lit(0)) > 0)
    flags = [ok.alias("schema_valid"), F.when(ok, F.coalesce("n_steps", F.lit(0))).otherwise(0).alias("steps"), some("n_rollback").alias("rollback"), some("n_pre").alias("pre_checks"), some("n_post").alias("post_checks")]
    quality = F.when(ok, sum((some(c).cast("int") for c in ("n_steps", "n_rollback", "n_pre", "n_post")), F.lit(1))).otherwise(0)
    return results.select(*keys, quality.alias("quality"), *flags, "attempts", "seconds")


def evaluate_prompts(answers: DataFrame, key: str = "item_id") -> DataFrame:
    """Judged answers(key, category, difficulty, expected_actions, expect_error, output, is_valid, actions, is_error, error) -> a result row each.

    Passed: valid, and the actions as expected (some, unless an error is).
    A request that raised counts as failed; error and output are cut to 200 and
    500 characters.
    """
    n = F.size(F.coalesce("actions", F.array().cast("array<string>")))
    right = actions_covered(F.col("expected_actions"), F.col("actions"), F.col("expect_error"), F.col("is_error"))
    wants_error = F.coalesce("expect_error", F.lit(False))
    passed = F.coalesce("is_valid", F.lit(False)) & right & (wants_error | (n > 0))
    text = lambda c, k: F.substring(F.coalesce(F.col(c), F.lit("")), 1, k)
    return answers.select(key, "category", "difficulty", passed.alias("passed"), (F.coalesce("output", F.lit("")) != "").alias("has_output"), right.alias("right_actions"), n.alias("n_actions"), text("error", 200).alias("error"), text("output", 500).alias("output"))


def failed_rows(results: DataFrame, key: str, prompt: str, reason: str, passed: str = "passed") -> DataFrame:
    """key, prompt[:50], reason[:80] of what didn't pass."""
    cut = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    return results.filter(~F.coalesce(F.col(passed), F.lit(False))).select(key, F.concat(cut(prompt, 50), F.lit("...")).alias("prompt"), cut(reason, 80).alias("reason"))


def group_report(results: DataFrame, group: str, passed: str = "passed") -> DataFrame:
    """group, bar, passed, total, pass_rate, sorted by name."""
    by = results.groupBy(F.coalesce(group, F.lit("unknown")).alias(group)).agg(F.count_if(F.coalesce(F.col(passed), F.lit(False))).alias("passed"), F.count(F.lit(1)).alias("total"))
    share = F.col("passed") / F.col("total")
    full = F.floor(share * 10).cast("int")
    return by.select(group, F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 10 - full)).alias("bar"), "passed", "total", F.round(share, 6).alias("pass_rate")).orderBy(group)


def row_means(rows: DataFrame, key: str, score: str = "score") -> DataFrame:
    """key, avg_score: a judged row's mean over its dimensions, 0 where there are none."""
    return rows.groupBy(key).agg(F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias("avg_score"))


def evaluate_model(rows: DataFrame, answer, judge, key: str = "row_id", instruction: str = "instruction") -> DataFrame:
    """Asks a callback for every instruction, judges the answers (judge(df, key, column) -> key, yaml_ok, schema_ok) and returns one row of rates."""
    from ..functions.embedders import generate

    made = generate(rows.select(key, instruction), answer, instruction, "generated", pause=0.0)
    return compliance(judge(made, key, "generated"))


def comparison_table(pair: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """pair(key, a_<metric>, b_<metric>) -> key, metric, a, b, better: one row per metric; of attempts and time less is better."""
    parts = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").cast("double").alias("a"), F.col(f"b_{m}").cast("double").alias("b")) for m in metrics])
    rows = pair.select(key, F.explode(parts).alias("x")).select(key, "x.*")
    less = F.col("metric").isin(*LESS_IS_BETTER)
    lead = F.when(less, F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return rows.withColumn("better", F.when(lead > 0, "a").when(lead < 0, "b").otherwise("equal"))


def actions_covered(expected: Column, actual: Column, expect_error: Column, is_error: Column) -> Column:
    """All expected actions among the actual ones; where an error is expected, an error or no action at all."""
    empty = F.array().cast("array<string>")
    return F.when(F.coalesce(expect_error, F.lit(False)), F.coalesce(is_error, F.lit(False)) | (F.size(F.coalesce(actual, empty)) == 0)).otherwise(F.size(F.array_except(F.coalesce(expected, empty), F.coalesce(actual, empty))) == 0)


def with_bars(rates: DataFrame, rate_col: str = "pass_rate") -> DataFrame:
    return rates.withColumn("bar", bar(F.col(rate_col)))
