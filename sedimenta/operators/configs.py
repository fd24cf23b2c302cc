"""Configurations in YAML: extraction, repair, parsing, validation, dependency checks and rendering.

YAML is read in one Arrow-batched function that returns a typed struct; every
rule after that is a Catalyst expression over it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.actions import ACTIONS, CHECKS, DESTRUCTIVE, ON_FAILURE, PARAMETERS, RISKS
from ..functions.text import drop_fence_lines, strip_fence
from ..plans.staging import spread, staged

_Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
SCHEMA_KEYS = ("metadata:", "steps:", "error:", "version:", "validation:", "rollback:")

STEP = "struct<id:string,action:string,description:string,params:map<string,string>,depends_on:array<string>,on_failure:string,timeout_seconds:string,retry_count:string>"
CHECK = "struct<type:string,target:string,namespace:string,label_selector:string,expected_count:string,service_name:string>"
CONFIG = (
    "parsed boolean, mapping boolean, version string, description string, risk_level string, tags array<string>, "
    f"steps array<{STEP}>, pre_checks array<{CHECK}>, post_checks array<{CHECK}>, rollback_steps array<{STEP}>, is_error boolean, error_reason string, "
    "error_suggestion string, target_cluster string, estimated_duration string"
)


def load(text: str | None):
    """(parsed, value): any failure of the parser, also on impossible dates, counts as unparsable."""
    try:
        return True, yaml.load(text or "", Loader=_Loader)
    except (yaml.YAMLError, ValueError, TypeError, AttributeError, RecursionError, OverflowError):
        return False, None


def _scalar(x) -> str | None:
    if x is None:
        return None
    if isinstance(x, bool):
        return "true" if x else "false"
    return json.dumps(x, default=str, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x)


def _step(x) -> dict:
    x = x if isinstance(x, dict) else {}
    params, deps = x.get("params"), x.get("depends_on")
    return {
        "id": _scalar(x.get("id")), "action": _scalar(x.get("action")), "description": _scalar(x.get("description")),
        "params": list({str(k): _scalar(v) for k, v in params.items()}.items()) if isinstance(params, dict) else [],
        "depends_on": [_scalar(d) for d in deps] if isinstance(deps, list) else [],
        "on_failure": _scalar(x.get("on_failure")), "timeout_seconds": _scalar(x.get("timeout_seconds")), "retry_count": _scalar(x.get("retry_count")),
    }


def _check(x) -> dict:
    x = x if isinstance(x, dict) else {}
    return {k: _scalar(x.get(k)) for k in ("type", "target", "namespace", "label_selector", "expected_count", "service_name")}


def flatten(text: str | None) -> dict:
    """One configuration as a flat record of CONFIG."""
    ok, data = load(text)
    out = {k: None for k in ("parsed", "mapping", "version", "description", "risk_level", "tags", "steps", "pre_checks", "post_checks", "rollback_steps", "is_error", "error_reason", "error_suggestion", "target_cluster", "estimated_duration")}
    out |= {"parsed": ok, "mapping": isinstance(data, dict), "is_error": False}
    if isinstance(data, dict):
        part = lambda k: data.get(k) if isinstance(data.get(k), dict) else {}
        listed = lambda v: v if isinstance(v, list) else []
        meta, checks = part("metadata"), part("validation")
        out |= {
            "version": _scalar(data.get("version")), "description": _scalar(meta.get("description")), "risk_level": _scalar(meta.get("risk_level")),
            "tags": [_scalar(t) for t in listed(meta.get("tags"))],
            "steps": [_step(s) for s in listed(data.get("steps"))], "rollback_steps": [_step(s) for s in listed(part("rollback").get("steps"))],
            "pre_checks": [_check(c) for c in listed(checks.get("pre_checks"))], "post_checks": [_check(c) for c in listed(checks.get("post_checks"))],
            "is_error": isinstance(data.get("error"), dict), "error_reason": _scalar(part("error").get("reason")), "error_suggestion": _scalar(part("error").get("suggestion")),
            "target_cluster": _scalar(meta.get("target_cluster")), "estimated_duration": _scalar(meta.get("estimated_duration")),
        }
    return out


def parse_configs(rows: DataFrame, key: str = "row_id", text: str = "output", flavour: Column | None = None) -> DataFrame:
    """key and the columns of CONFIG; fences are stripped first.  Null text parses as an empty document, no mapping."""
    schema = _parse_datatype_string(f"{key} {dict(rows.dtypes)[key]}, {CONFIG}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            out = [{key: k, **flatten(t)} for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return spread(rows.select(key, (flavour if flavour is not None else strip_fence(F.col(text))).alias("_t"))).mapInArrow(run, schema)


def yaml_parseable(rows: DataFrame, key: str = "row_id", text: str = "output") -> DataFrame:
    return parse_configs(rows, key, text, drop_fence_lines(F.col(text))).select(key, "parsed")


def extract_yaml(c: Column) -> Column:
    """The YAML part of an answer: first filled fenced part (without a language line), from the first line that
    begins with a schema key, up to a further fence or a document mark."""
    t = F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))
    parts = F.split(t, "```")
    inner = F.transform(F.filter(F.transform(parts, lambda p, i: F.when(i % 2 == 1, p)), lambda p: p.isNotNull()), lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\s+|\s+$", ""), r"^\p{L}+[ \t]*(\n|$)", ""), r"^\s+|\s+$", ""))
    first = F.get(F.filter(inner, lambda p: p != ""), F.lit(0))
    body = F.when(t.contains("```"), F.coalesce(first, t)).otherwise(t)
    keys = "|".join(k.rstrip(":") for k in SCHEMA_KEYS)
    begun = F.regexp_extract(body, rf"(?s)(?:^|\n)([ \t]*(?:{keys}):.*)$", 1)
    body = F.when(begun != "", begun).otherwise(body)
    body = F.substring_index(body, "```", 1)
    return F.regexp_replace(F.regexp_replace(body, r"(?s)(^|\n)[ \t]*---[ \t]*(\n.*)?$", ""), r"^\s+|\s+$", "")


def patch_yaml(text: str | None, request: str | None) -> str | None:
    """Fills a missing metadata description from the request and missing step descriptions from action and name."""
    ok, data = load(text)
    if not ok or not isinstance(data, dict):
        return text
    short, changed = (request or "")[:100], False
    meta = data.get("metadata", ...)
    if isinstance(meta, dict):
        if "description" not in meta:
            meta["description"], changed = short, True
    elif meta is None or isinstance(meta, str) or (meta is ... and "steps" in data):
        data["metadata"], changed = {"description": (meta if isinstance(meta, str) else "") or short}, True
    for s in data["steps"] if isinstance(data.get("steps"), list) else []:
        if isinstance(s, dict) and "description" not in s:
            named = s["params"].get("name", "") if isinstance(s.get("params"), dict) else ""
            s["description"], changed = f"{s.get('action', 'execute step')} {named}".strip(), True
    return yaml.dump(data, default_flow_style=False, sort_keys=False, allow_unicode=True) if changed else text


def patched(text: Column, request: Column) -> Column:
    """patch_yaml over columns, in Arrow batches."""

    @F.pandas_udf("string")
    def patch(t: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([patch_yaml(x, y) for x, y in zip(t, r)])

    return patch(text, request)


def registry(spark: SparkSession) -> DataFrame:
    """The parameter registry as a table of fixed size."""
    rows = [(a, p, t, r, None if lo is None else float(lo), None if hi is None else float(hi), rx) for a, p, t, r, lo, hi, rx in PARAMETERS]
    return spark.createDataFrame(rows, "action string, param string, type string, required boolean, least double, most double, pattern string")


def param_errors(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps(keys..., action, params map) -> (keys..., param, problem): missing, type, range or pattern, table-driven.

    Parameters that the registry doesn't know are ignored, as are unknown actions.
    """
    rules = F.broadcast(registry(steps.sparkSession))
    joined = steps.join(rules, "action").withColumn("value", F.try_element_at("params", F.col("param")))
    v, n = F.col("value"), F.expr("try_cast(value AS double)")
    typed = (
        F.when(F.col("type") == "int", n.isNotNull() & (n == F.floor(n)))
        .when(F.col("type") == "float", n.isNotNull())
        .when(F.col("type") == "bool", F.lower(v).isin("true", "false", "yes", "no", "on", "off", "1", "0"))
        .when(F.col("type") == "map", v.startswith("{"))
        .otherwise(~v.startswith("{") & ~v.startswith("["))
    )
    problem = (
        F.when(v.isNull() & F.col("required"), "missing")
        .when(v.isNotNull() & ~F.coalesce(typed, F.lit(False)), "type")
        .when(v.isNotNull() & ((n < F.col("least")) | (n > F.col("most"))), "range")
        .when(v.isNotNull() & F.col("pattern").isNotNull() & ~F.expr("rlike(value, pattern)"), "pattern")
    )
    return joined.select(*keys, "param", problem.alias("problem")).filter("problem is not null")


def structure_errors() -> Column:
    """array<string> of broken rules of a parsed configuration (columns of CONFIG)."""
    c = F.col
    steps = F.coalesce(c("steps"), F.array().cast(f"array<{STEP}>"))
    ids = F.transform(steps, lambda s: s["id"])
    bad = lambda cond, text: F.when(cond, F.lit(text))
    short = lambda x: F.coalesce(F.length(x), F.lit(0)) < 10
    number = lambda x: F.try_to_number(x, F.lit("9999999")).cast("int")
    rules = F.array(
        bad(~c("parsed"), "unparsable"),
        bad(c("parsed") & ~c("mapping"), "not a mapping"),
        bad(c("mapping") & c("version").isNotNull() & ~c("version").rlike(r"^\d+\.\d+$"), "version"),
        bad(c("mapping") & short(c("description")), "metadata description"),
        bad(c("mapping") & c("risk_level").isNotNull() & ~c("risk_level").isin(RISKS), "risk level"),
        bad(c("mapping") & (F.size(steps) == 0) & ~c("is_error"), "neither steps nor error"),
        bad(F.exists(steps, lambda s: ~F.coalesce(s["id"].rlike(r"^step_\d{2,3}$"), F.lit(False))), "step id"),
        bad(F.exists(steps, lambda s: ~F.coalesce(s["action"].isin(ACTIONS), F.lit(False))), "unknown action"),
        bad(F.exists(steps, lambda s: short(s["description"])), "step description"),
        bad(F.exists(steps, lambda s: s["on_failure"].isNotNull() & ~s["on_failure"].isin(ON_FAILURE)), "failure strategy"),
        bad(F.exists(steps, lambda s: s["timeout_seconds"].isNotNull() & ~F.coalesce(number(s["timeout_seconds"]).between(1, 3600), F.lit(False))), "timeout"),
        bad(F.exists(steps, lambda s: s["retry_count"].isNotNull() & ~F.coalesce(number(s["retry_count"]).between(0, 5), F.lit(False))), "retries"),
        bad(F.exists(F.concat(F.coalesce(c("pre_checks"), F.array().cast(f"array<{CHECK}>")), F.coalesce(c("post_checks"), F.array().cast(f"array<{CHECK}>"))), lambda t: ~F.coalesce(t["type"].isin(CHECKS), F.lit(False))), "check type"),
        bad(F.exists(steps, lambda s: F.size(F.array_except(s["depends_on"], ids)) > 0), "missing dependency"),
        bad(F.exists(steps, lambda s: F.array_contains(s["depends_on"], s["id"])), "self dependency"),
        bad(has_cycle(steps), "cycle"),
    )
    return F.filter(rules, lambda x: x.isNotNull())


def has_cycle(steps: Column) -> Column:
    """Whether the dependencies of a configuration's steps close a circle, by peeling: steps whose open dependencies are done are taken away, as often as there are steps."""
    ids = F.transform(steps, lambda s: s["id"])
    edges = F.transform(steps, lambda s: F.struct(s["id"].alias("id"), F.array_intersect(F.coalesce(s["depends_on"], F.array().cast("array<string>")), ids).alias("deps")))

    def peel(left: Column, _: Column) -> Column:
        open_ids = F.transform(left, lambda e: e["id"])
        return F.filter(left, lambda e: F.size(F.array_intersect(e["deps"], open_ids)) > 0)

    rest = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(steps), F.lit(1))), edges, peel)
    return F.coalesce((F.size(steps) > 0) & (F.size(rest) > 0), F.lit(False))


def warnings() -> Column:
    c, steps = F.col, F.coalesce(F.col("steps"), F.array().cast(f"array<{STEP}>"))
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) < 1
    risky = F.exists(steps, lambda s: s["action"].isin(DESTRUCTIVE)) & ~F.coalesce(c("risk_level"), F.lit("low")).isin("high", "critical")
    return F.filter(F.array(F.when((F.size(steps) > 1) & empty(c("rollback_steps")), "no rollback"), F.when(empty(c("pre_checks")), "no pre-checks"), F.when(risky, "destructive at low risk")), lambda x: x.isNotNull())


def validate(rows: DataFrame, key: str = "row_id", text: str = "output") -> DataFrame:
    """key, is_valid, errors, warnings, n_steps: an error configuration that is well formed is valid at once."""
    parsed = staged(parse_configs(rows, key, text).withColumn("errors", structure_errors()).withColumn("warnings", warnings()), "configs")
    steps = parsed.filter((F.size("errors") == 0) & ~F.col("is_error")).select(key, F.explode("steps").alias("s")).select(key, F.col("s.id").alias("id"), F.col("s.action").alias("action"), F.col("s.params").alias("params"))
    wrong = param_errors(steps, [key, "id"]).groupBy(key).agg(F.array_sort(F.collect_set(F.concat_ws(" ", "id", "param", "problem"))).alias("param_errors"))
    out = parsed.join(wrong, key, "left")
    errors = F.concat("errors", F.coalesce("param_errors", F.array().cast("array<string>")))
    return out.select(key, (F.size(errors) == 0).alias("is_valid"), errors.alias("errors"), "warnings", F.coalesce(F.size("steps"), F.lit(0)).alias("n_steps"))


def first_valid_attempts(attempts: DataFrame, request: str = "request_id", attempt: str = "attempt", valid: str = "is_valid") -> DataFrame:
    """request, the first valid attempt (null if none), attempts used, success."""
    first = F.min(F.when(F.col(valid), F.col(attempt)))
    return attempts.groupBy(request).agg(first.alias("first_valid"), F.coalesce(first, F.max(attempt)).alias("attempts_used"), first.isNotNull().alias("success"))


def missing_dependencies(steps: DataFrame, key: str, step: str = "step_id", deps: str = "depends_on") -> DataFrame:
    """steps(key, step, deps array) -> (key, step, dep): dependencies on no step of the same configuration, and on the step itself."""
    edges = steps.select(key, step, F.explode(deps).alias("dep"))
    known = steps.select(key, F.col(step).alias("dep")).distinct()
    return edges.join(known, [key, "dep"], "left_anti").select(key, step, "dep").unionByName(edges.filter(F.col(step) == F.col("dep")))


def _plain(data):
    """A parsed document without null values, keys in order."""
    if isinstance(data, dict):
        return {str(k): _plain(v) for k, v in data.items() if v is not None}
    return [_plain(v) for v in data] if isinstance(data, list) else data


def to_yaml(text: str | None) -> str | None:
    """A configuration (YAML or JSON text) written anew: nulls dropped, order kept; null where it isn't a mapping."""
    ok, data = load(text)
    return yaml.dump(_plain(data), default_flow_style=False, sort_keys=False, allow_unicode=True) if ok and isinstance(data, dict) else None


def as_yaml(text: Column) -> Column:
    """to_yaml over a column, in Arrow batches."""

    @F.pandas_udf("string")
    def write(t: pd.Series) -> pd.Series:
        return pd.Series([to_yaml(x) for x in t], dtype="object")

    return write(text)


def normalize_outputs(rows: DataFrame, key: str, payload: str) -> DataFrame:
    """key, instruction, output of JSON objects with both fields: an output that is an object becomes YAML, other kinds but text are dropped."""
    doc = rows.select(key, F.try_parse_json(payload).alias("v"))
    part = doc.select(key, F.expr("try_variant_get(v, '$.instruction', 'string')").alias("instruction"), F.expr("try_variant_get(v, '$.output')").alias("o"))
    kind = F.schema_of_variant("o")
    text = F.when(kind == "STRING", F.expr("try_variant_get(o, '$', 'string')")).when(kind.startswith("OBJECT"), as_yaml(F.to_json("o")))
    return part.filter(F.col("instruction").isNotNull() & F.col("o").isNotNull()).select(key, "instruction", text.alias("output")).filter("output is not null")


def schema_filter(rows: DataFrame, key: str = "row_id", instruction: str = "instruction", text: str = "output") -> tuple[DataFrame, DataFrame]:
    """(kept, rejects): rows whose output is a valid configuration, and key, instruction[:80], error[:200] of the others."""
    judged = staged(validate(rows, key, text).select(key, "is_valid", "errors"), "judged")
    kept = rows.join(judged.filter("is_valid").select(key), key, "left_semi")
    bad = rows.select(key, instruction).join(judged.filter("not is_valid"), key)
    said = F.array_join(F.transform("errors", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")
    return kept, bad.select(key, F.substring(F.coalesce(F.col(instruction), F.lit("")), 1, 80).alias("instruction"), F.substring(said, 1, 200).alias("error"))


def schema_eval(rows: DataFrame, key: str = "row_id", text: str = "output") -> DataFrame:
    """key, yaml_ok, schema_ok, n_errors: both flags of each row, each found on its own."""
    parsed = yaml_parseable(rows, key, text).withColumnRenamed("parsed", "yaml_ok")
    return parsed.join(validate(rows, key, text).select(key, F.col("is_valid").alias("schema_ok"), F.size("errors").alias("n_errors")), key)
