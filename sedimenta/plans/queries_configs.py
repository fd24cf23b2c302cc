"""Queries over configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import configs as G
from ..operators import scripts as R
from ..operators.evaluation import actions_covered
from ..session import table


def _rows(s, d):
    return table(s, d, "eval_raw").select("row_id", "instruction", "output", "seed_id", "batch_id")


def _parsed(s, d):
    return G.parse_configs(_rows(s, d))


def _steps(s, d):
    """Steps as text patterns find them: (row_id, step_id, depends_on), steps section only by its two-blank indent."""
    item = r"(?m)^  - id: *(\S+)"
    parts = F.split(F.col("output"), r"(?m)^  - id: *")
    chunk = F.explode(F.slice(parts, F.lit(2), F.size(parts))).alias("c")
    rows = _rows(s, d).filter(F.col("output").rlike(item)).select("row_id", chunk)
    deps = F.split(F.regexp_extract("c", r"(?m)^    depends_on: *\[([^\]\n]*)\]", 1), r" *, *")
    return rows.select("row_id", F.regexp_extract("c", r"^(\S+)", 1).alias("step_id"), F.filter(deps, lambda x: x != "").alias("depends_on"))


def _actions(s, d):
    return _rows(s, d).filter("output is not null").select("row_id", F.explode(F.regexp_extract_all("output", F.lit(r"(?m)^ *action: *(\S+)"), 1)).alias("action"))


def _covered(s, d):
    found = _rows(s, d).select(F.col("row_id").alias("item_id"), F.regexp_extract_all(F.coalesce("output", F.lit("")), F.lit(r"(?m)^ *action: *(\S+)"), 1).alias("actual"), F.coalesce("output", F.lit("")).rlike(r"(?m)^error:").alias("is_error"))
    prompts = table(s, d, "eval_prompt").select("item_id", "expected_actions", "expect_error")
    return prompts.join(found, "item_id").select("item_id", actions_covered(F.col("expected_actions"), F.col("actual"), F.col("expect_error"), F.col("is_error")).alias("covered"))


def _cycles(s, d):
    steps = _steps(s, d).groupBy("row_id").agg(F.collect_list(F.struct(F.col("step_id").alias("id"), "depends_on")).alias("steps"))
    return steps.select("row_id", G.has_cycle(F.col("steps")).alias("cyclic"))


def _attempts(s, d):
    """Rows of one seed as its attempts in order of their ids; an attempt is valid if it has version, metadata and steps or an error."""
    valid = F.coalesce("output", F.lit("")).rlike(r"(?m)^version:") & F.coalesce("output", F.lit("")).rlike(r"(?m)^(steps|error):")
    rows = _rows(s, d).filter("seed_id is not null").select(F.col("seed_id").alias("request_id"), F.col("row_id").alias("attempt"), valid.alias("is_valid"))
    return G.first_valid_attempts(rows)


def _params(s, d):
    steps = _parsed(s, d).select("row_id", F.explode("steps").alias("x")).select("row_id", F.col("x.id").alias("id"), F.col("x.action").alias("action"), F.col("x.params").alias("params"))
    return G.param_errors(steps, ["row_id", "id"])


def _order_steps(s, d):
    """Order lines as steps of one configuration an order: a line depends on the one before and on one by its part, which may be missing or itself."""
    near, far = F.col("l_linenumber") - 1, F.col("l_linenumber") + F.col("l_partkey") % 4
    deps = F.array(F.concat(F.lit("s"), near.cast("string")), F.concat(F.lit("s"), far.cast("string")))
    return table(s, d, "lineitem").select("l_orderkey", F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("step_id"), deps.alias("depends_on")).distinct()


def _order_cycles(s, d):
    steps = _order_steps(s, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("step_id").alias("id"), "depends_on")).alias("steps"))
    return steps.select("l_orderkey", G.has_cycle(F.col("steps")).alias("cyclic"))


def _order_params(s, d):
    """A step an order, of five actions by turns, with parameters in and out of their ranges."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda x: x.cast("string")
    name = F.concat(F.when(k % 3 == 0, F.lit("Ns#")).otherwise(F.lit("ns-")), text(c))
    params = (
        F.when(k % 5 == 0, F.create_map(F.lit("worker_count"), text(c % 120)))
        .when(k % 5 == 1, F.create_map(F.lit("name"), name))
        .when(k % 5 == 2, F.create_map(F.lit("namespace"), F.lit("a"), F.lit("deployment_name"), F.lit("b"), F.lit("port"), text(k)))
        .when(k % 5 == 3, F.create_map(F.lit("vm_id"), F.when(c % 2 == 0, text(c)).otherwise(F.concat(F.lit("x"), text(c)))))
        .otherwise(F.create_map(F.lit("namespace"), F.lit("a"), F.lit("timeout_seconds"), text(c)))
    )
    action = F.element_at(F.array(*map(F.lit, ("oneke.cluster.scale_nodes", "oneke.namespace.create", "oneke.service.expose", "one.vm.delete", "oneke.app.wait_ready"))), (k % 5 + 1).cast("int"))
    return G.param_errors(table(s, d, "orders").select("o_orderkey", action.alias("action"), params.alias("params")), ["o_orderkey"])


QUERIES = {
    "order_params": _order_params,
    "order_dep_missing": lambda s, d: G.missing_dependencies(_order_steps(s, d), "l_orderkey"),
    "order_dep_cycles": _order_cycles,
    "yaml_parseable": lambda s, d: G.yaml_parseable(_rows(s, d)),
    "config_validate": lambda s, d: G.validate(_rows(s, d)).select("row_id", "is_valid", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "n_steps"),
    "config_extract": lambda s, d: _rows(s, d).filter("output is not null").select("row_id", F.md5(G.extract_yaml(F.col("output"))).alias("yaml")),
    "config_patch": lambda s, d: _rows(s, d).filter("output is not null").select("row_id", F.md5(G.patched(T.strip_fence(F.col("output")), F.col("instruction"))).alias("yaml")),
    "param_constraints": _params,
    "dep_missing": lambda s, d: G.missing_dependencies(_steps(s, d), "row_id"),
    "dep_cycles": _cycles,
    "action_counts": lambda s, d: _actions(s, d).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("row_id").alias("configs")),
    "expected_actions_covered": _covered,
    "first_valid_attempt": _attempts,
    "render_steps": lambda s, d: R.render_steps(_parsed(s, d)),
    "render_scripts": lambda s, d: R.scripts(_parsed(s, d)).select("row_id", F.md5("script").alias("script")),
    "requirement_flags": lambda s, d: R.requirement_flags(_parsed(s, d)),
}
_CHUNKS = r"""c AS (SELECT row_id, unnest(string_split(regexp_replace(output, '(?m)^  - id: *', chr(1), 'g'), chr(1))[2:]) AS c FROM eval_raw WHERE regexp_matches(output, '(?m)^  - id: *\S+')),
  steps AS (SELECT row_id, regexp_extract(c, '^(\S+)', 1) AS step_id, list_filter(regexp_split_to_array(regexp_extract(c, '(?m)^    depends_on: *\[([^\]\n]*)\]', 1), ' *, *'), lambda x: x <> '') AS depends_on FROM c),
  deps AS (SELECT row_id, step_id, unnest(depends_on) AS dep FROM steps)"""
_ACTIONS = r"regexp_extract_all(coalesce(output, ''), '(?m)^ *action: *(\S+)', 1)"
_ORDER = """steps AS (SELECT DISTINCT l_orderkey, 's' || l_linenumber AS step_id, ['s' || (l_linenumber - 1), 's' || (l_linenumber + l_partkey % 4)] AS depends_on FROM lineitem),
  deps AS (SELECT l_orderkey, step_id, unnest(depends_on) AS dep FROM steps)"""
SQL = {
    "order_params": """WITH o AS (SELECT o_orderkey, o_orderkey % 5 AS a, o_custkey AS c, CASE WHEN o_orderkey % 3 = 0 THEN 'Ns#' ELSE 'ns-' END || o_custkey AS name FROM orders)
      SELECT o_orderkey, 'worker_count' AS param, 'range' AS problem FROM o WHERE a = 0 AND c % 120 NOT BETWEEN 1 AND 100
      UNION ALL SELECT o_orderkey, 'name', 'pattern' FROM o WHERE a = 1 AND NOT regexp_matches(name, '^[a-z0-9][a-z0-9\\-]{0,62}$')
      UNION ALL SELECT o_orderkey, 'port', 'range' FROM o WHERE a = 2 AND o_orderkey NOT BETWEEN 1 AND 65535
      UNION ALL SELECT o_orderkey, 'vm_id', 'type' FROM o WHERE a = 3 AND c % 2 <> 0
      UNION ALL SELECT o_orderkey, 'label_selector', 'missing' FROM o WHERE a = 4
      UNION ALL SELECT o_orderkey, 'timeout_seconds', 'range' FROM o WHERE a = 4 AND c NOT BETWEEN 30 AND 1800""",
    "order_dep_missing": f"WITH {_ORDER} SELECT l_orderkey, step_id, dep FROM deps d WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.l_orderkey = d.l_orderkey AND s.step_id = d.dep) UNION ALL SELECT l_orderkey, step_id, dep FROM deps WHERE step_id = dep",
    "order_dep_cycles": f"""WITH RECURSIVE {_ORDER}, e AS (SELECT DISTINCT d.l_orderkey, d.step_id AS a, d.dep AS b FROM deps d JOIN steps s ON s.l_orderkey = d.l_orderkey AND s.step_id = d.dep),
      w AS (SELECT l_orderkey, a, b FROM e UNION SELECT w.l_orderkey, w.a, e.b FROM w JOIN e ON e.l_orderkey = w.l_orderkey AND e.a = w.b)
      SELECT l_orderkey, EXISTS (SELECT 1 FROM w WHERE w.l_orderkey = s.l_orderkey AND w.a = w.b) AS cyclic FROM (SELECT DISTINCT l_orderkey FROM steps) s""",
    "dep_missing": f"WITH {_CHUNKS} SELECT row_id, step_id, dep FROM deps d WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.row_id = d.row_id AND s.step_id = d.dep) UNION ALL SELECT row_id, step_id, dep FROM deps WHERE step_id = dep",
    "dep_cycles": f"""WITH RECURSIVE {_CHUNKS}, e AS (SELECT DISTINCT d.row_id, d.step_id AS a, d.dep AS b FROM deps d JOIN steps s ON s.row_id = d.row_id AND s.step_id = d.dep),
      w AS (SELECT row_id, a, b FROM e UNION SELECT w.row_id, w.a, e.b FROM w JOIN e ON e.row_id = w.row_id AND e.a = w.b)
      SELECT row_id, EXISTS (SELECT 1 FROM w WHERE w.row_id = s.row_id AND w.a = w.b) AS cyclic FROM (SELECT DISTINCT row_id FROM steps) s""",
    "action_counts": f"SELECT action, count(*) AS n, count(DISTINCT row_id) AS configs FROM (SELECT row_id, unnest({_ACTIONS}) AS action FROM eval_raw) GROUP BY action",
    "expected_actions_covered": f"""SELECT item_id, CASE WHEN expect_error THEN regexp_matches(coalesce(output, ''), '(?m)^error:') OR len({_ACTIONS}) = 0
      ELSE len(list_filter(expected_actions, lambda x: NOT list_contains({_ACTIONS}, x))) = 0 END AS covered FROM eval_prompt JOIN eval_raw ON row_id = item_id""",
    "first_valid_attempt": r"""WITH a AS (SELECT seed_id, row_id, regexp_matches(coalesce(output, ''), '(?m)^version:') AND regexp_matches(coalesce(output, ''), '(?m)^(steps|error):') AS ok FROM eval_raw WHERE seed_id IS NOT NULL)
      SELECT seed_id AS request_id, min(row_id) FILTER (ok) AS first_valid, coalesce(min(row_id) FILTER (ok), max(row_id)) AS attempts_used, min(row_id) FILTER (ok) IS NOT NULL AS success FROM a GROUP BY seed_id""",
}
