"""Configurations to runnable scripts: commands of steps, checks, rollback, summaries.

Commands come from the table of templates in ``functions.actions`` and every
value is written as a quoted literal, never pasted into a command line.  All of
it is Catalyst expressions over parsed configurations, one row each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.actions import COMMANDS
from .configs import CHECK, STEP

_EMPTY = "array<string>"
_GROUP = re.compile(r"\[(!?)(\w+)(=true)?: ([^\]]*)\]|(\S+)")
_SLOT = re.compile(r"\{(\w+)(?:\|(\w+))?\}")
_SPECIAL = ("timeout", "repo_name", "values", "manifest", "template", "key", "value")


def literal(c: Column) -> Column:
    """A string as a quoted literal, for JSON and Python alike."""
    text = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def given(params: Column, name: str) -> Column:
    """Whether a parameter is there and not empty, zero or false."""
    v = F.lower(F.try_element_at(params, F.lit(name)))
    return F.coalesce(~v.isin("", "false", "no", "off", "0", "null", "{}"), F.lit(False))


def _required(lines: list[str]) -> list[str]:
    """Parameters without which an action has no command."""
    out: list[str] = []
    for line in lines:
        if line.startswith("if "):
            continue
        plain = re.sub(r"\[(!?)(\w+)(=true)?: ([^\]]*)\]", "", line)
        out += [n for n, d in _SLOT.findall(plain) if not d and n not in _SPECIAL and n not in out]
    return out


def _word(word: str, params: Column, special: dict[str, Column]) -> Column:
    parts, at = [], 0
    for m in _SLOT.finditer(word):
        if m.start() > at:
            parts.append(F.lit(word[at : m.start()]))
        name, default = m.groups()
        value = special[name] if name in special else F.try_element_at(params, F.lit(name))
        parts.append(F.when(given(params, name), value).otherwise(F.lit(default)) if default else value)
        at = m.end()
    if at < len(word):
        parts.append(F.lit(word[at:]))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _arguments(line: str, params: Column, special: dict[str, Column]) -> Column:
    """array<string>: the words of a command, conditional groups resolved."""
    groups = []
    for negated, name, default_on, body, plain in _GROUP.findall(line):
        if plain:
            groups.append(F.array(_word(plain, params, special)))
            continue
        if default_on:
            on = F.try_element_at(params, F.lit(name)).isNull() | given(params, name)
        else:
            on = ~given(params, name) if negated else given(params, name)
        words = [_word(w, params, special) for w in body.split() if w not in ("-f", "{values}")]
        groups.append(F.when(on, F.array(*words) if words else F.array().cast(_EMPTY)).otherwise(F.array().cast(_EMPTY)))
    return F.flatten(F.array(*groups))


def _claim(params: Column) -> Column:
    """The manifest of a volume claim as JSON; fields without value are left out."""
    at = lambda n: F.try_element_at(params, F.lit(n))
    meta = F.struct(at("name").alias("name"), at("namespace").alias("namespace"))
    spec = F.struct(F.array(F.coalesce(at("access_mode"), F.lit("ReadWriteOnce"))).alias("accessModes"), F.struct(F.struct(at("size").alias("storage")).alias("requests")).alias("resources"), at("storage_class").alias("storageClassName"))
    return F.to_json(F.struct(F.lit("v1").alias("apiVersion"), F.lit("PersistentVolumeClaim").alias("kind"), meta.alias("metadata"), spec.alias("spec")))


def _line(line: str, params: Column, timeout: Column) -> Column:
    """array<string>: the script lines of one template."""
    chart = F.try_element_at(params, F.lit("chart"))
    special = {"timeout": timeout, "repo_name": F.substring_index(chart, "/", 1), "template": F.coalesce(F.try_element_at(params, F.lit("template")), F.concat(F.lit('NAME="'), F.try_element_at(params, F.lit("name")), F.lit('"')))}
    if m := re.match(r"each (\w+): (.*)$", line):
        entries = F.map_entries(F.coalesce(F.from_json(F.try_element_at(params, F.lit(m[1])), "map<string,string>"), F.create_map().cast("map<string,string>")))
        return F.transform(entries, lambda e: F.concat(F.lit("run("), F.to_json(_arguments(m[2], params, {**special, "key": e["key"], "value": e["value"]})), F.lit(")")))
    if m := re.match(r"if (\w+): (.*)$", line):
        return F.when(given(params, m[1]) & chart.contains("/"), _line(m[2], params, timeout)).otherwise(F.array().cast(_EMPTY))
    if line.startswith("log "):
        return F.array(F.concat(F.lit("log("), literal(_word(line[4:], params, special)), F.lit(")")))
    if line.startswith("vm "):
        return F.array(F.concat(F.lit("machine("), F.array_join(F.transform(_arguments(line[3:], params, special), literal), ", "), F.lit(")")))
    if "{manifest}" in line:
        return F.array(F.concat(F.lit("run_with_file("), F.to_json(F.array(*[F.lit(w) for w in line.split()[:-1]])), F.lit(", "), literal(_claim(params)), F.lit(', ".json")')))
    plain = F.to_json(_arguments(line, params, special))
    out = F.concat(F.lit("run("), plain, F.lit(")"))
    if "{values}" in line:
        filed = F.concat(F.lit("run_with_file("), F.to_json(F.concat(_arguments(line, params, special), F.array(F.lit("-f")))), F.lit(", "), literal(F.try_element_at(params, F.lit("values"))), F.lit(', ".yaml")'))
        out = F.when(given(params, "values"), filed).otherwise(out)
    return F.array(out)


def render(action: Column, params: Column, timeout: Column | None = None) -> Column:
    """The script lines of a step.

    An action without templates gives a warning line, one that lacks a required
    parameter an error line; both keep the script runnable.
    """
    timeout = F.lit("120") if timeout is None else F.coalesce(timeout, F.lit("120"))
    out = F.concat(F.lit("log("), literal(F.concat(F.lit("no command for "), F.coalesce(action, F.lit("null")))), F.lit(', "WARN")'))
    for a, lines in COMMANDS.items():
        lacking = F.array_compact(F.array(*[F.when(F.try_element_at(params, F.lit(n)).isNull(), F.lit(n)) for n in _required(lines)], F.lit(None).cast("string")))
        failed = F.concat(F.lit("log("), literal(F.concat(F.lit(f"no command for {a}: "), F.array_join(lacking, ", "), F.lit(" missing"))), F.lit(', "ERROR")'))
        code = F.array_join(F.flatten(F.array(*[_line(x, params, timeout) for x in lines])), "\n")
        out = F.when(action == a, F.when(F.size(lacking) > 0, failed).otherwise(code)).otherwise(out)
    return out


def render_steps(parsed: DataFrame, key: str = "row_id") -> DataFrame:
    """key, part (step or rollback), pos, id, action, description, command: every step in list order."""
    none = F.array().cast(f"array<{STEP}>")
    own = lambda c, part: parsed.select(key, F.lit(part).alias("part"), F.posexplode(F.coalesce(c, none)).alias("pos", "s"))
    s = own("steps", "step").unionByName(own("rollback_steps", "rollback"))
    return s.select(key, "part", "pos", F.col("s.id").alias("id"), F.col("s.action").alias("action"), F.col("s.description").alias("description"), render(F.col("s.action"), F.col("s.params"), F.col("s.timeout_seconds")).alias("command"))


def action_summary(steps: Column) -> Column:
    """array<string>: '[action] description' of each step, in order."""
    return F.transform(steps, lambda s: F.concat(F.lit("["), F.coalesce(s["action"], F.lit("")), F.lit("] "), F.coalesce(s["description"], F.lit(""))))


RUNTIME = '''import argparse
import os
import subprocess
import sys
import tempfile
import time

DRY_RUN, KUBECONFIG, MACHINES = False, None, ("http://localhost:2633/RPC2", "")


def log(text, level="INFO"):
    print(time.strftime("%H:%M:%S"), level, text, flush=True)


def run(words, check=True):
    if KUBECONFIG and words[0] in ("kubectl", "helm"):
        words = [words[0], "--kubeconfig", KUBECONFIG, *words[1:]]
    log(" ".join(words), "WOULD RUN" if DRY_RUN else "RUN")
    return subprocess.CompletedProcess(words, 0) if DRY_RUN else subprocess.run(words, check=check)


def run_with_file(words, text, suffix):
    with tempfile.NamedTemporaryFile("w", suffix=suffix, delete=False) as f:
        f.write(text)
    try:
        run([*words, f.name])
    finally:
        os.unlink(f.name)


def machine(what, *args):
    log(f"machine {what} {' '.join(args)}", "WOULD RUN" if DRY_RUN else "RUN")
    if DRY_RUN:
        return
    import pyone

    server = pyone.OneServer(MACHINES[0], session=MACHINES[1])
    if what == "allocate":
        log(f"machine {server.vm.allocate(args[0])} created", "OK")
    elif what == "list":
        for vm in server.vmpool.info(-2, -1, -1, -1).VM:
            log(f"{vm.ID} {vm.NAME} {vm.STATE}")
    else:
        server.vm.action(what, int(args[0]))


def holds(words, good, bad):
    ok = run(words, check=False).returncode == 0
    log(good if ok else bad, "OK" if ok else "ERROR")
    return ok
'''
MAIN = '''

def main():
    global DRY_RUN, KUBECONFIG, MACHINES
    parser = argparse.ArgumentParser(description=DESCRIPTION)
    parser.add_argument("--dry-run", action="store_true", help="show the commands, run none")
    parser.add_argument("--skip-pre-checks", action="store_true")
    parser.add_argument("--kubeconfig")
    parser.add_argument("--endpoint", default=MACHINES[0])
    parser.add_argument("--session", default=MACHINES[1])
    args = parser.parse_args()
    DRY_RUN, KUBECONFIG, MACHINES = args.dry_run, args.kubeconfig, (args.endpoint, args.session)
    log(f"{DESCRIPTION} (risk: {RISK}, cluster: {CLUSTER}, duration: {DURATION})")
    if not args.skip_pre_checks and not run_pre_checks():
        log("pre-checks failed", "ERROR")
        sys.exit(1)
    try:
        for step in STEPS:
            step()
    except Exception as e:
        log(f"failed: {e}", "ERROR")
        run_rollback()
        sys.exit(1)
    if not run_post_checks():
        log("post-checks failed", "WARN")
    log("done", "OK")


if __name__ == "__main__":
    main()
'''

def _check(c: Column, post: bool) -> Column:
    """The line of a check; null for a type that has none before (or after) the steps."""
    ns, label, service = (F.coalesce(c[k], F.lit("default" if k == "namespace" else "")) for k in ("namespace", "label_selector", "service_name"))
    words = lambda *w: F.to_json(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in w]))
    ask = lambda args, good, bad: F.concat(F.lit("ok = holds("), args, F.lit(", "), literal(good), F.lit(", "), literal(bad), F.lit(") and ok"))
    named = lambda text, x: F.concat(F.lit(text), x)
    if post:
        pods = ask(words("kubectl", "get", "pods", "-n", ns, "-l", label, "--no-headers"), F.concat(F.lit("pods in "), ns, F.coalesce(F.concat(F.lit(", expected: "), c["expected_count"]), F.lit(""))), named("no pods to be read in ", ns))
        return F.when(c["type"] == "pods_running", pods).when(c["type"] == "service_available", ask(words("kubectl", "get", "svc", service, "-n", ns), named("service there: ", service), named("no service ", service)))
    return (
        F.when(c["type"] == "cluster_reachable", ask(words("kubectl", "cluster-info"), F.lit("cluster reachable"), F.lit("cluster not reachable")))
        .when(c["type"] == "namespace_available", F.concat(F.lit("holds("), words("kubectl", "get", "namespace", ns), F.lit(", "), literal(named("already there: ", ns)), F.lit(", "), literal(named("free: ", ns)), F.lit(")")))
        .when(c["type"] == "namespace_exists", ask(words("kubectl", "get", "namespace", ns), named("namespace there: ", ns), named("no namespace ", ns)))
        .when(c["type"] == "helm_repo_available", F.concat(F.lit("log("), literal(F.concat(F.lit("repository is checked with the first chart: "), F.coalesce(c["target"], F.lit("")))), F.lit(")")))
    )


def _function(name: str, lines: Column, none: str, post: bool) -> Column:
    body = F.array_compact(F.transform(F.coalesce(lines, F.array().cast(f"array<{CHECK}>")), lambda c: _check(c, post)))
    text = F.when(F.size(body) > 0, F.array_join(F.transform(body, lambda x: F.concat(F.lit("    "), x)), "\n")).otherwise(F.lit(f'    log("{none}", "WARN")'))
    return F.concat(F.lit(f"\n\ndef {name}():\n    ok = True\n"), text, F.lit("\n    return ok\n"))


def scripts(parsed: DataFrame, key: str = "row_id") -> DataFrame:
    """key, script: each parsed configuration as one Python script with pre-checks, steps, post-checks, rollback and a dry run.

    An error configuration gives a script that prints its reason and fails.  A
    configuration that could not be parsed gives null.
    """
    steps, back = (F.coalesce(F.col(c), F.array().cast(f"array<{STEP}>")) for c in ("steps", "rollback_steps"))
    code = lambda s, by: F.regexp_replace(render(s["action"], s["params"], s["timeout_seconds"]), "(?m)^", " " * by)
    name = lambda s, i: F.when(s["id"].rlike(r"^[A-Za-z_]\w*$"), s["id"]).otherwise(F.concat(F.lit("step_"), (i + 1).cast("string")))
    say = lambda text, s, level: F.concat(F.lit("log("), literal(F.concat(F.lit(text), F.coalesce(s["description"], F.lit("")))), F.lit(f', "{level}")'))
    one = lambda s, i: F.concat(F.lit("\n\ndef "), name(s, i), F.lit("():\n    "), say("", s, "STEP"), F.lit("\n"), code(s, 4), F.lit("\n"))
    undo = lambda s: F.concat(F.lit("    try:\n        "), say("undo: ", s, "WARN"), F.lit("\n"), code(s, 8), F.lit('\n    except Exception as e:\n        log(f"undo failed: {e}", "ERROR")\n'))
    fact = lambda k, c, d: F.concat(F.lit(f"{k} = "), literal(F.coalesce(F.col(c), F.lit(d))), F.lit("\n"))
    body = F.concat(
        F.lit("#!/usr/bin/env python3\n# Review before running; --dry-run shows the commands.\n" + RUNTIME + "\n\n"),
        fact("DESCRIPTION", "description", ""), fact("RISK", "risk_level", "low"), fact("CLUSTER", "target_cluster", "default"), fact("DURATION", "estimated_duration", "unknown"),
        _function("run_pre_checks", F.col("pre_checks"), "no pre-checks", False),
        F.array_join(F.transform(steps, one), ""),
        F.lit("\n\nSTEPS = ["), F.array_join(F.transform(steps, name), ", "), F.lit("]\n"),
        _function("run_post_checks", F.col("post_checks"), "no post-checks", True),
        F.lit("\n\ndef run_rollback():\n"), F.when(F.size(back) > 0, F.array_join(F.transform(back, undo), "")).otherwise(F.lit('    log("no rollback steps", "WARN")\n')),
        F.lit(MAIN),
    )
    tip = F.when(F.coalesce("error_suggestion", F.lit("")) != "", F.concat(F.lit("print("), literal(F.concat(F.lit("Suggestion: "), F.col("error_suggestion"))), F.lit(", file=sys.stderr)\n"))).otherwise("")
    failed = F.concat(F.lit("#!/usr/bin/env python3\nimport sys\n\nprint("), literal(F.concat(F.lit("ERROR: "), F.coalesce("error_reason", F.lit("")))), F.lit(", file=sys.stderr)\n"), tip, F.lit("sys.exit(1)\n"))
    return parsed.select(key, F.when(F.col("mapping"), squeeze(F.when(F.col("is_error"), failed).otherwise(body))).alias("script"))


def squeeze(c: Column) -> Column:
    """Runs of three or more line ends as two."""
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def needs(steps: Column) -> dict[str, Column]:
    """Whether any step needs the machine interface, helm or kubectl."""
    has = lambda f: F.coalesce(F.exists(steps, lambda s: f(s["action"])), F.lit(False))
    return {"needs_vm": has(lambda a: a.startswith("one.vm.")), "needs_app": has(lambda a: a.contains("app.")), "needs_cluster": has(lambda a: a.startswith("oneke."))}


def requirement_flags(parsed: DataFrame, key: str = "row_id") -> DataFrame:
    """key, needs_vm, needs_app, needs_cluster: by the actions of the steps."""
    return parsed.select(key, *[c.alias(n) for n, c in needs(F.col("steps")).items()])


def script_summaries(parsed: DataFrame, key: str = "row_id") -> DataFrame:
    """key, summary: what a configuration's script does, for people: number of steps, risk, steps, requirements."""
    steps = F.coalesce("steps", F.array().cast(f"array<{STEP}>"))
    flags = needs(steps)
    listed = F.transform(action_summary(steps), lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x))
    tools = F.array_compact(F.array(F.when(flags["needs_cluster"], "  - kubectl"), F.when(flags["needs_app"], "  - helm"), F.when(flags["needs_vm"], "  - pyone")))
    text = F.concat(F.lit("Script of "), F.size(steps).cast("string"), F.lit(" steps\nDescription: "), F.coalesce("description", F.lit("")), F.lit("\nRisk: "), F.coalesce("risk_level", F.lit("low")), F.lit("\nSteps:\n"), F.array_join(listed, "\n"), F.when(F.size(tools) > 0, F.concat(F.lit("\nRequirements:\n"), F.array_join(tools, "\n"))).otherwise(""))
    return parsed.select(key, F.when(F.col("is_error"), F.concat(F.lit("ERROR: "), F.coalesce("error_reason", F.lit("")))).otherwise(text).alias("summary"))


__all__ = ["action_summary", "literal", "render", "render_steps", "requirement_flags", "script_summaries", "scripts", "squeeze"]
