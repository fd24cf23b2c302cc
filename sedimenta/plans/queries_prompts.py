"""Queries over search results, contexts, prompts, scripts and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions.embedders import create_embedder, embed
from ..operators import configs as G
from ..operators import curation as C
from ..operators import evaluation as E
from ..operators import prompts as P
from ..operators import retrieval as R
from ..operators import scripts as S
from ..session import table
from .queries_retrieval import _SCORED, _top

_SYSTEM = "Answer with YAML only."
_SHOTS = [("Make a namespace web.", "version: 1")]


def _found(s, d):
    """The twelve best vectors with the chunks of their number."""
    top = _top(s, d, 12).withColumn("chunk_row", F.col("vec_id") + 1)
    return table(s, d, "doc_chunk").join(F.broadcast(top), "chunk_row")


def _results(s, d):
    return P.search_results(_found(s, d), "chunk_row")


def _documents(s, d):
    m = F.col("metadata")
    return P.search_documents(_results(s, d), "chunk_row").select(F.md5("page_content").alias("page"), m["source"].alias("source"), m["section"].alias("section"), m["heading_hierarchy"].alias("heading_hierarchy"), m["score"].alias("score"), m["chunk_id"].alias("chunk_id"))


def _previews(s, d):
    rank = F.row_number().over(R.Window.orderBy(F.desc("score"), "vec_id"))
    return R.previews(_found(s, d).withColumn("rank", rank))


def _contexts(s, d):
    """Chunks of each section's first three pages as one numbered context a section."""
    chunks = table(s, d, "doc_chunk").filter("section is not null")
    rank = F.row_number().over(R.Window.partitionBy("section").orderBy("chunk_row"))
    first = chunks.select("section", "chunk_row", "source_url", "content").withColumn("rank", rank).filter("rank <= 3")
    return P.numbered_context(first, ["section"], "rank", "source_url", "content").select("section", F.md5("context").alias("context"), F.size("chunks").alias("n"))


def _context_states(s, d):
    p = table(s, d, "eval_prompt")
    context = F.when(F.col("item_id") % 4 != 1, F.col("category"))
    return p.select("item_id", P.context_of(F.col("item_id") % 4 != 0, F.col("item_id") % 4 == 2, context).alias("context"))


def _raw_prompts(s, d):
    p = table(s, d, "eval_prompt")
    context = P.context_of(F.col("item_id") % 4 != 0, F.col("item_id") % 4 == 2, F.when(F.col("item_id") % 4 != 1, F.col("category")))
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    history = F.when(F.col("expect_error"), F.array(turn("assistant", F.col("difficulty")), turn("user", F.lit("Try again."))))
    return p.filter("difficulty is not null").select("item_id", P.raw_prompt(F.col("prompt"), context, history).alias("prompt"))


def _messages(s, d):
    m = T.messages(_SYSTEM, _SHOTS, None, F.col("prompt"))
    return table(s, d, "eval_prompt").select("item_id", F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit("="), x["content"])), "|").alias("turns"))


def _judge(s, d):
    rows = table(s, d, "eval_raw").filter("instruction is not null")
    ref = P.references(rows, table(s, d, "gold_seed"))
    return rows.select("row_id", "instruction", "output").join(ref, "row_id").select("row_id", F.md5(P.judge_prompt(F.col("instruction"), F.col("output"), F.col("reference"))).alias("prompt"))


def _error_lists(s, d):
    return table(s, d, "generation_stats").select("batch_id", T.numbered(F.transform(F.coalesce("invalid_examples", F.array().cast("array<struct<instruction:string,error:string>>")), lambda e: e["error"])).alias("errors"))


def _result_lines(s, d):
    g = table(s, d, "generation_stats")
    ok = F.coalesce(F.col("schema_invalid") == 0, F.lit(False))
    return g.select("batch_id", P.result_line(ok, F.col("batch_id"), F.col("total_generated"), F.col("api_calls"), F.col("api_errors") / 4.0, F.concat(F.lit("errors "), F.col("api_errors").cast("string"))).alias("line"))


def _labels(s, d):
    g = table(s, d, "generation_stats")
    backend = F.when(F.col("batch_seq") % 3 == 0, "openai").otherwise("ollama")
    return g.select("batch_id", P.model_label(backend, F.col("source"), F.col("batch_seq") % 5 == 0, "synthetic").alias("label"))


def _json_fences(s, d):
    o = F.col("output")
    wrapped = F.when(F.col("row_id") % 3 == 0, F.concat(F.lit("```json\n"), o, F.lit("\n```"))).when(F.col("row_id") % 3 == 1, F.concat(F.lit("```\n"), o)).otherwise(o)
    return table(s, d, "eval_raw").filter("output is not null").select("row_id", F.md5(P.strip_json_fence(wrapped)).alias("text"))


def _costs(s, d):
    n = lambda c: F.coalesce(T.token_estimate(F.col(c)), F.lit(0))
    return table(s, d, "eval_raw").groupBy("source").agg(F.round(F.sum(C.token_cost(n("instruction"), n("output"))), 6).alias("cost"))


def _union(s, d):
    """The four generators' rows: seeds, their variations, negatives, and the rest as complex ones."""
    e = table(s, d, "eval_raw")
    parts = {"seeds": table(s, d, "gold_seed"), "variations": e.filter("source = 'paraphrase'"), "negatives": e.filter("source = 'negatives'"), "complex": e.filter("source not in ('paraphrase', 'negatives') or source is null")}
    return C.union_tagged(parts, ["instruction", "output"]).select("origin", F.md5(F.concat_ws("|", "instruction", "output")).alias("row"))


def _train_parts(s, d):
    rows = table(s, d, "eval_raw").filter(C.formattable())
    split = rows.select("row_id", "instruction", "output").join(C.train_eval_split(rows.select("row_id")), "row_id")
    train, held = C.training_parts(split, table(s, d, "gold_seed"), ["instruction", "output"])
    return C.union_tagged({"train": train, "eval": held}, ["instruction"], "part").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("instruction"), F.lit(0))).alias("chars"))


def _judge_means(s, d):
    dims = ["accuracy", "completeness", "safety", "style", "brevity"]
    score = F.floor(F.col("value") % 6).cast("int")
    answer = F.to_json(F.create_map(F.lit("accuracy"), F.struct(score.alias("score")), F.lit("safety"), F.struct((score + 1).alias("score"))))
    return E.row_means(E.judge_rows(table(s, d, "events").select("event_id", answer.alias("answer")), "event_id", "answer", dims), "event_id")


_FLAGS = [("n_steps", r"(?m)^  - id:"), ("n_rollback", r"(?m)^rollback:"), ("n_pre", r"(?m)^  pre_checks:"), ("n_post", r"(?m)^  post_checks:")]


def _backends(s, d):
    """The first row of each seed from either of two generators, as what two backends made of one request."""
    o = F.coalesce("output", F.lit(""))
    rows = table(s, d, "eval_raw").filter("seed_id is not null and source in ('paraphrase', 'synthetic')")
    first = F.min_by(F.struct("output", "row_id"), "row_id").alias("x")
    per = rows.groupBy("seed_id", "source").agg(first, F.count(F.lit(1)).alias("attempts")).select("seed_id", "source", "attempts", F.col("x.output").alias("output"), (F.col("x.row_id") / 8.0).alias("seconds"))
    flags = [(F.regexp_count(o, F.lit(p)) if n == "n_steps" else o.rlike(p).cast("int")).alias(n) for n, p in _FLAGS]
    return E.backend_scores(per.select("seed_id", "source", (o.rlike("(?m)^version:") & o.rlike("(?m)^steps:")).alias("success"), "attempts", "seconds", *flags), ["seed_id", "source"])


def _pairs(s, d):
    b = _backends(s, d)
    side = lambda source, x: b.filter(F.col("source") == source).select("seed_id", *[F.col(m).cast("double").alias(f"{x}_{m}") for m in E.METRICS])
    return side("paraphrase", "a").join(side("synthetic", "b"), "seed_id")


def _duels(s, d):
    w = E.head_to_head(F.lit("a"), F.col("a_quality"), F.col("a_seconds"), F.lit("b"), F.col("b_quality"), F.col("b_seconds"))
    return _pairs(s, d).select("seed_id", w.alias("winner"))


def _evaluated(s, d):
    """Rows of generated data with the test item of their number, as answers to it."""
    o = F.coalesce("output", F.lit(""))
    valid = o.rlike("(?m)^version:") & o.rlike("(?m)^(steps|error):")
    rows = table(s, d, "eval_raw").select(F.col("row_id"), (F.col("row_id") % 120 + 1).alias("item_id"), "output", valid.alias("is_valid"), F.regexp_extract_all(o, F.lit(r"(?m)^ *action: *(\S+)"), 1).alias("actions"), o.rlike("(?m)^error:").alias("is_error"), F.when(~valid, F.concat(F.lit("not valid: "), o)).alias("error"))
    items = table(s, d, "eval_prompt").select("item_id", "category", "difficulty", "expected_actions", "expect_error", "prompt")
    return rows.join(F.broadcast(items), "item_id")


def _failed(s, d):
    a = _evaluated(s, d)
    return E.failed_rows(E.evaluate_prompts(a, "row_id").select("row_id", "passed", "error").join(a.select("row_id", "prompt"), "row_id"), "row_id", "prompt", "error")


def _prompt_results(s, d):
    r = E.evaluate_prompts(_evaluated(s, d), "row_id")
    return r.withColumns({"error": F.md5("error"), "output": F.md5("output")})


def _parsed(s, d):
    return G.parse_configs(table(s, d, "eval_raw").select("row_id", "output"))


def _commands(s, d):
    """One step for each customer, of eight actions by turns, rendered."""
    name, k = F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))), F.col("c_custkey").cast("string")
    one = lambda a, *kv: F.struct(F.lit(a).alias("action"), F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv]).alias("params"))
    cases = [
        one("oneke.namespace.delete", "name", name), one("oneke.service.expose", "namespace", name, "deployment_name", k, "port", F.lit("80"), "target_port", F.lit("8080")),
        one("oneke.app.list", "namespace", F.lit("")), one("oneke.app.uninstall", "release_name", name, "namespace", k, "keep_history", F.lit("true")),
        one("oneke.namespace.create", "name", name, "labels", F.concat(F.lit('{"tier":"'), k, F.lit('"}'))), one("oneke.cluster.scale_nodes", "worker_count", k),
        one("oneke.app.deploy", "chart", F.lit("shop/web"), "release_name", name, "namespace", k, "repo_url", F.lit("https://charts.example")), one("one.vm.resize", "vm_id", k),
    ]
    step = cases[-1]
    for i, c in reversed(list(enumerate(cases[:-1]))):
        step = F.when(F.col("c_custkey") % 8 == i, c).otherwise(step)
    rows = table(s, d, "customer").select("c_custkey", step.alias("s"))
    return rows.select("c_custkey", F.col("s.action").alias("action"), S.render(F.col("s.action"), F.col("s.params")).alias("command"))


def _summaries(s, d):
    return S.script_summaries(_parsed(s, d)).select("row_id", F.md5("summary").alias("summary"))


def _roundtrip(s, d):
    """Whether a configuration written anew reads as the same steps."""
    rows = table(s, d, "eval_raw").select("row_id", G.as_yaml(T.strip_fence(F.col("output"))).alias("output"))
    again = G.parse_configs(rows).select("row_id", F.sha2(F.to_json("steps"), 256).alias("b"))
    return _parsed(s, d).filter("mapping").select("row_id", F.sha2(F.to_json("steps"), 256).alias("a")).join(again, "row_id").select("row_id", (F.col("a") == F.col("b")).alias("same"))


def _normalized(s, d):
    """Answers of a generator as JSON, some with an object for an output, some with a number, some with a text."""
    k = F.col("item_id")
    out = F.when(k % 3 == 0, S.literal(F.col("prompt"))).when(k % 3 == 1, F.concat(F.lit('{"version":"1.0","item":'), k.cast("string"), F.lit("}"))).otherwise(F.lit("7"))
    payload = F.concat(F.lit('{"instruction":'), S.literal(F.col("category")), F.lit(',"output":'), out, F.lit("}"))
    return G.normalize_outputs(table(s, d, "eval_prompt").select("item_id", payload.alias("payload")), "item_id", "payload")


def _anchors(s, d):
    """Three links on every page (itself with a fragment, a page below it, a mail address) as its crawler finds them."""
    page = F.concat(F.lit('<a href="'), F.col("url"), F.lit('#top">x</a><a href="more/../part_two">y</a><a href="mailto:a@b.example">z</a><a href="data.yaml">w</a>'))
    base = F.regexp_extract("url", r"^([a-z]+://[^/]+/)", 1)
    rows = table(s, d, "scraped_page").select("page_id", "url", page.alias("html"), base.alias("base")).dropDuplicates(["url"])
    return H.extract_pages(rows, base="base").select("url", F.explode("links").alias("link"))


def _embedded(s, d):
    e = create_embedder("hashing", dimension=64)
    v = table(s, d, "doc_chunk").select("chunk_row", embed(F.col("content"), e).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return v.select("chunk_row", F.size("v").alias("dimension"), F.round(norm, 3).alias("norm"))


QUERIES = {
    "search_results": lambda s, d: _results(s, d).withColumn("content", F.md5("content")),
    "search_documents": _documents,
    "result_previews": _previews,
    "numbered_contexts": _contexts,
    "context_states": _context_states,
    "raw_prompts": _raw_prompts,
    "message_lists": _messages,
    "judge_prompts": _judge,
    "error_lists": _error_lists,
    "result_lines": _result_lines,
    "model_labels": _labels,
    "json_fence_strip": _json_fences,
    "token_costs": _costs,
    "generator_union": _union,
    "training_parts": _train_parts,
    "reference_lookup": lambda s, d: P.references(table(s, d, "eval_raw").filter("instruction is not null"), table(s, d, "gold_seed")).select("row_id", F.md5("reference").alias("reference")),
    "judge_row_means": _judge_means,
    "backend_scores": _backends,
    "backend_table": lambda s, d: E.comparison_table(_pairs(s, d), "seed_id", list(E.METRICS)),
    "backend_winners": _duels,
    "prompt_results": _prompt_results,
    "failed_prompts": _failed,
    "category_report": lambda s, d: E.group_report(E.evaluate_prompts(_evaluated(s, d), "row_id"), "category"),
    "dir_slugs": lambda s, d: table(s, d, "eval_prompt").select("item_id", T.dir_slug(F.col("prompt")).alias("slug")),
    "section_listing": lambda s, d: R.store_stats(table(s, d, "doc_chunk")).filter("section is not null").orderBy("section"),
    "squeezed_lines": lambda s, d: table(s, d, "scraped_page").filter("content is not null").select("page_id", F.md5(S.squeeze(F.col("content"))).alias("text")),
    "render_commands": _commands,
    "action_summaries": lambda s, d: _parsed(s, d).filter("mapping").select("row_id", F.array_join(S.action_summary(F.col("steps")), "|").alias("summary")),
    "script_summaries": _summaries,
    "config_roundtrip": _roundtrip,
    "schema_rejects": lambda s, d: G.schema_filter(table(s, d, "eval_raw").select("row_id", "instruction", "output"))[1],
    "schema_eval": lambda s, d: G.schema_eval(table(s, d, "eval_raw").select("row_id", "output")),
    "output_normalise": _normalized,
    "link_extract": _anchors,
    "embed_chunks": _embedded,
}

_TOP12 = f"{_SCORED}, t AS (SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 12), f AS (SELECT d.*, t.score, t.vec_id FROM t JOIN doc_chunk d ON d.chunk_row = t.vec_id + 1)"
_HIER = "coalesce(array_to_string(heading_hierarchy, ' > '), '')"
_B = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
_strip = lambda c: f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"
_CTX = "CASE WHEN item_id % 4 = 0 THEN '(No documentation context available.)' WHEN item_id % 4 = 2 THEN '(RAG retrieval error.)' WHEN item_id % 4 = 1 OR coalesce(category, '') = '' THEN '(No relevant docs found.)' ELSE category END"
_NL = "chr(10)"
_DASHES = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
_TOK = lambda c: f"CAST(trunc((length({c}) - (length({c}) - length(regexp_replace({c}, '(?s)```.*?```', '', 'g')))) / 4.0::DOUBLE + (length({c}) - length(regexp_replace({c}, '(?s)```.*?```', '', 'g'))) / 3.2::DOUBLE) AS INT)"
_REF = "r AS (SELECT instruction, max(output) AS gold FROM gold_seed WHERE instruction IS NOT NULL GROUP BY instruction)"
_FULL = r"regexp_matches(coalesce(instruction, ''), '[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]') AND regexp_matches(coalesce(output, ''), '[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]') AND floor((length(instruction) + length(output)) / 4.0) <= 2048"
_O = "coalesce(output, '')"
_HAS = lambda p: f"regexp_matches({_O}, '{p}')"
_BACK = rf"""p AS (SELECT seed_id, source, count(*) AS attempts, min(row_id) AS row_id FROM eval_raw WHERE seed_id IS NOT NULL AND source IN ('paraphrase', 'synthetic') GROUP BY ALL),
  q AS (SELECT p.*, {_HAS('(?m)^version:')} AND {_HAS('(?m)^steps:')} AS ok, len(regexp_extract_all({_O}, '(?m)^  - id:')) AS n, {_HAS('(?m)^rollback:')} AS rb, {_HAS('(?m)^  pre_checks:')} AS pre, {_HAS('(?m)^  post_checks:')} AS post FROM p JOIN eval_raw USING (row_id)),
  b AS (SELECT seed_id, source, CASE WHEN ok THEN 1 + (n > 0)::INT + rb::INT + pre::INT + post::INT ELSE 0 END AS quality, ok AS schema_valid, CASE WHEN ok THEN CAST(n AS INT) ELSE 0 END AS steps, ok AND rb AS rollback, ok AND pre AS pre_checks, ok AND post AS post_checks, attempts, row_id / 8.0::DOUBLE AS seconds FROM q)"""
_LONG = " UNION ALL ".join(f"SELECT seed_id, source, '{m}' AS metric, {m}::DOUBLE AS v FROM b" for m in E.METRICS)
_ACT = rf"regexp_extract_all({_O}, '(?m)^ *action: *(\S+)', 1)"
_EVAL = rf"""e AS (SELECT r.row_id, i.category, i.difficulty, i.prompt, output, {_HAS('(?m)^version:')} AND {_HAS('(?m)^(steps|error):')} AS ok, {_ACT} AS acts, {_HAS('(?m)^error:')} AS err, coalesce(expect_error, false) AS want, expected_actions FROM eval_raw r JOIN eval_prompt i ON i.item_id = r.row_id % 120 + 1),
  f AS (SELECT *, CASE WHEN want THEN err OR len(acts) = 0 ELSE len(list_filter(expected_actions, lambda x: NOT list_contains(acts, x))) = 0 END AS fit FROM e),
  g AS (SELECT *, ok AND fit AND (want OR len(acts) > 0) AS passed, CASE WHEN ok THEN '' ELSE 'not valid: ' || {_O} END AS error FROM f)"""
_Q = lambda *w: "'[' || " + " || ',' || ".join(f"""'"' || {x} || '"'""" for x in w) + " || ']'"
_RUN = lambda *w: "'run(' || " + _Q(*w) + " || ')'"
_N, _K = "lower(replace(c_name, '#', '-'))", "c_custkey::VARCHAR"
SQL = {
    "search_results": f"WITH {_TOP12} SELECT chunk_row, md5(content) AS content, score, coalesce(source_url, '') AS source_url, coalesce(section, '') AS section, {_HIER} AS heading_hierarchy FROM f",
    "search_documents": f"WITH {_TOP12} SELECT md5(content) AS page, coalesce(source_url, '') AS source, coalesce(section, '') AS section, {_HIER} AS heading_hierarchy, score, chunk_row AS chunk_id FROM f",
    "result_previews": f"WITH {_TOP12} SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INT) AS rank, printf('%.3f', score) AS score, substr({_HIER}, 1, 30) AS heading, substr(replace(content, chr(10), ' '), 1, 120) || '...' AS preview FROM f",
    "numbered_contexts": f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY chunk_row) AS r FROM doc_chunk WHERE section IS NOT NULL)
      SELECT section, md5(string_agg('[' || r || '] Source: ' || coalesce(source_url, 'unknown') || chr(10) || {_strip("coalesce(content, '')")}, {_DASHES} ORDER BY r)) AS context, CAST(count(*) AS INT) AS n FROM c WHERE r <= 3 GROUP BY section""",
    "context_states": f"SELECT item_id, {_CTX} AS context FROM eval_prompt",
    "raw_prompts": f"""WITH c AS (SELECT *, {_CTX} AS context FROM eval_prompt WHERE difficulty IS NOT NULL)
      SELECT item_id, CASE WHEN expect_error THEN '[Previous attempt output]' || chr(10) || difficulty || chr(10) || chr(10) || 'Try again.' || chr(10) || chr(10) ELSE '' END ||
        CASE WHEN context LIKE '(%' THEN prompt ELSE 'Documentation context (reference only -- do NOT copy commands verbatim):' || chr(10) || chr(10) || context || {_DASHES} || 'Request: ' || prompt END AS prompt FROM c""",
    "message_lists": f"SELECT item_id, 'system={_SYSTEM}|user={_SHOTS[0][0]}|assistant={_SHOTS[0][1]}|user=' || prompt AS turns FROM eval_prompt",
    "judge_prompts": f"""WITH {_REF}, x AS (SELECT row_id, e.instruction, coalesce(output, '') AS output, coalesce(gold, output, '') AS ref FROM eval_raw e LEFT JOIN r USING (instruction) WHERE e.instruction IS NOT NULL)
      SELECT row_id, md5('Request:' || chr(10) || instruction || chr(10) || chr(10) || 'Generated configuration:' || chr(10) || output || CASE WHEN ref <> '' THEN chr(10) || chr(10) || 'Reference configuration:' || chr(10) || ref ELSE '' END) AS prompt FROM x""",
    "error_lists": "SELECT batch_id, array_to_string(list_transform(coalesce(invalid_examples, []), lambda e, i: i || '. ' || e.error), chr(10)) AS errors FROM generation_stats",
    "result_lines": "SELECT batch_id, CASE WHEN coalesce(schema_invalid = 0, false) THEN printf('✅  Generated config ''%s'' with %d step(s) in %d attempt(s) (%.1fs)', batch_id, total_generated, api_calls, api_errors / 4.0::DOUBLE) ELSE printf('❌  Failed after %d attempt(s): errors %d', api_calls, api_errors) END AS line FROM generation_stats",
    "model_labels": "SELECT batch_id, CASE WHEN batch_seq % 3 = 0 THEN 'openai/' || source ELSE 'ollama/' || source || CASE WHEN batch_seq % 5 = 0 OR starts_with(source, 'synthetic') THEN ' [fine-tuned]' ELSE '' END END AS label FROM generation_stats",
    "json_fence_strip": f"""WITH w AS (SELECT row_id, CASE row_id % 3 WHEN 0 THEN '```json' || chr(10) || output || chr(10) || '```' WHEN 1 THEN '```' || chr(10) || output ELSE output END AS t FROM eval_raw WHERE output IS NOT NULL),
      l AS (SELECT row_id, t, string_split(t, chr(10))[2:] AS r FROM w)
      SELECT row_id, md5({_strip(f"CASE WHEN starts_with(t, '```') THEN array_to_string(CASE WHEN len(r) > 0 AND {_strip('r[-1]')} = '```' THEN r[:-2] ELSE r END, chr(10)) ELSE t END")}) AS text FROM l""",
    "token_costs": f"SELECT source, round(sum((coalesce({_TOK('instruction')}, 0) * 0.15::DOUBLE + coalesce({_TOK('output')}, 0) * 0.6::DOUBLE) / 1e6), 6) AS cost FROM eval_raw GROUP BY source",
    "generator_union": """WITH u AS (SELECT 'seeds' AS origin, instruction, output FROM gold_seed UNION ALL SELECT CASE source WHEN 'paraphrase' THEN 'variations' WHEN 'negatives' THEN 'negatives' ELSE 'complex' END, instruction, output FROM eval_raw)
      SELECT origin, md5(concat_ws('|', instruction, output)) AS row FROM u""",
    "training_parts": f"""WITH k AS (SELECT row_id, instruction, sha256('42|' || row_id) AS h FROM eval_raw WHERE {_FULL}), r AS (SELECT *, row_number() OVER (ORDER BY h, row_id) AS r, count(*) OVER () AS n FROM k),
      u AS (SELECT CASE WHEN r <= floor(n * 0.1) THEN 'eval' ELSE 'train' END AS part, instruction FROM r UNION ALL SELECT 'train', instruction FROM gold_seed)
      SELECT part, count(*) AS n, CAST(sum(coalesce(length(instruction), 0)) AS BIGINT) AS chars FROM u GROUP BY part""",
    "reference_lookup": f"WITH {_REF} SELECT row_id, md5(coalesce(gold, output)) AS reference FROM eval_raw LEFT JOIN r USING (instruction) WHERE instruction IS NOT NULL",
    "judge_row_means": "SELECT event_id, round((2 * CAST(floor(value % 6) AS INT) + 1) / 5.0::DOUBLE, 6) AS avg_score FROM events",
    "backend_scores": f"WITH {_BACK} SELECT * FROM b",
    "backend_table": f"""WITH {_BACK}, l AS ({_LONG}) SELECT x.seed_id, x.metric, x.v AS a, y.v AS b, CASE WHEN x.v = y.v THEN 'equal' WHEN (x.v > y.v) = (x.metric NOT IN ('attempts', 'seconds')) THEN 'a' ELSE 'b' END AS better
      FROM l x JOIN l y ON x.seed_id = y.seed_id AND x.metric = y.metric AND x.source = 'paraphrase' AND y.source = 'synthetic'""",
    "backend_winners": f"""WITH {_BACK} SELECT x.seed_id, CASE WHEN x.quality > y.quality THEN 'a' WHEN y.quality > x.quality THEN 'b' WHEN x.seconds < y.seconds THEN 'a (faster)' WHEN y.seconds < x.seconds THEN 'b (faster)' ELSE 'tie' END AS winner
      FROM b x JOIN b y ON x.seed_id = y.seed_id AND x.source = 'paraphrase' AND y.source = 'synthetic'""",
    "prompt_results": f"WITH {_EVAL} SELECT row_id, category, difficulty, passed, {_O} <> '' AS has_output, fit AS right_actions, CAST(len(acts) AS INT) AS n_actions, md5(substr(error, 1, 200)) AS error, md5(substr({_O}, 1, 500)) AS output FROM g",
    "failed_prompts": f"WITH {_EVAL} SELECT row_id, substr(coalesce(prompt, ''), 1, 50) || '...' AS prompt, substr(error, 1, 80) AS reason FROM g WHERE NOT passed",
    "category_report": f"""WITH {_EVAL}, s AS (SELECT coalesce(category, 'unknown') AS category, count(*) FILTER (passed) AS passed, count(*) AS total FROM g GROUP BY 1)
      SELECT category, repeat('█', CAST(floor(passed / total * 10) AS INT)) || repeat('░', 10 - CAST(floor(passed / total * 10) AS INT)) AS bar, passed, total, round(passed / total, 6) AS pass_rate FROM s""",
    "dir_slugs": "SELECT item_id, lower(replace(substr(prompt, 1, 30), ' ', '-')) AS slug FROM eval_prompt",
    "section_listing": "SELECT coalesce(section, 'unknown') AS section, count(*) AS chunks, count(*) FILTER (coalesce(has_code, false)) AS code_chunks FROM doc_chunk GROUP BY 1 ORDER BY 1",
    "squeezed_lines": r"SELECT page_id, md5(regexp_replace(content, '\n{3,}', chr(10) || chr(10), 'g')) AS text FROM scraped_page WHERE content IS NOT NULL",
    "render_commands": f"""SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'oneke.namespace.delete' WHEN 1 THEN 'oneke.service.expose' WHEN 2 THEN 'oneke.app.list' WHEN 3 THEN 'oneke.app.uninstall' WHEN 4 THEN 'oneke.namespace.create' WHEN 5 THEN 'oneke.cluster.scale_nodes' WHEN 6 THEN 'oneke.app.deploy' ELSE 'one.vm.resize' END AS action,
      CASE c_custkey % 8 WHEN 0 THEN {_RUN("'kubectl'", "'delete'", "'namespace'", _N, "'--ignore-not-found'")}
      WHEN 1 THEN {_RUN("'kubectl'", "'expose'", "'deployment'", _K, "'--port=80'", "'--target-port=8080'", "'--type=ClusterIP'", "'-n'", _N)}
      WHEN 2 THEN {_RUN("'helm'", "'list'", "'--all-namespaces'")}
      WHEN 3 THEN {_RUN("'helm'", "'uninstall'", _N, "'--namespace'", _K, "'--keep-history'")}
      WHEN 4 THEN {_RUN("'kubectl'", "'create'", "'namespace'", _N)} || chr(10) || {_RUN("'kubectl'", "'label'", "'namespace'", _N, f"'tier=' || {_K}")}
      WHEN 5 THEN 'log("Scaling workers to ' || {_K} || ' nodes via OneFlow...")' || chr(10) || {_RUN("'oneflow'", "'scale'", "'default'", "'worker'", _K)}
      WHEN 6 THEN {_RUN("'helm'", "'repo'", "'add'", "'shop'", "'https://charts.example'")} || chr(10) || {_RUN("'helm'", "'repo'", "'update'")} || chr(10) || {_RUN("'helm'", "'install'", _N, "'shop/web'", "'--namespace'", _K, "'--create-namespace'", "'--wait'", "'--timeout'", "'120s'")}
      ELSE 'log("no command for one.vm.resize", "WARN")' END AS command FROM customer""",
    "link_extract": r"""WITH p AS (SELECT DISTINCT url, regexp_replace(url, '/+$', '') AS u FROM scraped_page), b AS (SELECT url, CASE WHEN ends_with(url, '/') THEN url ELSE regexp_replace(url, '[^/]*$', '') END AS dir, u FROM p)
      SELECT url, u || '/' AS link FROM b UNION ALL SELECT url, dir || 'part_two/' FROM b""",
}
