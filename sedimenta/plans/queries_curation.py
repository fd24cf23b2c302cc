"""Queries over instruction data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation as C
from ..session import table

_B = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
_NB = r"[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
_FULL = f"regexp_matches(coalesce(instruction, ''), '{_NB}') AND regexp_matches(coalesce(output, ''), '{_NB}')"
_STRIP = lambda c: f"regexp_replace({c}, '^{_B}+|{_B}+$', '', 'g')"
_WORDS = lambda c: f"len(list_filter(regexp_split_to_array({c}, '{_B}+'), lambda w: w <> ''))"
_LENGTH = (
    f"CASE WHEN {_WORDS('instruction')} < 3 THEN 'instruction_short' WHEN {_WORDS('instruction')} > 200 THEN 'instruction_long' "
    f"WHEN length({_STRIP('output')}) < 20 THEN 'output_short' WHEN length({_STRIP('output')}) > 10000 THEN 'output_long' END"
)
_NEAR = r"array_to_string(list_sort(list_filter(regexp_split_to_array(regexp_replace(lower(instruction), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+'), lambda w: w <> '')), ' ')"
_REASONS = f"""
  full_rows AS (SELECT row_id, instruction, output, {_FULL} AS ok FROM eval_raw),
  exact AS (SELECT row_id, instruction, output, row_number() OVER (PARTITION BY sha256(instruction) ORDER BY row_id) AS rx FROM full_rows WHERE ok),
  near AS (SELECT row_id, instruction, output, row_number() OVER (PARTITION BY {_NEAR} ORDER BY row_id) AS rn FROM exact WHERE rx = 1),
  reasons AS (
    SELECT row_id, 'empty' AS reason FROM full_rows WHERE NOT ok
    UNION ALL SELECT row_id, 'exact_duplicate' FROM exact WHERE rx > 1
    UNION ALL SELECT row_id, 'near_duplicate' FROM near WHERE rn > 1
    UNION ALL SELECT row_id, {_LENGTH} FROM near WHERE rn = 1)"""
_SYS = T.SYSTEM_PROMPT.replace("'", "''")


def _rows(spark, d):
    return table(spark, d, "eval_raw")


def _chat(name):
    return lambda s, d: _rows(s, d).filter(C.has_fields()).select("row_id", T.chat(name, F.col("instruction"), F.col("output")).alias("text"))


def _split(s, d):
    return C.train_eval_split(_rows(s, d).filter(C.formattable()).select("row_id"))


def _stats(s, d):
    rows = _rows(s, d)
    return C.dataset_stats(_split(s, d), table(s, d, "gold_seed"), rows.filter(~F.coalesce(C.formattable(), F.lit(False))))


def _union(s, d):
    tagged = lambda t, tag: t.select("instruction", "output").withColumn("origin", F.lit(tag))
    both = tagged(table(s, d, "gold_seed"), "seed").unionByName(tagged(_rows(s, d), "generated"))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("output").alias("with_output"))


_REPORT = """count(*) AS total_in, count(*) FILTER (reason = 'empty') AS empty, count(*) FILTER (reason = 'exact_duplicate') AS exact_duplicates,
  count(*) FILTER (reason = 'near_duplicate') AS near_duplicates, count(*) FILTER (reason IN ('instruction_short', 'output_short')) AS too_short,
  count(*) FILTER (reason IN ('instruction_long', 'output_long')) AS too_long, count(*) FILTER (reason IS NULL) AS total_out, count(*) FILTER (reason IS NOT NULL) AS removed"""
_FMT = f"{_FULL} AND floor((length(instruction) + length(output)) / 4.0) <= 2048"
_SPLIT = f"""kept AS (SELECT row_id, sha256('42|' || row_id) AS h FROM eval_raw WHERE {_FMT}),
  ranked AS (SELECT row_id, row_number() OVER (ORDER BY h, row_id) AS r, count(*) OVER () AS n FROM kept),
  parts AS (SELECT row_id, CASE WHEN r <= floor(n * 0.1) THEN 'eval' ELSE 'train' END AS part FROM ranked)"""

QUERIES = {
    "required_fields": lambda s, d: _rows(s, d).filter(C.has_fields()).select("row_id"),
    "length_gate": lambda s, d: _rows(s, d).filter(C.has_fields()).select("row_id", C.length_reason().alias("reason")),
    "dedup_exact": lambda s, d: C.reject_reasons(_rows(s, d)).filter("reason = 'exact_duplicate'").select("row_id"),
    "dedup_near": lambda s, d: C.reject_reasons(_rows(s, d)).filter("reason = 'near_duplicate'").select("row_id"),
    "clean_rows": lambda s, d: C.reject_reasons(_rows(s, d)).select("row_id", "reason"),
    "dedup_report": lambda s, d: C.quality_report(C.reject_reasons(_rows(s, d))),
    "near_keys": lambda s, d: _rows(s, d).filter("instruction is not null").select("row_id", F.md5(T.near_key(F.col("instruction"))).alias("key")),
    "chat_template_mistral": _chat("mistral"),
    "chat_template_llama3": _chat("llama3"),
    "chat_template_chatml": _chat("chatml"),
    "chat_template_trainer": lambda s, d: _rows(s, d).filter(C.has_fields()).select("row_id", T.chat_mistral(F.col("instruction"), F.col("output"), tagged=True).alias("text")),
    "chat_template_inference": lambda s, d: table(s, d, "eval_prompt").select("item_id", T.chat_chatml(F.col("prompt"), F.lit(None).cast("string")).alias("text")),
    "train_eval_split": _split,
    "dataset_stats": _stats,
    "seed_union": _union,
    "generation_summary": lambda s, d: C.generation_summary(table(s, d, "generation_stats")),
    "fence_strip": lambda s, d: _rows(s, d).filter("output is not null").select("row_id", F.md5(T.strip_fence(F.col("output"))).alias("bare"), F.md5(T.drop_fence_lines(F.col("output"))).alias("without_lines")),
}
SQL = {
    "required_fields": f"SELECT row_id FROM eval_raw WHERE {_FULL}",
    "length_gate": f"SELECT row_id, {_LENGTH} AS reason FROM eval_raw WHERE {_FULL}",
    "dedup_exact": f"WITH {_REASONS} SELECT row_id FROM reasons WHERE reason = 'exact_duplicate'",
    "dedup_near": f"WITH {_REASONS} SELECT row_id FROM reasons WHERE reason = 'near_duplicate'",
    "clean_rows": f"WITH {_REASONS} SELECT row_id, reason FROM reasons",
    "dedup_report": f"WITH {_REASONS} SELECT {_REPORT} FROM reasons",
    "near_keys": f"SELECT row_id, md5({_NEAR}) AS key FROM eval_raw WHERE instruction IS NOT NULL",
    "chat_template_mistral": f"SELECT row_id, '<s>[INST] {_SYS}' || chr(10) || chr(10) || instruction || ' [/INST]' || chr(10) || '```yaml' || chr(10) || output || chr(10) || '```</s>' AS text FROM eval_raw WHERE {_FULL}",
    "chat_template_llama3": f"SELECT row_id, '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{_SYS}<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || instruction || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || '```yaml' || chr(10) || output || chr(10) || '```<|eot_id|>' AS text FROM eval_raw WHERE {_FULL}",
    "chat_template_chatml": f"SELECT row_id, '<|im_start|>system' || chr(10) || '{_SYS}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || instruction || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '```yaml' || chr(10) || output || chr(10) || '```<|im_end|>' AS text FROM eval_raw WHERE {_FULL}",
    "chat_template_trainer": f"SELECT row_id, '<s>[INST] <<SYS>>' || chr(10) || '{_SYS}' || chr(10) || '<</SYS>>' || chr(10) || chr(10) || instruction || ' [/INST]' || chr(10) || '```yaml' || chr(10) || output || chr(10) || '```</s>' AS text FROM eval_raw WHERE {_FULL}",
    "chat_template_inference": f"SELECT item_id, '<|im_start|>system' || chr(10) || '{_SYS}<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS text FROM eval_prompt",
    "train_eval_split": f"WITH {_SPLIT} SELECT row_id, part FROM parts",
    "dataset_stats": f"""WITH {_SPLIT}, a AS (SELECT count(*) FILTER (part = 'train') AS t, count(*) FILTER (part = 'eval') AS e FROM parts),
      b AS (SELECT count(*) AS s FROM gold_seed), c AS (SELECT count(*) FILTER (NOT coalesce({_FMT}, false)) AS k FROM eval_raw)
      SELECT t + e + s AS total, t + s AS train, e AS eval, s AS seeds, k AS skipped FROM a, b, c""",
    "seed_union": "SELECT origin, count(*) AS n, count(output) AS with_output FROM (SELECT 'seed' AS origin, output FROM gold_seed UNION ALL SELECT 'generated', output FROM eval_raw) GROUP BY origin",
    "generation_summary": "SELECT source, count(*) AS batches, CAST(sum(total_generated) AS BIGINT) AS generated, CAST(sum(schema_valid) AS BIGINT) AS valid, round(sum(schema_valid) / greatest(sum(total_generated), 1) * 100, 4) AS valid_pct, CAST(sum(api_calls) AS BIGINT) AS calls, CAST(sum(api_errors) AS BIGINT) AS errors, round(sum(coalesce(api_cost_estimate_usd, 0.0)), 6) AS cost FROM generation_stats GROUP BY source",
    "fence_strip": f"""SELECT row_id, md5({_STRIP(f"regexp_replace(regexp_replace({_STRIP('output')}, '^```(yaml|yml)?', ''), '```$', '')")}) AS bare,
      md5(CASE WHEN starts_with({_STRIP('output')}, '```') THEN {_STRIP(f"regexp_replace(regexp_replace({_STRIP('output')}, '^```[^' || chr(10) || ']*' || chr(10) || '?', ''), '```$', '')")} ELSE {_STRIP('output')} END) AS without_lines FROM eval_raw WHERE output IS NOT NULL""",
}
