"""Search results, contexts and prompts as columns; summaries of runs as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import BLANKS

# Contexts that stand for the absence of one, and the layout of a prompt with context.
NO_CONTEXT = ("(No documentation context available.)", "(No relevant docs found.)", "(RAG retrieval error.)")
DISABLED, NONE_FOUND, FAILED = NO_CONTEXT
SEPARATOR = "\n\n---\n\n"

_TURNS = "array<struct<role:string,content:string>>"


def search_results(found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, content, score, source_url, section, heading_hierarchy of found rows; missing metadata is an empty text."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.select(key, "content", "score", text("source_url"), text("section"), F.coalesce(F.array_join("heading_hierarchy", " > "), F.lit("")).alias("heading_hierarchy"))


def search_documents(results: DataFrame, key: str = "chunk_id") -> DataFrame:
    """page_content and a metadata struct of five fields for each search result."""
    return results.select(F.col("content").alias("page_content"), F.struct(F.col("source_url").alias("source"), "section", "heading_hierarchy", "score", F.col(key).alias("chunk_id")).alias("metadata"))


def numbered_context(ranked: DataFrame, groups: list[str], rank: str = "rank", source: str = "source", text: str = "text") -> DataFrame:
    """groups, context, chunks: numbered parts '[i] Source: s' in rank order, and the (source, text) pairs."""
    each = F.struct(F.col(rank).alias("r"), F.coalesce(source, F.lit("unknown")).alias("source"), F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)).alias("text"))
    rows = ranked.groupBy(*groups).agg(F.array_sort(F.collect_list(each)).alias("c"))
    parts = F.transform("c", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Source: "), x["source"], F.lit("\n"), x["text"]))
    return rows.select(*groups, F.array_join(parts, SEPARATOR).alias("context"), F.transform("c", lambda x: F.struct(x["source"], x["text"])).alias("chunks"))


def context_of(enabled: Column, failed: Column, context: Column) -> Column:
    """The context of a request, or the sentence that says why there is none."""
    return F.when(~F.coalesce(enabled, F.lit(False)), DISABLED).when(F.coalesce(failed, F.lit(False)), FAILED).when(F.coalesce(context, F.lit("")) == "", NONE_FOUND).otherwise(context)


def raw_prompt(request: Column, context: Column, history: Column | None = None) -> Column:
    """A prompt as one text: earlier turns (answers marked), then the request, after its context if there is one."""
    turns = F.coalesce(history, F.array().cast(_TURNS)) if history is not None else F.array().cast(_TURNS)
    before = F.transform(turns, lambda t: F.when(t["role"] == "assistant", F.concat(F.lit("[Previous attempt output]\n"), t["content"])).otherwise(t["content"]))
    has = (F.coalesce(context, F.lit("")) != "") & ~context.isin(*NO_CONTEXT)
    asked = F.when(has, F.concat(F.lit("Documentation context (reference only -- do NOT copy commands verbatim):\n\n"), context, F.lit(SEPARATOR + "Request: "), request)).otherwise(request)
    return F.array_join(F.concat(before, F.array(asked)), "\n\n")


def judge_prompt(instruction: Column, output: Column, reference: Column) -> Column:
    """What a judge is asked about an answer; the reference only where there is one."""
    ref = F.when(F.coalesce(reference, F.lit("")) != "", F.concat(F.lit("\n\nReference configuration:\n"), reference)).otherwise("")
    return F.concat(F.lit("Request:\n"), F.coalesce(instruction, F.lit("")), F.lit("\n\nGenerated configuration:\n"), F.coalesce(output, F.lit("")), ref)


def result_line(success: Column, label: Column, steps: Column, attempts: Column, seconds: Column, error: Column) -> Column:
    """One line about a run: what it made, in how many steps and attempts, or why it failed."""
    good = F.format_string("✅  Generated config '%s' with %d step(s) in %d attempt(s) (%.1fs)", label, steps, attempts, F.bround(seconds, 1))
    return F.when(success, good).otherwise(F.format_string("❌  Failed after %d attempt(s): %s", attempts, error))


def model_label(backend: Column, model: Column, tuned: Column, prefix: str) -> Column:
    """'backend/model', marked if the model is fine-tuned: said so, or by the prefix of its name; hosted models never are."""
    is_tuned = F.coalesce(tuned, F.lit(False)) | model.startswith(prefix)
    return F.concat(backend, F.lit("/"), model, F.when((backend == "ollama") & is_tuned, " [fine-tuned]").otherwise(""))


def strip_json_fence(c: Column) -> Column:
    """Without a first line that opens a fence and a last line that is nothing but one, stripped."""
    lines = F.split(c, "\n")
    rest = F.slice(lines, F.lit(2), F.size(lines))
    closed = (F.size(rest) > 0) & (F.btrim(F.element_at(F.when(F.size(rest) > 0, rest).otherwise(F.array(F.lit(""))), -1), F.lit(BLANKS)) == "```")
    inner = F.when(closed, F.slice(rest, F.lit(1), F.size(rest) - 1)).otherwise(rest)
    return F.btrim(F.when(c.startswith("```"), F.array_join(inner, "\n")).otherwise(c), F.lit(BLANKS))


def references(rows: DataFrame, gold: DataFrame, key: str = "row_id", instruction: str = "instruction", output: str = "output") -> DataFrame:
    """key, reference: the gold answer to the same instruction, else the row's own, else null.

    Of several gold answers to one instruction the greatest text counts.
    """
    best = gold.filter(F.col(instruction).isNotNull()).groupBy(instruction).agg(F.max(output).alias("_gold"))
    return rows.join(best, instruction, "left").select(key, F.coalesce("_gold", F.col(output)).alias("reference"))
