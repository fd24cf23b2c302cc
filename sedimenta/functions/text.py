"""Scalar text functions as Column builders; all stay in whole-stage code generation but for lambdas over arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Blanks as Unicode has them; Java's and RE2's \s know only ASCII.
BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
NOT_BLANK = r"[^\s\x{00A0}\x{2000}-\x{200A}\x{3000}]"
FENCED = r"(?s)```.*?```"

SYSTEM_PROMPT = "You turn infrastructure requests into YAML configurations. Answer with valid YAML only."


def is_blank(c: Column) -> Column:
    """True for null, empty and white text."""
    return ~F.coalesce(c, F.lit("")).rlike(NOT_BLANK)


#: The same blanks as characters.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u3000"


def strip(c: Column) -> Column:
    """Without blanks at both ends; no regular expression, as it runs over whole texts."""
    return F.btrim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """White-separated words; an empty array for blank text, null for null."""
    return F.filter(F.split(c, rf"{BLANK}+"), lambda w: w != "")


def token_estimate(c: Column) -> Column:
    """Characters in complete fenced spans / 3.2 and all others / 4, cut to an integer; null for null."""
    code = F.length(c) - F.length(F.regexp_replace(c, FENCED, ""))
    return ((F.length(c) - code) / F.lit(4.0) + code / F.lit(3.2)).cast("int")


def tail_words(c: Column, n: int) -> Column:
    """The last int(1.3 n) words joined by blanks; empty if the text has no more than that."""
    k = int(n * 1.3)
    w = words(c)
    return F.when(F.size(w) > k, F.array_join(F.slice(w, -k, k), " ") if k else F.lit("")).otherwise("")


def url_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def near_key(c: Column) -> Column:
    """Lower case, punctuation dropped, words sorted: equal for texts that differ in case, marks and word order."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", "")
    return F.array_join(F.array_sort(F.filter(F.split(bare, r"\s+"), lambda w: w != "")), " ")


def tidy(c: Column) -> Column:
    """Three or more newlines to two, then blanks and tabs to one blank, then no blank before punctuation, then stripped."""
    out = F.regexp_replace(c, r"\n{3,}", "\n\n")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ([.,;:!?)])", "$1")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def slug_title(url: Column) -> Column:
    """Last path segment of a url in title case."""
    segment = F.regexp_extract(F.regexp_replace(url, r"/+$", ""), r"([^/]*)$", 1)
    return F.initcap(F.translate(segment, "_-", "  "))


def strip_fence(c: Column) -> Column:
    """Without an opening fence (plain, yaml or yml) and a closing one at the very ends."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(yaml|yml)?", ""), r"```$", ""))


def drop_fence_lines(c: Column) -> Column:
    """Without the whole first line if it opens a fence, and a fence at the end."""
    t = strip(c)
    return F.when(t.startswith("```"), strip(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"```$", ""))).otherwise(t)


def _answer(output: Column) -> Column:
    return F.concat(F.lit("```yaml\n"), output, F.lit("\n```"))


def chat_mistral(instruction: Column, output: Column, system: str = SYSTEM_PROMPT, tagged: bool = False) -> Column:
    """Instruction template with [INST]; ``tagged`` puts the system prompt between SYS tags. Without output it ends open."""
    head = f"<s>[INST] <<SYS>>\n{system}\n<</SYS>>\n\n" if tagged else f"<s>[INST] {system}\n\n"
    opening = F.concat(F.lit(head), instruction, F.lit(" [/INST]\n"))
    return F.when(F.coalesce(output, F.lit("")) == "", opening).otherwise(F.concat(opening, _answer(output), F.lit("</s>")))


def chat_llama3(instruction: Column, output: Column, system: str = SYSTEM_PROMPT) -> Column:
    role = lambda r: f"<|start_header_id|>{r}<|end_header_id|>\n\n"
    opening = F.concat(F.lit(f"<|begin_of_text|>{role('system')}{system}<|eot_id|>{role('user')}"), instruction, F.lit(f"<|eot_id|>{role('assistant')}"))
    return F.when(F.coalesce(output, F.lit("")) == "", opening).otherwise(F.concat(opening, _answer(output), F.lit("<|eot_id|>")))


def chat_chatml(instruction: Column, output: Column, system: str = SYSTEM_PROMPT) -> Column:
    opening = F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), instruction, F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return F.when(F.coalesce(output, F.lit("")) == "", opening).otherwise(F.concat(opening, _answer(output), F.lit("<|im_end|>")))


CHAT = {"mistral": chat_mistral, "llama3": chat_llama3, "chatml": chat_chatml}


def chat(name: str, instruction: Column, output: Column) -> Column:
    """Template by name; ValueError for an unknown one."""
    if name not in CHAT:
        raise ValueError(f"unknown template {name!r}; known: {', '.join(sorted(CHAT))}")
    return CHAT[name](instruction, output)


def context_block(url: Column, hierarchy: Column, content: Column) -> Column:
    """A retrieved chunk as it stands in a prompt; the hierarchy only if there is one."""
    return F.concat(F.lit("[Source: "), url, F.lit("]"), F.when(F.size(hierarchy) > 0, F.concat(F.lit(" ["), F.array_join(hierarchy, " > "), F.lit("]"))).otherwise(""), F.lit("\n"), content)


def error_key(c: Column) -> Column:
    """An error up to its first closing bracket, else its first 80 characters."""
    return F.when(F.instr(c, "]") > 0, F.concat(F.substring_index(c, "]", 1), F.lit("]"))).otherwise(F.substring(c, 1, 80))


def bar(rate: Column, width: int = 10) -> Column:
    return F.repeat(F.lit("█"), (rate * width).cast("int"))


def dir_slug(description: Column) -> Column:
    return F.lower(F.translate(F.substring(description, 1, 30), " ", "-"))


def numbered(items: Column) -> Column:
    """An array as lines '1. first', '2. second'."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def messages(system: str, shots: list[tuple[str, str]], history: Column | None, request: Column) -> Column:
    """array<struct<role, content>>: system prompt, example turns, history, request."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    fixed = [turn("system", F.lit(system))] + [t for q, a in shots for t in (turn("user", F.lit(q)), turn("assistant", F.lit(a)))]
    parts = [F.array(*fixed), *([F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>"))] if history is not None else []), F.array(turn("user", request))]
    return F.concat(*parts)
