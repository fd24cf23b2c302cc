"""Pages to chunks: a page is one row from its text to its chunks, so nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, strip, tail_words, token_estimate
from ..plans.staging import spread

TARGET, OVERLAP, SMALL = 1000, 150, 100
_CUT, _END = "\u0001", "\u0002"
_TEXT_PART = "array<struct<heading:string,body:string>>"


def split_headings(c: Column, level: int) -> Column:
    """array<struct<heading, body>> at headings of one level; without any, the whole text under a null heading.

    Bodies are stripped; text before the first heading is kept unless blank.
    Headings inside fences count as headings too.
    """
    marked = F.split(F.regexp_replace(c, rf"(?dm)^#{{{level}}}\s+(.+)$", f"{_CUT}$1{_END}"), _CUT)
    head = lambda p: strip(F.substring_index(p, _END, 1))
    body = lambda p: strip(F.substring_index(p, _END, -1))
    pre = F.array(F.struct(F.lit(None).cast("string").alias("heading"), strip(marked[0]).alias("body")))
    rest = F.transform(F.slice(marked, 2, F.size(marked)), lambda p: F.struct(head(p).alias("heading"), body(p).alias("body")))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("heading"), c.alias("body")))
    return F.when(F.size(marked) <= 1, whole).when(is_blank(marked[0]), rest).otherwise(F.concat(pre, rest))


def split_blocks(c: Column) -> Column:
    """array<string>: paragraphs, and each fenced part (with its fences, to the end if it stays open) as one block."""
    parts = F.split(F.regexp_replace(c, r"(?dm)^([ \t]*```[^\n]*)$", f"{_CUT}$1{_CUT}"), _CUT)
    at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    prose = lambda p: F.split(p, r"\n\s*\n")
    pieces = F.transform(parts, lambda p, i: F.when(i % 4 == 0, prose(p)).when(i % 4 == 1, F.array(F.concat(p, at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<string>")))
    return F.filter(F.transform(F.flatten(pieces), lambda b: F.regexp_replace(b, r"^[\n ]+|\s+$", "")), lambda b: ~is_blank(b))


def pack_groups(tokens: Column, target: int = TARGET) -> Column:
    """array<int>: the group of each block; a group is closed when the next block would exceed the target. A larger block stands alone."""
    zero = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        new = (s["cur"] > 0) & (s["cur"] + t > target)
        group = s["group"] + F.when(new, 1).otherwise(0)
        return F.struct(F.when(new, t).otherwise(s["cur"] + t).alias("cur"), group.alias("group"), F.concat(s["out"], F.array(group)).alias("out"))

    return F.aggregate(tokens, zero, step, lambda s: s["out"])


def pack_blocks(blocks: Column, target: int = TARGET) -> Column:
    """array<string>: blocks joined by blank lines up to the target."""
    groups = pack_groups(F.transform(blocks, token_estimate), target)
    both = F.arrays_zip(groups.alias("g"), blocks.alias("b"))
    join = lambda g: F.array_join(F.transform(F.filter(both, lambda x: x["g"] == g), lambda x: x["b"]), "\n\n")
    return F.when(F.size(blocks) > 0, F.transform(F.sequence(F.lit(0), F.array_max(groups)), join)).otherwise(F.array().cast("array<string>"))


_CHUNK = "array<struct<text:string,path:array<string>>>"


def _chunk(text: Column, path: Column) -> Column:
    return F.struct(text.alias("text"), path.cast("array<string>").alias("path"))


def merge_small(chunks: Column, least: int = SMALL) -> Column:
    """Each chunk below ``least`` tokens that has a successor is joined with it, once; the longer path stays."""
    n = F.size(chunks)
    start = F.struct(F.lit(False).alias("skip"), F.array().cast(_CHUNK).alias("out"))

    def step(s: Column, i: Column) -> Column:
        own, after = F.get(chunks, i), F.get(chunks, i + 1)
        small = (token_estimate(own["text"]) < least) & (i + 1 < n)
        longer = F.when(F.size(after["path"]) > F.size(own["path"]), after["path"]).otherwise(own["path"])
        joined = _chunk(F.concat(own["text"], F.lit("\n\n"), after["text"]), longer)
        return F.when(s["skip"], F.struct(F.lit(False).alias("skip"), s["out"].alias("out"))).otherwise(
            F.struct(small.alias("skip"), F.concat(s["out"], F.array(F.when(small, joined).otherwise(own))).alias("out"))
        )

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), start, step, lambda s: s["out"])).otherwise(F.array().cast(_CHUNK))


def add_overlap(chunks: Column, overlap: int = OVERLAP) -> Column:
    """Each chunk after the first begins with the last words of the one before (as it was without overlap)."""
    if overlap <= 0:
        return chunks
    tail = lambda i: tail_words(F.get(chunks, i - 1)["text"], overlap)
    return F.transform(chunks, lambda c, i: F.when((i == 0) | (tail(i) == ""), c).otherwise(_chunk(F.concat(F.lit("[...] "), tail(i), F.lit("\n\n"), c["text"]), c["path"])))


_FENCED = re.compile(r"```.*?```", re.S)
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u3000"


def _tokens(text: str) -> int:
    code = sum(map(len, _FENCED.findall(text)))
    return int((len(text) - code) / 4.0 + code / 3.2)


def _by_heading(text: str, level: int) -> list[tuple[str | None, str]]:
    marks = list(re.finditer(rf"^#{{{level}}}\s+(.+)$", text, re.M))
    if not marks:
        return [(None, text)]
    out = [(None, text[: marks[0].start()].strip(_BLANKS))] if text[: marks[0].start()].strip(_BLANKS) else []
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return out + [(m.group(1).strip(_BLANKS), text[m.end() : e].strip(_BLANKS)) for m, e in zip(marks, ends)]


def _blocks(text: str) -> list[str]:
    out: list[str] = []
    part: list[str] = []
    fenced = False

    def close() -> None:
        block = "\n".join(part)
        out.extend([block] if fenced else re.split(r"\n\s*\n", block))
        part.clear()

    for line in text.split("\n"):
        if line.lstrip(" \t").startswith("```"):
            if fenced:
                part.append(line)
                close()
                fenced = False
            else:
                close()
                part.append(line)
                fenced = True
        else:
            part.append(line)
    close()
    return [b for b in (x.lstrip("\n ").rstrip() for x in out) if b.strip(_BLANKS)]


def chunk_text(content: str, title: str | None, target: int = TARGET, overlap: int = OVERLAP, small: int = SMALL) -> list[tuple[str, list[str]]]:
    """(text, path) of a page's chunks: sections, split deeper or packed where too large, small ones merged, overlapped."""
    cuts: list[tuple[str, list[str]]] = []
    for h2, body in _by_heading(content, 2):
        whole = f"## {h2}\n{body}" if h2 else body
        if _tokens(whole) <= target:
            cuts.append((whole, [x for x in (title, h2) if x]))
            continue
        for h3, part in _by_heading(body, 3):
            path = [x for x in (title, h2, h3) if x]
            part = f"### {h3}\n{part}" if h3 else part
            if _tokens(part) <= target:
                cuts.append((part, path))
                continue
            room, group = 0, []
            for b in _blocks(part):
                n = _tokens(b)
                if room and room + n > target:
                    cuts.append(("\n\n".join(group), path))
                    room, group = 0, []
                room += n
                group.append(b)
            if group:
                cuts.append(("\n\n".join(group), path))
    cuts = [c for c in cuts if c[0].strip(_BLANKS)]
    merged, i = [], 0
    while i < len(cuts):
        text, path = cuts[i]
        if _tokens(text) < small and i + 1 < len(cuts):
            after = cuts[i + 1]
            merged.append((text + "\n\n" + after[0], after[1] if len(after[1]) > len(path) else path))
            i += 1
        else:
            merged.append((text, path))
        i += 1
    k = int(overlap * 1.3)
    out = merged[:1]
    for (before, _), (text, path) in zip(merged, merged[1:]):
        w = before.split()
        out.append((f"[...] {' '.join(w[-k:])}\n\n{text}" if overlap > 0 and len(w) > k else text, path))
    return out


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, small: int = SMALL) -> DataFrame:
    """pages(url, title, section, section_label, content, url_hash, breadcrumb) -> chunk rows in page order.

    A page stays one row until its chunks are out, so nothing is shuffled.  The
    nested folds are one Arrow-batched function: written as nested array
    expressions they are evaluated again for every use (223 s for 300 pages).
    Pages with null or blank content give none.
    """
    kept = pages.filter(~is_blank(F.col("content"))).select(
        "url", "title", "section", "section_label", "breadcrumb", "content", F.coalesce("url_hash", F.substring(F.sha2("url", 256), 1, 16)).alias("hash")
    )
    schema = "chunk_id string, content string, source_url string, source_title string, section string, section_label string, token_count int, heading_hierarchy array<string>, breadcrumb array<string>, has_code boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.string()] * 6 + [pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
        for batch in batches:
            rows = []
            for url, title, section, label, crumbs, content, key in zip(*(batch.column(i).to_pylist() for i in range(7))):
                for n, (text, path) in enumerate(chunk_text(content, title, target, overlap, small)):
                    rows.append((f"{key}_{n:03d}", text.strip(_BLANKS), url, title, section, label, _tokens(text), path, crumbs, "```" in text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kind)], names=[f.split()[0] for f in schema.split(", ")])

    return spread(kept).mapInArrow(run, schema)


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """Flat metadata of chunks: primitives only, the hierarchy as one string."""
    return chunks.select("chunk_id", "source_url", "source_title", "section", "section_label", "token_count", F.array_join("heading_hierarchy", " > ").alias("heading_hierarchy"), "has_code")


def chunk_stats(chunks: DataFrame) -> DataFrame:
    n, tokens = F.count(F.lit(1)), F.coalesce(F.sum(F.col("token_count").cast("bigint")), F.lit(0))
    return chunks.agg(n.alias("chunks"), tokens.alias("tokens"), F.floor(tokens / F.greatest(n, F.lit(1))).alias("avg_tokens"), F.count_if(F.coalesce("has_code", F.lit(False))).alias("code_chunks"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))
