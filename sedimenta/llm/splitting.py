"""Problem 6: cutting oversized items at natural boundaries."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

LIMIT, OVERLAP = 1000, 150
#: Depths of valleys that differ by less count as one.
DEPTH_STEP = 0.1
#: Words on each side of a gap whose vocabularies are compared.
BLOCK_WORDS = 80
HARD, SENTENCE, LINE, BLOCK, HEADING = range(5)
KINDS = ("hard", "sentence", "line", "block", "heading")
_FENCED = re.compile(r"```.*?```", re.S)
_SENTENCE = re.compile(r"(?<=[.!?;])[\"')\]]*\s+|(?<=[。！？；])")
_WORD = re.compile(r"[^\W_]+")


def token_estimate(text: str) -> int:
    """Characters in complete fenced spans / 3.2 and all others / 4, cut to an integer."""
    code = sum(len(m) for m in _FENCED.findall(text))
    return int(code / 3.2 + (len(text) - code) / 4)


def token_estimate_column(text: Column) -> Column:
    """The same in Catalyst expressions."""
    code = F.length(text) - F.length(F.regexp_replace(text, r"(?s)```.*?```", ""))
    return (code / F.lit(3.2) + (F.length(text) - code) / F.lit(4.0)).cast("int")


def gaps(text: str) -> list[tuple[int, int]]:
    """Places where a text may be cut, in order: (offset, kind); kind says what begins or ends there."""
    out: list[tuple[int, int]] = []
    at, fenced, blank = 0, False, False
    for line in text.splitlines(keepends=True) if "\r" not in text else re.split(r"(?<=\n)", text):
        bare = line.strip()
        mark = bare.startswith("```")
        if at:
            kind = LINE
            if not fenced:
                kind = HEADING if bare.startswith("#") and bare.lstrip("#")[:1] in ("", " ") else BLOCK if blank or mark else LINE
            out.append((at, kind))
        if not fenced and not mark:
            out += [(at + m.end(), SENTENCE) for m in _SENTENCE.finditer(line) if at + m.end() < at + len(line.rstrip())]
        if mark:
            fenced = not fenced and "```" not in bare[3:]
            blank = not fenced  # a closed fence ends a block
        else:
            blank = not bare
        at += len(line)
    return out


def depths(text: str, places: list[int]) -> list[float]:
    """How deep the similarity of neighbouring blocks dips at each place, against the peaks on both sides."""
    edges = [0, *places, len(text)]
    words = [[w for w in _WORD.findall(text[a:b].lower()) if len(w) > 3] for a, b in zip(edges, edges[1:])]
    sims = []
    left: Counter[str] = Counter()
    right: Counter[str] = Counter()
    lo, hi = 0, 0  # units in left: lo..k, in right: k+1..hi-1
    n_left = n_right = 0
    dot = 0
    for k in range(len(places)):
        for w in words[k]:  # unit k moves to the left block
            if k < hi:
                right[w] -= 1
                dot -= left[w]
                n_right -= 1
            dot += right[w]
            left[w] += 1
            n_left += 1
        hi = max(hi, k + 1)
        while lo < k and n_left - len(words[lo]) >= BLOCK_WORDS:
            for w in words[lo]:
                left[w] -= 1
                dot -= right[w]
            n_left -= len(words[lo])
            lo += 1
        while hi < len(words) and n_right < BLOCK_WORDS:
            for w in words[hi]:
                dot += left[w]
                right[w] += 1
            n_right += len(words[hi])
            hi += 1
        sims.append(dot / math.sqrt(max(1, n_left) * max(1, n_right)))
    rise = sims[:]
    for k in range(1, len(sims)):
        rise[k] = max(sims[k], rise[k - 1]) if sims[k - 1] >= sims[k] else sims[k]
    fall = sims[:]
    for k in range(len(sims) - 2, -1, -1):
        fall[k] = max(sims[k], fall[k + 1]) if sims[k + 1] >= sims[k] else sims[k]
    return [rise[k] + fall[k] - 2 * s for k, s in enumerate(sims)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """Pieces (from, start, end, kind): text[start:end] is new, text[from:start] repeats the piece before.

    New parts are contiguous and give the whole text; every piece has at most
    ``limit`` tokens.  Boundaries are the beginnings of headings, blocks, lines
    and sentences.  Of those in the second half of the room that is left, the cut
    goes to the deepest valley of lexical cohesion; valleys of about one depth
    (DEPTH_STEP) are told apart by the kind of boundary, then the later counts.
    Without any, the cut goes to the last boundary before; without that, to the
    last blank or, at worst, to the last character that fits.  No step looks
    further ahead than a piece is long, so the work is linear in the text.
    """
    if token_estimate(text) <= limit:
        return [(0, 0, len(text), HEADING)]
    marks = gaps(text)
    places = [p for p, _ in marks]
    deep = depths(text, places)
    out: list[tuple[int, int, int, int]] = []
    start = since = i = 0
    while True:
        while i < len(places) and places[i] <= start:
            i += 1
        if len(text) - since <= (limit + 1) * 4 and token_estimate(text[since:]) <= limit:
            out.append((since, start, len(text), HEADING))
            return out
        room = since + int(limit * 4)  # no piece can be longer than this
        cands = []
        j = i
        while j < len(places) and places[j] <= room:
            cands.append(j)
            j += 1
        half = start + (room - start) // 2
        order = sorted((k for k in cands if places[k] >= half), key=lambda k: (-int(deep[k] / DEPTH_STEP), -marks[k][1], -deep[k], -places[k]))
        order += [k for k in reversed(cands) if places[k] < half]
        end, kind = next(((places[k], marks[k][1]) for k in order if token_estimate(text[since : places[k]]) <= limit), (0, HARD))
        if end <= start:
            lo, hi = start + 1, min(room, len(text))
            while lo < hi:  # tokens grow with the end but for fences that close; the result is checked below
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if token_estimate(text[since:mid]) <= limit else (lo, mid - 1)
            end = lo
            space = max(text.rfind(" ", start + 1, end), text.rfind("\t", start + 1, end))
            if space > start + (end - start) // 2:
                end = space + 1
            while end > start + 1 and token_estimate(text[since:end]) > limit:
                end -= 1
            if token_estimate(text[since:end]) > limit and since < start:
                since = start
                continue
        out.append((since, start, end, kind))
        # overlap: the longest tail of whole lines or sentences, else of words, that fits
        least = end - int(overlap * 4)
        near = places[bisect_left(places, max(least, start)) : bisect_left(places, end)]
        tails = [p for p in near if token_estimate(text[p:end]) <= overlap] if overlap > 0 else []
        if tails:
            since = tails[0]
        elif overlap > 0:
            since = max(start + 1, end - int(overlap * 3.2))
            space = text.find(" ", since, end)
            since = space + 1 if space >= 0 else since
        else:
            since = end
        start = end


PIECES = "kind string, item_id bigint, piece int, start_char int, end_char int, overlap_chars int, tokens int, ends_at string, content string"


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """items(kind, item_id, content) -> the pieces of every item of more than ``limit`` tokens.

    A piece's content repeats up to ``overlap`` tokens of the one before and goes
    on to end_char.  Items within the limit, null contents and null ids give no
    row; repeated ids are cut each on its own.  Tokens are always recomputed.
    Only texts that can be oversized leave the JVM.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, item, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                rows = [(kind, item, n, b, c, b - a, token_estimate(text[a:c]), KINDS[k], text[a:c]) for n, (a, b, c, k) in enumerate(split_text(text, limit, overlap))]
                kinds = [pa.string(), pa.int64(), *[pa.int32()] * 5, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in PIECES.split(", ")])

    long = items.filter("item_id is not null").filter(F.length("content") >= math.floor((limit + 1) * 3.2))
    return long.filter(token_estimate_column(F.col("content")) > limit).select("kind", F.col("item_id").cast("bigint"), "content").mapInArrow(run, PIECES)


def page_and_chunk_items(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    return pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("item_id"), "content").unionByName(chunks.select(F.lit("chunk").alias("kind"), F.col("chunk_row").alias("item_id"), "content"))
