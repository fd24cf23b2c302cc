"""Problem 8: passages of held-out test items inside a corpus."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

WORD = re.compile(r"[^\W_]+")
#: Characters of the item texts of one automaton (some 50 MB of patterns); larger item tables are stated queries in blocks.
BLOCK_CHARS = 5_000_000
_BUILT: dict[str, object] = {}

FOUND = "doc_id bigint, item_id bigint, start_char int, end_char int, words int"


def windows(text: str | None, least: int) -> list[str]:
    """All runs of ``least`` words of a normalised text, blanks around."""
    w = WORD.findall((text or "").lower())
    return [" " + " ".join(w[i : i + least]) + " " for i in range(len(w) - least + 1)]


def leaked_items(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_texts: tuple[str, ...] = ("prompt",), least: int = 10) -> DataFrame:
    """One row per document, item and merged passage: (doc_id, item_id, start_char, end_char, words).

    Method: one Aho-Corasick automaton over all runs of ``least`` words of the
    normalised item texts; each document is normalised (lower case, words joined
    by blanks) and run through it once; overlapping hits of an item merge and
    their offsets are mapped back to the original text.  An automaton holds items
    of about BLOCK_CHARS characters (checked by a sum), which bounds what is sent
    to a worker; a larger item table is cut into blocks that are run one by one.

    Item texts of fewer than ``least`` words and null texts match nothing; null
    or empty documents and null ids give no row.  Items with equal text are all
    reported.  Repeated documents are reported each.
    """
    named = items.select(F.col(item_id).cast("bigint").alias("item_id"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(item_texts)]).filter("item_id is not null")
    size = F.sum(sum((F.coalesce(F.length(f"t{i}"), F.lit(0)) for i in range(len(item_texts))), F.lit(0)))
    blocks = max(1, -(-(named.agg(size).first()[0] or 0) // BLOCK_CHARS))
    out = None
    for k in range(blocks):
        own = named if blocks == 1 else named.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        part = _scan(documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null"), own, least)
        out = part if out is None else out.unionByName(part)
    return out


def _scan(documents: DataFrame, items: DataFrame, least: int) -> DataFrame:
    patterns: dict[str, list[int]] = {}
    for item, *texts in items.toLocalIterator():
        for t in texts:
            for p in windows(t, least):
                own = patterns.setdefault(p, [])
                if item not in own:
                    own.append(item)
    sent, key = documents.sparkSession.sparkContext.broadcast(patterns), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if key not in _BUILT:
            _BUILT.clear()
            machine = ahocorasick.Automaton()
            for p, own in sent.value.items():
                machine.add_word(p, (len(p), own))
            machine.make_automaton()
            _BUILT[key] = machine
        machine = _BUILT[key]
        for batch in batches:
            rows: list[tuple[int, int, int, int, int]] = []
            if len(machine):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    normal = " " + " ".join(WORD.findall(text.lower())) + " "
                    hits = [(end - n + 1, end, item) for end, (n, own) in machine.iter(normal) for item in own]
                    if hits:
                        rows += [(doc, *x) for x in _passages(text, normal, hits)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "start_char", "end_char", "words"])

    return documents.mapInArrow(run, FOUND)


def _passages(text: str, normal: str, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(item, start, end, words) of merged hits; hits are ranges of the normalised text, bounded by blanks."""
    low = text.lower()
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        place = lambda i: i
    else:  # lower case changed the length: walk the characters once
        back = [i for i, ch in enumerate(text) for _ in ch.lower()] + [len(text)]
        place = back.__getitem__
    word_at, n = {}, 0
    for i, ch in enumerate(normal):
        if ch == " ":
            word_at[i] = n
            n += 1
    merged: dict[int, list[list[int]]] = {}
    for start, end, item in sorted(hits):
        a, b = word_at[start], word_at[end]  # words a to b - 1
        own = merged.setdefault(item, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return [(item, place(spans[a][0]), place(spans[b - 1][1] - 1) + 1, b - a) for item, own in merged.items() for a, b in own]
