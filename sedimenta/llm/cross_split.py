"""Problem 5: records of the held-out splits that also stand, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.staging import staged
from .alike import COLD, THRESHOLD, Prefixes, cross_members, may_match, meetings, pair_text, scan, sketch_of, verify
from .kernel import slices
from .sketch import FLAG_A, FLAG_B, LEVEL, Shared, cell_of

#: Words of a suffix that are kept for sorting and comparing beyond its first three, fifteen bits each.
TAIL = 4
BOTH = FLAG_A | FLAG_B
SUFFIX = "gram bigint, tail bigint, sig bigint, side int, start int, n int, pos int, p0 bigint, p1 bigint, hot boolean"


def split_side(split: str = "split"):
    """0 for train, 1 for eval and test, null for anything else; case and surrounding blanks don't count."""
    name = F.lower(F.trim(F.regexp_replace(F.col(split), r"[\s\x{00A0}]+", " ")))
    return F.when(name == "train", 0).when(name.isin("eval", "test"), 1)


def suffixes(rows: DataFrame, cells: np.ndarray, threshold: float) -> DataFrame:
    """The suffixes (SUFFIX) that begin at the rarest triples of every record that may have a partner on the other side.

    A record that is alike to one of the other side has at least the threshold's
    share of its distinct triples there, so a record with fewer triples that
    occur on both sides (by the sketch, which may count some too many) is left
    out; so are suffixes whose triple occurs on one side only.
    """
    t = Fraction(str(threshold))
    shared = Shared(rows.sparkSession, cells)
    names = [f.split()[0] for f in SUFFIX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sides = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(texts):
                p = Prefixes(texts[a:b], sk, t, seen, sides[a:b])
                crossing = np.bincount(p.all_text[(cell_of(sk, p.all_gram) & BOTH) == BOTH], minlength=b - a)
                covered = crossing * t.denominator >= p.n * t.numerator
                ok = covered[p.text] & ((p.cell & BOTH) == BOTH)
                if not ok.any():
                    continue
                text, gram, w = p.text[ok], p.gram[ok], p.words
                # first place of each triple in its record
                key = (w.text[p.first].astype(np.uint64) << np.uint64(40)) | p.raw
                order = np.argsort(key, kind="stable")
                at = p.first[order[np.searchsorted(key[order], (text.astype(np.uint64) << np.uint64(40)) | gram)]]
                place = at[:, None] + np.arange(3, 3 + TAIL)
                ends = np.searchsorted(w.text, np.arange(b - a), side="right")[text]
                word = np.where(place < ends[:, None], (w.hash[np.minimum(place, len(w.hash) - 1)] >> np.uint64(49)) | np.uint64(1), np.uint64(0))
                tail = np.zeros(len(at), dtype=np.uint64)
                for k in range(TAIL):
                    tail = (tail << np.uint64(15)) | word[:, k]
                start = at - np.searchsorted(w.text, text)
                cols = [gram.view(np.int64), tail.view(np.int64), p.sig[text], sides[a:b][text].astype(np.int32), start.astype(np.int32), p.n[text].astype(np.int32), p.pos[ok].astype(np.int32), p.p0[ok], p.p1[ok], (p.cell[ok] & LEVEL) > COLD]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return rows.select("row_id", "text", "side").mapInArrow(run, SUFFIX)


def common_prefix(a: Column, b: Column) -> Column:
    """Words that two suffixes of one run have in common: their first three and the equal ones at the head of their tails."""
    out = F.lit(3)
    for k in range(1, TAIL + 1):
        shift = 15 * (TAIL - k)
        x, y = F.shiftright(a, shift), F.shiftright(b, shift)
        out = F.when((x == y) & (x.bitwiseAND(F.lit(32767)) > 0), F.lit(3 + k)).otherwise(out)
    return out


def cross_split_overlaps(records: DataFrame, id_col: str = "row_id", instruction: str = "instruction", output: str = "output", split: str = "split", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Overlaps between train and held-out records: (rows, links).

    rows: row_id, side (0 train, 1 held out), sig (class of equal texts); one
    row per record of either side with at least three words.
    links: sig_a, sig_b, similarity, cover_a, cover_b, longest; one row per pair
    of alike classes (a class with itself where both sides hold copies); cover is
    the share of a text's words in spans shared with the other, longest the words
    of the longest common prefix by which the pair was found.

    Method: a sparse suffix array.  The suffixes that begin at a record's rarest
    triples (of which alike records always share one) are partitioned by their
    first three words and sorted by those that follow.  Suffixes of different
    splits in one run of common prefixes reveal a shared span, its length being
    their longest common prefix; the pairs so found are compared in full, their
    common spans merge into coverage, and their similarity is checked exactly.
    A full array is out of reach: see README.

    Null splits and other names belong to no side.  Null or empty texts overlap
    nothing.  Copies are compared once, as a class.
    """
    rows = records.select(F.col(id_col).cast("bigint").alias("row_id"), pair_text(instruction, output).alias("text"), split_side(split).alias("side"))
    rows = rows.filter("row_id is not null and side is not null")
    signs, parts, bits = scan(rows)
    array = suffixes(rows, sketch_of(parts, bits, True), threshold)
    match = lambda a, b: (a("side") != b("side")) & may_match(a, b, threshold)
    met = meetings(array, ["gram"], ["tail", "sig", "side", "start", "n", "pos", "p0", "p1"], match, "suffix-runs", ["gram", "sig", "side"])
    x, y = F.col("a.sig"), F.col("b.sig")
    pairs = met.filter(x != y).groupBy(F.least(x, y).alias("sig_a"), F.greatest(x, y).alias("sig_b")).agg(F.max(common_prefix(F.col("a.tail"), F.col("b.tail"))).alias("longest"))
    pairs = staged(pairs, "span-pairs")
    near = verify(rows, signs, pairs.select("sig_a", "sig_b"), threshold, "overlaps", coverage=True).join(pairs, ["sig_a", "sig_b"])
    held = signs.filter("n > 0")
    same = held.groupBy("sig").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.first("n").alias("n")).filter("lo <> hi")
    one = F.lit(1.0)
    exact = same.select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"), one.alias("similarity"), one.alias("cover_a"), one.alias("cover_b"), (F.col("n") + 2).alias("longest"))
    return held.select("row_id", "side", "sig"), near.unionByName(exact)


def overlap_pairs(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Pairs of a train and a held-out row whose texts are alike, the smaller id first."""
    either = links.select(F.col("sig_a").alias("t"), F.col("sig_b").alias("h")).unionByName(links.filter("sig_a <> sig_b").select(F.col("sig_b").alias("t"), F.col("sig_a").alias("h")))
    train = rows.filter("side = 0").select(F.col("sig").alias("t"), F.col("row_id").alias("x"))
    held = rows.filter("side = 1").select(F.col("sig").alias("h"), F.col("row_id").alias("y"))
    both = cross_members(either, train, held).select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
    return both.filter("row_id_a < row_id_b").distinct()


def overlap_report(records: DataFrame, source: str = "source") -> DataFrame:
    """Held-out and train rows with an overlap, counted per split and source, with the mean of their best coverage."""
    rows, links = cross_split_overlaps(records)
    links = staged(links, "overlap-links")
    a = links.select(F.col("sig_a").alias("sig"), F.col("sig_b").alias("other"), F.col("cover_a").alias("cover"))
    b = links.filter("sig_a <> sig_b").select(F.col("sig_b").alias("sig"), F.col("sig_a").alias("other"), F.col("cover_b").alias("cover"))
    sides = rows.select(F.col("sig").alias("other"), F.col("side").alias("facing")).distinct()
    best = a.unionByName(b).join(sides, "other").groupBy("sig", (1 - F.col("facing")).alias("side")).agg(F.max("cover").alias("cover"))
    hit = rows.join(best, ["sig", "side"]).select("row_id", "cover")
    names = records.select(F.col("row_id"), F.lower(F.trim("split")).alias("split"), F.col(source).alias("source"))
    return (
        names.join(hit, "row_id")
        .groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("overlapping_rows"), F.round(F.avg("cover"), 6).alias("mean_coverage"))
    )
