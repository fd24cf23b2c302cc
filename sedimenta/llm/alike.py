"""Shared ground of the operators that compare records by word triples.

Two texts are alike if their sets of distinct three-word sequences overlap by a
Jaccard share of at least a threshold.  Texts with equal sets form a *class*,
known by a 64-bit signature of the set (chance of any two of 10**8 classes
falling together: below 0.03 %), and every later step works on classes: a group
of exact copies, however large, is one class.

``scan``      one pass: signature of each row, and a count sketch of the triples
``postings``  second pass: each class's rarest triples (the prefix that any alike
              pair must share one of), with length, position and parity bits of
              what follows them
``verify``    exact Jaccard of candidate pairs, each once
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.staging import bounded, discard, staged
from .kernel import Words, bounds, distinct, mix, pack, paragraphs, slices, triples, unpack
from .sketch import FLAG_A, FLAG_B, LEVEL, Shared, SketchWriter, cell_of, keep_ids, level, merge_sketch, sketch_bits

THRESHOLD = 0.7
#: Rows of one key that one task looks at together; longer runs go through block pairs.
RUN = 256


def pair_text(instruction: str = "instruction", output: str = "output") -> Column:
    return F.concat(F.coalesce(F.col(instruction), F.lit("")), F.lit(" "), F.coalesce(F.col(output), F.lit("")))


def signature(text: np.ndarray, gram: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit signature of each text's set of grams, and the set's size."""
    cut = bounds(text, n_texts)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(gram + np.uint64(0xD6E8FEB86659FD93)), dtype=np.uint64)])
    n = np.diff(cut)
    return mix((sums[cut[1:]] - sums[cut[:-1]]) + n.astype(np.uint64)).view(np.int64), n


SCAN = "row_id bigint, sig bigint, n int, side int, part int, data binary"


def scan(rows: DataFrame, lines: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """rows(row_id, text, side): staged frames of signatures (row_id, sig, n, side) and of sketch records, and the sketch's bits.

    With ``lines`` the sketch also counts the hashes of whole lines, once a row.
    """
    bits = sketch_bits(rows.agg(F.sum(F.length("text"))).first()[0] or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers = {0: SketchWriter(bits), 1: SketchWriter(bits)}

        def sketches(side: int, records: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            if records:
                m = len(records)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.array([side] * m, pa.int32()), pa.array([k for k, _ in records], pa.int32()), pa.array([d for _, d in records], pa.binary())],
                    names=["row_id", "sig", "n", "side", "part", "data"],
                )

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            sides = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in slices(texts):
                w = Words(texts[a:b])
                first, gram = triples(w)
                text, gram = distinct(w.text[first], gram)
                sig, n = signature(text, gram, b - a)
                m = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b]), pa.array(sig), pa.array(n.astype(np.int32)), pa.array(sides[a:b].astype(np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names=["row_id", "sig", "n", "side", "part", "data"],
                )
                # copies of a class inside a batch count once, so that large groups of copies don't blur the counts
                once = np.zeros(m, dtype=bool)
                once[np.unique(sig ^ sides[a:b].astype(np.int64), return_index=True)[1]] = True
                for s in (0, 1):
                    own = (once & (sides[a:b] == s))[text]
                    yield from sketches(s, writers[s].add(gram[own]))
                if lines:
                    _, line = distinct(*paragraphs(w)[:2])
                    yield from sketches(0, writers[0].add(line))
        for s in (0, 1):
            yield from sketches(s, writers[s].flush())

    made = rows.select("row_id", "text", "side").mapInArrow(run, SCAN).withColumn("sketch", F.col("part").isNotNull().cast("int"))
    out = staged(made, "scan", partition_by=["sketch"])
    signs, parts = out.filter("sketch = 0").select("row_id", "sig", "n", "side"), out.filter("sketch = 1").select("part", "data", "side")
    folders = {f.rsplit("/", 1)[0] for f in out.inputFiles()}
    own = [f for f in folders if f.endswith("/sketch=1")]
    if own:  # read as a table of its own, so that it can be deleted
        parts = rows.sparkSession.read.schema("part int, data binary, side int").parquet(own[0])
    return signs, parts, bits


def prefix_length(n: np.ndarray, t: Fraction) -> np.ndarray:
    """So many rarest elements of a set suffice: a set that is alike shares at least one of them."""
    return np.where(n > 0, n - (-(-n * t.numerator // t.denominator)) + 1, 0)


def suffix_parity(gram: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For grams in set order, 128 parity bits of those that follow in the same set (last: index of the set's last gram).

    The bits in which two suffixes differ never exceed the size of their symmetric difference.
    """
    bit = mix(gram * np.uint64(0x2545F4914F6CDD1D)) & np.uint64(127)
    one = np.uint64(1) << (bit & np.uint64(63))
    out = []
    for half in (bit < 64, bit >= 64):
        run = np.bitwise_xor.accumulate(np.where(half, one, np.uint64(0)))
        out.append((run[last] ^ run).view(np.int64))
    return out[0], out[1]


class Prefixes:
    """Of a slice of texts the classes that are new to the task, and their rarest triples.

    Order of triples: rare first by the sketch's level, then by hash.  ``text``,
    ``gram``, ``cell``, ``pos``, ``p0``, ``p1`` have an entry per class and triple
    of its prefix, ``all_text`` and ``all_gram`` one per class and triple.
    """

    def __init__(self, texts: list[str], cells: np.ndarray, t: Fraction, seen: set, sides: np.ndarray | None = None):
        self.words = w = Words(texts)
        self.first, self.raw = triples(w)
        text, gram = distinct(w.text[self.first], self.raw)
        self.sig, self.n = signature(text, gram, len(texts))
        keys = zip(self.sig.tolist(), (np.zeros(len(texts), dtype=int) if sides is None else sides).tolist())
        self.fresh = np.array([k not in seen and not seen.add(k) for k in keys], dtype=bool) & (self.n > 0)
        keep = self.fresh[text]
        self.all_text, self.all_gram = text[keep], gram[keep]
        cell = cell_of(cells, self.all_gram)
        elsewhere = np.bincount(self.all_text[(cell & LEVEL) > 1], minlength=len(texts))
        #: whether enough of a class's triples occur in other classes for it to be alike to any
        self.able = elsewhere * t.denominator >= self.n * t.numerator
        key = (self.all_text.astype(np.uint64) << np.uint64(46)) | ((cell & LEVEL).astype(np.uint64) << np.uint64(40)) | self.all_gram
        order = np.argsort(key)
        text, gram, cell = self.all_text[order], self.all_gram[order], cell[order]
        at = bounds(text, len(texts))
        pos = np.arange(len(text)) - at[text]
        p0, p1 = suffix_parity(gram, at[text + 1] - 1) if len(text) else (pos, pos)
        inside = pos < prefix_length(self.n, t)[text]
        self.text, self.gram, self.cell, self.pos, self.p0, self.p1 = (x[inside] for x in (text, gram, cell, pos, p0, p1))


#: Highest sketch level at which a triple surely has no more than about RUN classes.
COLD = int(level(np.array([RUN]))[0])
POSTING = "gram bigint, sig bigint, side int, n int, pos int, p0 bigint, p1 bigint, hot boolean"


def postings(rows: DataFrame, cells: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """A row per class (in each task) and prefix triple that may occur elsewhere.

    Triples that the sketch knows to be single can't lead to a partner and are
    left out after the prefix is cut, and so are classes with too few others: an
    alike partner holds the threshold's share of them.  ``hot``: more than RUN classes may have it.
    """
    t = Fraction(str(threshold))
    shared = Shared(rows.sparkSession, cells)
    names = [f.split()[0] for f in POSTING.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sk = shared.value
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sides = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in slices(texts):
                p = Prefixes(texts[a:b], sk, t, seen, sides[a:b])
                lev = p.cell & LEVEL
                ok = (lev > 1) & p.able[p.text]
                if not ok.any():
                    continue
                text = p.text[ok]
                cols = [p.gram[ok].view(np.int64), p.sig[text], sides[a:b][text].astype(np.int32), p.n[text].astype(np.int32), p.pos[ok].astype(np.int32), p.p0[ok], p.p1[ok], lev[ok] > COLD]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return rows.select("row_id", "text", "side").mapInArrow(run, POSTING)


def least_overlap(n: Column, m: Column, threshold: float) -> Column:
    """Common triples that two sets of n and m need."""
    t = Fraction(str(threshold))
    return F.ceil((n + m) * F.lit(t.numerator) / F.lit(t.numerator + t.denominator) - F.lit(1e-9))


def may_match(a: Callable[[str], Column], b: Callable[[str], Column], threshold: float) -> Column:
    """Length, positional and suffix filter for a pair that meets in a prefix triple.

    Length: the smaller set has at least the threshold's share of the larger.
    Position: the common triple and all that can follow it reach the overlap
    needed.  Suffix: what follows the common triple in both sets has to hold the
    rest of that overlap; parity bits of the two suffixes bound their difference
    from below.  Both are true at a pair's first common triple, so no alike pair
    is lost.
    """
    t = Fraction(str(threshold))
    need = least_overlap(a("n"), b("n"), threshold)
    length = F.least(a("n"), b("n")) * t.denominator >= F.greatest(a("n"), b("n")) * t.numerator
    left, right = a("n") - a("pos") - 1, b("n") - b("pos") - 1
    position = F.lit(1) + F.least(left, right) >= need
    differ = F.bit_count(a("p0").bitwiseXOR(b("p0"))) + F.bit_count(a("p1").bitwiseXOR(b("p1")))
    return length & position & (differ <= left + right - 2 * (need - 1))


def meetings(post: DataFrame, keys: list[str], fields: list[str], match: Callable, name: str, distinct_on: list[str]) -> DataFrame:
    """Pairs (struct a, struct b) of rows that share ``keys`` and satisfy match(a, b), each orientation once.

    post has a boolean ``hot``: keys without it have few rows (about RUN) and meet
    in one shuffle, each row looking back on the others.  Rows of hot keys are
    dealt out one by one in the same shuffle, their keys are counted by partial
    sums, and each is cut into blocks whose pairs are joined on any number of
    tasks: no task ever holds a hot key whole and no pair is lost.  fields[0]
    orders rows inside a key and has to be unique there.
    """
    own = F.when(F.col("hot"), F.xxhash64(*distinct_on)).otherwise(F.lit(0))
    flat = post.withColumn("own", own).repartition(*[F.col(k) for k in keys], F.col("own")).dropDuplicates([*distinct_on, "own"])
    item = F.struct(*fields)
    back = Window.partitionBy(*keys, "own").orderBy(*fields).rowsBetween(Window.unboundedPreceding, -1)
    looked = (
        flat.withColumn("prev", F.when(~F.col("hot"), F.collect_list(item).over(back)))
        .withColumn("a", F.when(~F.col("hot"), F.filter("prev", lambda p: match(lambda c: p[c], lambda c: F.col(c)))))
        .filter(F.col("hot") | (F.size("a") > 0))
        .select(*keys, item.alias("b"), F.explode_outer("a").alias("a"), "hot")
    )
    kept = staged(looked, name)
    cold = kept.filter("not hot").select(*keys, "a", "b")
    rest = kept.filter("hot").select(*keys, "b")
    if rest.isEmpty():
        return cold
    return cold.unionByName(block_pairs(counted(rest, keys), keys, "b", match))


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with ``cnt``, how many share their keys; keys of single rows drop out.  Counts combine before the shuffle."""
    sizes = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "key-sizes")
    return rows.join(bounded(sizes), keys)


def flag_hot(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (staged) with ``hot``: whether more than RUN of them share their keys."""
    many = staged(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > RUN).select(*keys, F.lit(True).alias("hot")), "hot-keys")
    if many.isEmpty():
        return rows.withColumn("hot", F.lit(False))
    return rows.join(bounded(many), keys, "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def block_pairs(rows: DataFrame, keys: list[str], item: str, match: Callable | None = None, block: int = RUN) -> DataFrame:
    """All pairs of items of one key (a before b by their fields), keys of any size: rows(keys..., cnt, item).

    A key of c rows is cut into c / block parts and each pair of parts is a join
    key of its own, so the work of a key spreads over tasks.  A row is copied
    once for each part of its key.
    """
    parts = F.ceil(F.col("cnt") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64(F.col(item)), parts).cast("int")
    many = rows.withColumn("parts", parts).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.select(*keys, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.col("own").alias("own"), F.col(item))
    on = [*keys, "lo", "hi"]
    a, b = many.withColumnsRenamed({item: "a", "own": "oa"}), many.withColumnsRenamed({item: "b", "own": "ob"})
    both = a.join(b, on).filter("a < b").filter((F.col("oa") != F.col("ob")) | (F.col("lo") == F.col("hi")))
    if match:
        both = both.filter(match(lambda c: F.col("a")[c], lambda c: F.col("b")[c]))
    return both.select(*keys, "a", "b")


def cross_members(links: DataFrame, left: DataFrame, right: DataFrame, block: int = RUN) -> DataFrame:
    """links(t, h) of classes, left(t, x), right(h, y) -> (x, y): the members of linked classes, whatever their number.

    Members of a class are dealt to blocks, and a link is repeated for every pair
    of blocks, so that the pairs of two large classes are made by many tasks.
    """
    links = staged(links, "class-links")

    def dealt(rows: DataFrame, key: str, item: str, part: str) -> tuple[DataFrame, DataFrame]:
        own = staged(rows.join(links.select(key).distinct(), key, "left_semi"), "linked-rows")
        sizes = staged(own.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts")), "link-blocks")
        placed = own.join(sizes, key).select(key, item, F.pmod(F.xxhash64(item), F.col("parts")).cast("int").alias(part))
        return placed, sizes.select(key, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias(part))

    x, of_t = dealt(left, "t", "x", "i")
    y, of_h = dealt(right, "h", "y", "j")
    return links.join(of_t, "t").join(of_h, "h").join(x, ["t", "i"]).join(y, ["h", "j"]).select("x", "y")


def jaccard_pairs(met: DataFrame, threshold: float) -> DataFrame:
    """met(sig_a, sig_b, old, grams_a, grams_b) -> (sig_a, sig_b, old) of those that are alike."""
    t = Fraction(str(threshold))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [i for i, (x, y) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())) if _common(x, y, t)]
            take = pa.array(hit, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(3)], names=["sig_a", "sig_b", "old"])

    return met.select("sig_a", "sig_b", "old", "grams_a", "grams_b").mapInArrow(check, "sig_a bigint, sig_b bigint, old boolean")


def _common(x: bytes, y: bytes, t: Fraction) -> float:
    """The similarity of two packed sets, or 0 below the threshold."""
    both = np.concatenate([unpack(x), unpack(y)])
    both.sort(kind="stable")
    o = int((both[1:] == both[:-1]).sum())
    union = len(both) - o
    return o / union if o * t.denominator >= t.numerator * union else 0.0


def gram_sets(rows: DataFrame, order: bool = False) -> DataFrame:
    """row_id, grams (packed set of triples), run (packed triples in the order of the text, if asked for) of rows(row_id, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                w = Words(texts[a:b])
                first, raw = triples(w)
                text, gram = distinct(w.text[first], raw)
                at = bounds(text, b - a)
                sets = [pack(gram[x:y]) for x, y in zip(at[:-1], at[1:])]
                run = bounds(w.text[first], b - a)
                runs = [pack(raw[x:y]) for x, y in zip(run[:-1], run[1:])] if order else [None] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.binary()), pa.array(runs, pa.binary())], names=["row_id", "grams", "run"])

    return rows.select("row_id", "text").mapInArrow(cut, "row_id bigint, grams binary, run binary")


def verify(rows: DataFrame, signs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD, name: str = "edges", coverage: bool = False) -> DataFrame:
    """Of distinct pairs (sig_a, sig_b) those that are alike, with their similarity, staged.  Only texts of candidate classes are cut again.

    With ``coverage`` also the share of each text's words that lies in common
    spans: triples of either text that the other has, at their places in order,
    runs of them merged.
    """
    t = Fraction(str(threshold))
    needed = pairs.select(F.col("sig_a").alias("sig")).unionByName(pairs.select(F.col("sig_b").alias("sig"))).distinct()
    reps = signs.filter("n > 0").groupBy("sig").agg(F.min("row_id").alias("row_id")).join(needed, "sig", "left_semi")
    reps = staged(reps, name + "-reps")
    chosen = keep_ids(rows.select("row_id", "text"), "row_id", reps.select("row_id"))

    grams = gram_sets(chosen, coverage).join(reps, "row_id").select("sig", "grams", *["run"] * coverage)
    side = lambda s: grams.select(*[F.col(c).alias(f"{c}_{s}") for c in grams.columns])
    met = pairs.join(side("a"), "sig_a").join(side("b"), "sig_b")
    met = met.select("sig_a", "sig_b", "grams_a", "grams_b", *["run_a", "run_b"] * coverage)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [(i, s) for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())) if (s := _common(x, y, t))]
            take = pa.array([i for i, _ in sims], pa.int64())
            out = [batch.column(0).take(take), batch.column(1).take(take), pa.array([s for _, s in sims], pa.float64())]
            if coverage:
                for own, other in ((4, 3), (5, 2)):
                    out.append(pa.array([_covered(unpack(batch.column(own)[i].as_py()), unpack(batch.column(other)[i].as_py())) for i, _ in sims], pa.float64()))
            yield pa.RecordBatch.from_arrays(out, names=["sig_a", "sig_b", "similarity", "cover_a", "cover_b"][: len(out)])

    schema = "sig_a bigint, sig_b bigint, similarity double" + ", cover_a double, cover_b double" * coverage
    return staged(met.mapInArrow(check, schema), name)


def _covered(run: np.ndarray, other: np.ndarray) -> float:
    """Share of a text's words inside spans that stand in another; run: its triples in order, other: the set of the other's."""
    inside = np.zeros(len(run) + 2, dtype=bool)
    at = np.flatnonzero(np.isin(run, other))
    for k in range(3):
        inside[at + k] = True
    return float(inside.mean())


def sketch_of(parts: DataFrame, bits: int, crossing: bool = False) -> np.ndarray:
    """The merged sketch; its records are deleted, as they take more room than the signatures."""
    cells = merge_sketch(parts, "side", bits) if crossing else merge_sketch(parts.drop("side"), None, bits)
    if all("/sketch=1/" in f for f in parts.inputFiles()):
        discard(parts)
    return cells
