"""Problem 10: long spans that stand letter by letter in more than one record."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.staging import staged
from .alike import block_pairs, cross_members, flag_hot, meetings
from .kernel import code_points, prefix_hash, range_hash, slices
from .sketch import keep_ids

#: Length of a token (a character window) and number of windows of which the least becomes a node.
TOKEN, WINDOW = 40, 128
LEAST = 300
#: Lengths of the texts before and behind an edge that are hashed with it, 16 bits each.
FLANKS = (4, 16, 48)
_NONE = 0


def _node_starts(h: np.ndarray, ok: np.ndarray, width: int) -> np.ndarray:
    """Positions whose token is the least of some run of ``width`` neighbouring tokens, all in one text.

    h: token hashes; ok: positions whose token lies inside its text.  The choice
    depends only on the text within the run, so equal spans choose equal nodes.
    """
    low, step = h.copy(), 1
    inside = ok.copy()
    while step < width:  # width is a power of two
        low[:-step] = np.minimum(low[:-step], low[step:])
        inside[:-step] &= inside[step:]
        inside[-step:] = False
        step *= 2
    high, step = np.where(inside, low, 0), 1
    while step < width:
        high[step:] = np.maximum(high[step:], high[:-step].copy())
        step *= 2
    chosen = ok & (high == h) & (high > 0)
    # inside a run of one repeated character all tokens are equal: two at either end stand for it
    same = np.concatenate([[False, False], h[1:] == h[:-1], [False, False]])
    return np.flatnonzero(chosen & ~(same[:-3] & same[1:-2] & same[2:-1] & same[3:]))


SCHEMA = "doc_id bigint, sig bigint, edge bigint, s int, e int, before bigint, behind bigint"


def _flanks(total: np.ndarray, start: np.ndarray, end: np.ndarray, sign: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """16-bit hashes of the texts of FLANKS' lengths before start (sign -1) or behind end (+1), packed; 0 where the text is too short."""
    out = np.zeros(len(start), dtype=np.uint64)
    for k, n in enumerate(FLANKS):
        a, b = (start - n, start) if sign < 0 else (end, end + n)
        ok = (a >= lo) & (b <= hi)
        h = range_hash(total, np.where(ok, a, 0), np.where(ok, b, 0)) >> np.uint64(48)
        out |= np.where(ok, np.maximum(h, np.uint64(1)), np.uint64(0)) << np.uint64(16 * k)
    return out


def graph_edges(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """Edges of the token graph, and a row per document (edge null) with the signature of its text.

    Tokens that are nodes are chosen so densely that any span of ``least``
    characters holds two of them, hence an edge; an edge's hash is that of the
    text from the beginning of one node to the end of the next.  Only texts of
    at least ``least`` characters take part; of equal texts in one task only the
    first gives edges.
    """
    width = WINDOW
    while TOKEN - 1 + 2 * width > least:
        width //= 2
    if width < 8:
        raise ValueError("spans need at least 55 characters")

    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                cp, off = code_points(texts[a:b])
                total = prefix_hash(cp)
                sig = range_hash(total, off[:-1], off[1:] - 1).view(np.int64)
                fresh = np.array([s not in seen and not seen.add(s) for s in sig.tolist()], dtype=bool)
                m = b - a
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), pa.array(sig), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())], names=names)
                n = len(cp) - TOKEN + 1
                if n < 1:
                    continue
                place = np.arange(n)
                h = range_hash(total, place, place + TOKEN)
                text = np.repeat(np.arange(m), np.diff(off))[:n]
                ok = (place + TOKEN <= off[1:][text] - 1) & fresh[text]
                at = _node_starts(h, ok, width)
                pair = np.flatnonzero(text[at[:-1]] == text[at[1:]]) if len(at) > 1 else np.zeros(0, dtype=np.int64)
                s, e, t = at[pair], at[pair + 1] + TOKEN if len(pair) else at[pair], text[at[pair]]
                edge = range_hash(total, s, e).view(np.int64)
                k = len(pair)
                sides = [_flanks(total, s, e, sign, off[t], off[1:][t] - 1).view(np.int64) for sign in (-1, 1)]
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.array(sig[t]), pa.array(edge), pa.array((s - off[t]).astype(np.int32)), pa.array((e - off[t]).astype(np.int32)), *map(pa.array, sides)], names=names)

    return documents.filter(F.length("text") >= least).select("doc_id", "text").mapInArrow(run, SCHEMA)


def compacted_paths(edges: DataFrame) -> DataFrame:
    """edges(sig, edge, s, e, before, behind) -> (path, sig, s, e, before, behind): unbranched paths of repeated edges and where each stands.

    An edge is repeated if texts of two signatures hold it.  Neighbouring
    repeated edges join where the first has no other successor and the second no
    other predecessor in the whole collection (a unique neighbour counts as one
    of its own), so each occurrence of a path is whole.
    """
    spread = edges.groupBy("edge").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).filter("lo <> hi").select("edge")
    rep = staged(edges.join(spread, "edge").dropDuplicates(["sig", "s", "edge"]), "repeated-edges")
    by = Window.partitionBy("sig").orderBy("s")
    prev, after = F.lag(F.struct("edge", "e")).over(by), F.lead(F.struct("edge", "s")).over(by)
    linked = rep.withColumn("p", prev).withColumn("q", after)
    linked = linked.withColumn("last", F.when(F.col("p.e") - TOKEN == F.col("s"), F.col("p.edge")).otherwise(_NONE))
    linked = linked.withColumn("next", F.when(F.col("q.s") == F.col("e") - TOKEN, F.col("q.edge")).otherwise(_NONE)).drop("p", "q")
    ends = linked.groupBy("edge").agg((F.min("last") == F.max("last")).alias("one_in"), (F.min("next") == F.max("next")).alias("one_out"))
    known = linked.join(ends, "edge")
    joins = F.col("one_in") & (F.col("last") != _NONE) & F.coalesce(F.lag("one_out").over(by), F.lit(False))
    part = known.withColumn("begins", (~joins).cast("int")).withColumn("run", F.sum("begins").over(by))
    whole = F.xxhash64(F.array_sort(F.collect_list(F.struct("s", "edge")))["edge"]).alias("path")
    ends = [F.min_by("before", "s").alias("before"), F.max_by("behind", "e").alias("behind")]
    return part.groupBy("sig", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"), whole, *ends).select("path", "sig", "s", "e", "before", "behind")


def with_letters(paths: DataFrame, docs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same paths, told apart by a digest of the letters that stand at their coordinates in the source texts.

    Occurrences whose node hashes agree but whose letters don't are so parted
    again, and what meets in a path is equal letter by letter.
    """
    reps = staged(sizes.join(paths.select("sig").distinct(), "sig", "left_semi").select("sig", F.col("rep").alias("doc_id")), "path-reps")
    texts = keep_ids(docs, "doc_id", reps.select("doc_id")).join(reps, "doc_id").select("sig", "text")
    letters = F.md5(F.expr("substring(text, s + 1, e - s)"))
    return paths.join(texts, "sig").withColumn("path", F.xxhash64("path", letters)).select(*paths.columns)


def meeting_keys(paths: DataFrame, least: int) -> DataFrame:
    """paths with (side, flank), up to two rows an occurrence: what two texts have to share to have ``least`` characters in common.

    A path shorter than ``least`` has to be continued equally by the missing
    characters, hence by half of them on one side at least; the hash of the
    longest flank within that half is asked for on either side.
    """
    half = F.ceil((F.lit(least) - (F.col("e") - F.col("s"))) / 2)
    bits = lambda c: F.coalesce(*[F.when(half >= n, F.shiftright(F.col(c), 16 * k).bitwiseAND(F.lit(65535))) for k, n in reversed(list(enumerate(FLANKS)))])
    both = F.array(F.struct(F.lit(1).alias("side"), bits("before").alias("flank")), F.struct(F.lit(2).alias("side"), bits("behind").alias("flank")))
    free = F.array(F.struct(F.lit(0).alias("side"), F.lit(0).cast("bigint").alias("flank")))
    asked = F.when(half < FLANKS[0], free).otherwise(F.filter(both, lambda x: x["flank"] > 0))
    return paths.select("path", "sig", "s", "e", F.explode(asked).alias("k")).select("path", "k.side", "k.flank", "sig", "s", "e")


def shared_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """Texts that share a span of at least ``least`` characters: (members, spans).

    members: doc_id, sig (class of equal texts), cnt (its size); texts of at
    least ``least`` characters.  spans: sig_a, sig_b, s_a, e_a, s_b, e_b; with
    ``whole`` each span is extended to its full length, else pairs that are
    certain from the graph keep the part that its nodes enclose.

    Method: compaction of a de Bruijn graph whose tokens are content-chosen
    character windows (k-mers in token space): edges that more than one text
    holds are compacted into unbranched paths through joins and windows; each
    path is verified by the letters at its source coordinates; texts that meet in
    a path are aligned by its coordinates, aligned paths are merged, and what
    stays shorter than ``least`` is compared letter by letter beyond them.  Any
    shared span of ``least`` characters holds an edge, so none is missed.

    Null and shorter texts share nothing.  Equal texts form one class and are
    compared once.  Characters are code points; nothing is normalised.
    """
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    graph = staged(graph_edges(docs, least), "span-graph")
    found = graph.filter("edge is null").select("doc_id", "sig")
    sizes = found.groupBy("sig").agg(F.count(F.lit(1)).alias("cnt"), F.min("doc_id").alias("rep"))
    paths = with_letters(staged(compacted_paths(graph.filter("edge is not null").drop("doc_id")), "paths"), docs, sizes)
    keys = ["path", "side", "flank"]
    asked = flag_hot(staged(meeting_keys(paths, least), "path-keys"), keys)
    met = meetings(asked, keys, ["sig", "s", "e"], lambda a, b: a("sig") != b("sig"), "paths", [*keys, "sig", "s"])
    turn = F.col("a.sig") < F.col("b.sig")
    x, y = F.when(turn, F.col("a")).otherwise(F.col("b")), F.when(turn, F.col("b")).otherwise(F.col("a"))
    aligned = met.filter("a.sig <> b.sig").select(x.alias("x"), y.alias("y")).select(F.col("x.sig").alias("sig_a"), F.col("y.sig").alias("sig_b"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), (F.col("x.s") - F.col("y.s")).alias("shift"))
    by = Window.partitionBy("sig_a", "sig_b", "shift").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isles = aligned.distinct().withColumn("new", (F.coalesce(reach, F.lit(-1)) < F.col("s")).cast("int")).withColumn("isle", F.sum("new").over(by))
    merged = isles.groupBy("sig_a", "sig_b", "shift", "isle").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    merged = staged(merged.withColumn("sure", F.max(F.col("e") - F.col("s")).over(Window.partitionBy("sig_a", "sig_b")) >= least), "span-candidates")
    open_ = merged if whole else merged.filter("not sure")
    needed = open_.select(F.col("sig_a").alias("sig")).unionByName(open_.select(F.col("sig_b").alias("sig"))).distinct()
    reps = staged(sizes.join(needed, "sig", "left_semi").select("sig", F.col("rep").alias("doc_id")), "span-reps")
    texts = keep_ids(docs, "doc_id", reps.select("doc_id")).join(reps, "doc_id").select("sig", "text")
    side = lambda c: texts.withColumnsRenamed({"sig": f"sig_{c}", "text": f"text_{c}"})
    both = open_.join(side("a"), "sig_a").join(side("b"), "sig_b").select("sig_a", "sig_b", "shift", "s", "e", "text_a", "text_b")
    out = "sig_a bigint, sig_b bigint, s_a int, e_a int, s_b int, e_b int"

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sa, sb, shift, s, e, ta, tb in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if ta[s:e] != tb[s - shift : e - shift]:
                    continue  # a collision of hashes
                while s > 0 and s - shift > 0 and ta[s - 1] == tb[s - shift - 1]:
                    s -= 1
                while e < len(ta) and e - shift < len(tb) and ta[e] == tb[e - shift]:
                    e += 1
                if e - s >= least:
                    rows.append((sa, sb, s, e, s - shift, e - shift))
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["sig_a", "sig_b", "s_a", "e_a", "s_b", "e_b"])

    spans = both.mapInArrow(extend, out)
    if not whole:
        certain = merged.filter(F.col("sure") & (F.col("e") - F.col("s") >= least))
        spans = spans.unionByName(certain.select("sig_a", "sig_b", F.col("s").alias("s_a"), F.col("e").alias("e_a"), (F.col("s") - F.col("shift")).alias("s_b"), (F.col("e") - F.col("shift")).alias("e_b")))
    return found.join(sizes, "sig").select("doc_id", "sig", "cnt"), spans


def span_pairs(members: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of documents that share a span, the smaller id first: the form that problem 10 asks for."""
    links = spans.select(F.col("sig_a").alias("t"), F.col("sig_b").alias("h")).distinct()
    of = lambda k, x: members.select(F.col("sig").alias(k), F.col("doc_id").alias(x))
    across = cross_members(links, of("t", "x"), of("h", "y")).select(F.col("x").alias("x_a"), F.col("y").alias("x_b"))
    within = block_pairs(members.filter("cnt > 1").select("sig", "cnt", F.struct("doc_id").alias("item")), ["sig"], "item").select(F.col("a.doc_id").alias("x_a"), F.col("b.doc_id").alias("x_b"))
    both = across.unionByName(within)
    return both.select(F.least("x_a", "x_b").alias("doc_id_a"), F.greatest("x_a", "x_b").alias("doc_id_b")).filter("doc_id_a < doc_id_b").distinct()


def shared_share(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_chars, shared_chars, shared_share: how much of each text also stands in another record; a row per document."""
    members, spans = shared_spans(documents, least=least, whole=True)
    ends = spans.select(F.col("sig_a").alias("sig"), F.col("s_a").alias("s"), F.col("e_a").alias("e")).unionByName(spans.select(F.col("sig_b").alias("sig"), F.col("s_b").alias("s"), F.col("e_b").alias("e"))).distinct()
    by = Window.partitionBy("sig").orderBy("s", "e")
    fresh = F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("s"), F.coalesce(F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    covered = ends.withColumn("fresh", fresh).groupBy("sig").agg(F.sum("fresh").alias("covered"))
    known = members.join(covered, "sig", "left").select("doc_id", "cnt", "covered")
    n = F.coalesce(F.length("text"), F.lit(0))
    return documents.select("doc_id", n.alias("n_chars")).join(known, "doc_id", "left").select("doc_id", "n_chars", F.when(F.col("cnt") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("int").alias("shared_chars")).withColumn("shared_share", F.round(F.col("shared_chars") / F.greatest("n_chars", F.lit(1)), 6))
