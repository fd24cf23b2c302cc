import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import kernel as K
from sedimenta.llm.components import components
from sedimenta.llm.cross_split import cross_split_overlaps, overlap_pairs, overlap_report
from sedimenta.llm.history import removed_per_batch, replay, settle
from sedimenta.llm.near_duplicates import group_pairs, near_duplicate_groups
from sedimenta.llm.sketch import SketchWriter, keep_ids, level, merge_sketch
from sedimenta.llm.shared_spans import shared_share, shared_spans, span_pairs

WORD = re.compile(r"[^\W_]+")


def grams(text):
    w = WORD.findall(text.lower())
    return frozenset(zip(w, w[1:], w[2:]))


def alike(a, b):
    x, y = grams(a), grams(b)
    return bool(x) and bool(y) and 10 * len(x & y) >= 7 * len(x | y)


def sample(n=90, seed=1):
    """Texts with copies, edits, reorderings, short and odd ones."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Straße", "ключ", "雲端", "x²"]
    out = []
    while len(out) < n:
        base = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        for _ in range(rnd.randint(1, 6)):
            t = base[:]
            for _ in range(rnd.randint(0, 4)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            out.append(" ".join(t).upper() if rnd.random() < 0.3 else ", ".join(t))
    return out[: n - 5] + ["", "a b", "a b c", "a b c", "a_b c"]


def frame(spark, texts, **more):
    rows = []
    for i, t in enumerate(texts):
        cut = len(t) // 3
        rows.append((i, t[:cut].rpartition(" ")[0] or None, t[len(t[:cut].rpartition(" ")[0]) :].lstrip(" ") or None, *[v[i] for v in more.values()]))
    schema = "row_id bigint, instruction string, output string" + "".join(f", {k} string" for k in more)
    return spark.createDataFrame(rows, schema), {r[0]: f"{r[1] or ''} {r[2] or ''}" for r in rows}


def test_kernel_agrees_with_python():
    texts = sample(60) + [" ", "İI ß", "a" * 2000, "\n\n1.2.3"]
    w = K.Words(texts)
    first, gram = K.triples(w)
    text, gram = K.distinct(w.text[first], gram)
    assert np.bincount(text, minlength=len(texts)).tolist() == [len(grams(t)) for t in texts]
    assert K.unpack(K.pack(gram)).tolist() == gram.tolist()
    assert [b - a for a, b in K.slices(["x" * 700_000] * 3)] == [1, 1, 1]


def test_sketch_counts(spark):
    rnd = np.random.default_rng(3)
    g = rnd.integers(0, 1 << 40, 5000, dtype=np.uint64)
    seen = np.concatenate([g, g[:1000], g[:10], g[:10]])
    w = SketchWriter()
    parts = w.add(seen[:3000]) + w.flush()
    w.add(seen[3000:])
    parts += w.flush()
    cells = merge_sketch(spark.createDataFrame([(k, bytearray(d)) for k, d in parts], "part int, data binary"))
    got = cells[(g >> np.uint64(14)).astype(np.int64)]
    assert (got[10:1000] >= 2).all() and (got[:10] >= 4).all() and (got[1000:] == 1).mean() > 0.99
    assert (np.diff(level(np.arange(100_000)).astype(int)) >= 0).all()


def test_id_filter_keeps_all(spark):
    df = spark.range(-500, 5000)
    kept = {r.id for r in keep_ids(df, "id", df.filter("id % 7 = 0")).collect()}
    assert {i for i in range(-500, 5000) if i % 7 == 0} <= kept and len(kept) < 1200


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 102), (200, 150), (150, 180)]
    got = dict(components(spark.createDataFrame(edges, "u bigint, v bigint")).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == got[100] == 100 and {got[x] for x in (150, 180, 200)} == {150} and 102 not in got
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_against_brute_force(spark, seed):
    df, texts = frame(spark, sample(90, seed), gram=["clash"] * 90, sig=["clash"] * 90)
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(texts, 2):
        if alike(texts[a], texts[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = {(a, b) for a, b in combinations(texts, 2) if root(a) == root(b)}
    groups = near_duplicate_groups(df)
    assert {r.row_id: r.group_id for r in groups.collect()} == {i: root(i) for i in texts}
    got = [tuple(r) for r in group_pairs(groups).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_groups_of_nothing(spark):
    df, _ = frame(spark, ["", "a b c d", "a b c d"])
    assert near_duplicate_groups(df.limit(0)).count() == 0
    assert group_pairs(near_duplicate_groups(df.filter("row_id = 0"))).count() == 0
    assert near_duplicate_groups(df.unionByName(df.withColumn("row_id", F.lit(None).cast("bigint")))).count() == 3


def test_hot_group_of_different_texts(spark):
    """More alike texts than a window looks back on go through block pairs, none is lost."""
    base = " ".join(f"b{i}" for i in range(60))
    df, _ = frame(spark, [f"{base} u{i}" for i in range(300)] + [base] * 50)
    groups = near_duplicate_groups(df)
    assert groups.select("group_id").distinct().count() == 1
    assert group_pairs(groups).count() == 350 * 349 // 2


def test_cross_split(spark):
    rnd = random.Random(5)
    texts = sample(90, 7)
    splits = [rnd.choice(["train", " Train ", "eval", "TEST", None, "other", "train "]) for _ in texts]
    df, whole = frame(spark, texts, split=splits, source=["s"] * 90)
    side = lambda s: {"train": 0, "eval": 1, "test": 1}.get((s or "").replace(" ", " ").strip().lower())
    want = {(a, b) for a, b in combinations(whole, 2) if {side(splits[a]), side(splits[b])} == {0, 1} and alike(whole[a], whole[b])}
    rows, links = cross_split_overlaps(df)
    got = [tuple(r) for r in overlap_pairs(rows, links).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert links.filter("cover_a < similarity or cover_a > 1 or longest < 3").count() == 0
    hit = {x for p in want for x in p}
    assert sum(r.overlapping_rows for r in overlap_report(df).collect()) == len(hit)
    assert overlap_pairs(*cross_split_overlaps(df.limit(0))).count() == 0


def test_settle_is_greedy(spark):
    rnd = random.Random(2)
    edges = {tuple(sorted(rnd.sample(range(60), 2))) for _ in range(120)} | {(i, i + 1) for i in range(100, 112)}
    kept, lost = set(), set()
    for n in sorted({x for e in edges for x in e}):
        (lost if any(m in kept for m in range(n) if (m, n) in edges) else kept).add(n)
    got = {r.node for r in settle(spark.createDataFrame(list(edges), "lo bigint, hi bigint")).collect()}
    assert got == lost
    assert settle(spark.createDataFrame([], "lo bigint, hi bigint")).count() == 0


def test_hot_keys_never_meet_one_task(spark):
    """A key of 100,000 classes: rows of a hot key are dealt out one by one, its pairs come from blocks."""
    from sedimenta.llm.alike import counted, flag_hot, meetings
    from sedimenta.plans.staging import staged

    rows = staged(spark.range(100_000).selectExpr("7L AS k", "id AS sig").unionByName(spark.range(40).selectExpr("id % 4 AS k", "id AS sig")), "hot-test")
    flagged = flag_hot(rows, ["k"])
    met = meetings(flagged, ["k"], ["sig"], lambda a, b: (a("sig") - b("sig")).between(-1, 1), "hot-meetings", ["k", "sig"])
    plan = met._jdf.queryExecution().toString()
    assert "Window" not in plan  # nothing of the hot key is gathered once the rest is staged
    assert met.filter("k <> 7").count() == 0
    held = flagged.withColumn("own", F.when(F.col("hot"), F.xxhash64("k", "sig")).otherwise(F.lit(0))).repartition(16, "k", "own")
    sizes = [r[0] for r in held.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert max(sizes) < 2 * 100_040 / 16 and counted(rows, ["k"]).filter("cnt = 100000").count() == 100_000


def test_sketch_follows_the_data():
    from sedimenta.llm.sketch import LEAST_BITS, MOST_BITS, sketch_bits

    assert sketch_bits(0) == LEAST_BITS and sketch_bits(10**15) == MOST_BITS
    assert sketch_bits(16 * 10**7) - sketch_bits(10**7) == 4


def test_history(spark):
    rnd = random.Random(9)
    texts = sample(90, 11)
    ids = [rnd.choice(["b1", "b2", "b3", "zz"]) for _ in texts]
    df, whole = frame(spark, texts, batch_id=ids)
    batches = spark.createDataFrame([("b1", 3, 5), ("b2", 1, None), ("b3", 2, 0)], "batch_id string, batch_seq bigint, duplicates_removed bigint")
    seq = {"b1": 3, "b2": 1, "b3": 2, "zz": 99}
    kept, want = [], set()
    for i in sorted(whole, key=lambda i: (seq[ids[i]], i)):
        (want.add((ids[i], i)) if any(alike(whole[i], whole[k]) for k in kept) else kept.append(i))
    got = [(r.batch_id, r.row_id) for r in replay(df, batches).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    per = {r.batch_id: r.duplicates_removed for r in removed_per_batch(df, batches).collect()}
    assert per == {b: sum(x == b for x, _ in want) for b in ("b1", "b2", "b3")}
    assert replay(df.limit(0), batches).count() == 0


def spans_brute(texts, least):
    out = set()
    pieces = {i: {t[k : k + least] for k in range(len(t) - least + 1)} for i, t in texts.items() if t}
    for a, b in combinations(sorted(pieces), 2):
        if pieces[a] & pieces[b]:
            out.add((a, b))
    return out


def test_spans_against_brute_force(spark):
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefghij klm.\n雲ß") for _ in range(n))
    shared = [noise(n) for n in (290, 299, 300, 301, 340, 700, 2000)]
    texts = {}
    for i in range(70):
        s = rnd.choice(shared)
        texts[i] = noise(rnd.randint(0, 500)) + s + noise(rnd.randint(0, 500)) + (rnd.choice(shared) if rnd.random() < 0.3 else "")
    texts |= {70: texts[3], 71: texts[3], 72: "", 73: None, 74: "=" * 900, 75: "x" + "=" * 350, 76: "ab" * 400, 77: noise(20) + "ab" * 160, 78: "short", 79: "=" * 299}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").withColumn("sig", F.lit("clash"))
    got = [tuple(r) for r in span_pairs(*shared_spans(df)).collect()]
    assert len(got) == len(set(got)) and set(got) == spans_brute(texts, 300)
    share = {r.doc_id: r for r in shared_share(df).collect()}
    assert len(share) == len(texts) and share[70].shared_share == 1.0 and share[78].shared_chars == 0 and share[73].n_chars == 0
    hit = {x for p in got for x in p}
    assert {i for i, r in share.items() if r.shared_chars} == hit and all(r.shared_chars >= 300 for i, r in share.items() if i in hit)


def test_spans_of_nothing_and_of_many(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert span_pairs(*shared_spans(empty)).count() == 0
    rnd = random.Random(6)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(320))
    df = spark.createDataFrame([(i, f"{i} {passage} {rnd.random()}" * 1) for i in range(280)], "doc_id bigint, text string")
    assert span_pairs(*shared_spans(df)).count() == 280 * 279 // 2


def test_batches_one_by_one_equal_the_replay(spark, tmp_path):
    from sedimenta.llm.history import History

    texts = sample(90, 21)
    ids = [f"b{1 + i % 3}" for i in range(90)]
    df, _ = frame(spark, texts, batch_id=ids)
    batches = spark.createDataFrame([("b1", 1, 0), ("b2", 2, 0), ("b3", 3, 0)], "batch_id string, batch_seq bigint, duplicates_removed bigint")
    want = {r.row_id: r.kind for r in replay(df, batches).collect()}
    got = {}
    for b in ("b1", "b2", "b3"):
        h = History(spark, f"file://{tmp_path}/history", buckets=4)  # opened anew: everything lives in the tables
        if b == "b3":
            h.compact()
            assert len(h.deliveries()) == 1
        got |= {r.row_id: r.kind for r in h.admit(df.filter(F.col("batch_id") == b)).collect()}
    assert set(got) == set(want)  # a copy of a rejected row is near to the history, which never held it


def test_deliveries_and_lost_batches(spark, tmp_path):
    """Any number of deliveries gives one result; a delivery that never reached the log is admitted again whole."""
    from sedimenta.llm.history import History

    texts = sample(90, 5)
    df, _ = frame(spark, texts, batch_id=[f"b{i % 6}" for i in range(90)])
    batches = spark.createDataFrame([(f"b{k}", k, 0) for k in range(6)], "batch_id string, batch_seq bigint, duplicates_removed bigint")
    want = {r.row_id for r in replay(df, batches, deliveries=1).collect()}
    assert {r.row_id for r in replay(df, batches, deliveries=3).collect()} == want
    covered = replay(df, batches, deliveries=2, covered=True)
    assert {r.row_id for r in covered.collect()} == want and covered.filter("coverage < 0 or coverage > 1").count() == 0
    h = History(spark, f"file://{tmp_path}/lost", buckets=2)
    first = df.filter("batch_id in ('b0', 'b1', 'b2')")
    once = {r.row_id for r in h.admit(first).collect()}
    h._commit = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    rest = df.filter("batch_id not in ('b0', 'b1', 'b2')")
    with pytest.raises(RuntimeError):
        h.admit(rest)
    again = History(spark, f"file://{tmp_path}/lost", buckets=2)
    assert again.deliveries() == [0]
    got = {r.row_id for r in again.admit(rest).collect()}
    order = first.select("row_id", F.lit(0).alias("arrival"), "instruction", "output").unionByName(rest.select("row_id", F.lit(1).alias("arrival"), "instruction", "output"))
    assert once | got == {r.row_id for r in History(spark, f"file://{tmp_path}/whole", buckets=2).admit(order).collect()}


def lines_of(text):
    return [tuple(w) for w in map(WORD.findall, text.lower().split("\n")) if len(w) >= 4]


def test_paragraphs_of_a_replay(spark, monkeypatch):
    """Paragraphs are kept only where coverage reads them, and then of all rows: of copies, and of copies with other line breaks."""
    from sedimenta.llm.history import ACCEPTED, PARAGRAPH, History

    rnd = random.Random(8)
    line = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(rnd.randint(3, 9)))
    base = [[line() for _ in range(rnd.randint(2, 7))] for _ in range(24)]
    texts = ["\n".join(t) for t in base]
    texts += ["\n".join(t) for t in base[:6]]  # whole copies
    texts += [" ".join(t).replace(" ", "\n", 1) for t in base[6:12]]  # the same words in other lines
    texts += ["\n".join([*t, "one more line of words"]) for t in base[12:18]] + [" ".join(t).replace(" ", "\n", 1) for t in base[6:9]]
    ids = ["b0" if i < 33 else "b1" for i in range(len(texts))]
    for i in range(24, 28):
        ids[i] = "b1"
    df, whole = frame(spark, texts, batch_id=ids)
    df = df.coalesce(1)  # copies meet in one task
    batches = spark.createDataFrame([("b0", 0, 0), ("b1", 1, 0)], "batch_id string, batch_seq bigint, duplicates_removed bigint")
    kept, drop = [], History.drop

    def seen(self):
        kept.append({(r.delivery, r.kind) for r in spark.table(self.table).select("delivery", "kind").distinct().collect()})
        drop(self)

    monkeypatch.setattr(History, "drop", seen)
    plain = {r.row_id for r in replay(df, batches).collect()}
    covered = {r.row_id: r.coverage for r in replay(df, batches, covered=True).collect()}
    assert set(covered) == plain
    before = {x for i, t in whole.items() if ids[i] == "b0" for x in lines_of(t)}
    want = {i: sum(len(x) for x in lines_of(whole[i]) if ids[i] == "b1" and x in before) / len(WORD.findall(whole[i].lower())) for i in plain}
    assert covered == {i: pytest.approx(v, abs=1e-6) for i, v in want.items()} and sum(v > 0.5 for v in want.values()) > 8
    assert not [k for k in kept[0] if k[1] == PARAGRAPH] and {d for d, k in kept[1] if k == PARAGRAPH} == {0}
    assert all({d for d, k in ks if k == ACCEPTED} == {0} for ks in kept)
