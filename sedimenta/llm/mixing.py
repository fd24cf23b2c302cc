"""Problem 9: mixing sources to target shares of tokens."""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..plans.staging import bounded, staged

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting pattern of the vocabulary (fixed value, published with it).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Documents of one block of a permutation, about, and most blocks of a source (then blocks grow with it).
BLOCK_DOCS, MOST_BLOCKS = 2_000, 65_536
#: Bytes of a vocabulary file that may be sent to the workers, and sources of a plan, which is made on the driver.
MOST_VOCABULARY, MOST_SOURCES = 1 << 26, 1_000_000
_OPEN: dict[str, object] = {}


def _encoder(key: str, vocabulary: bytes):
    if key not in _OPEN:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _OPEN[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _OPEN[key]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source (trimmed, lower case), tokens of the whole text; null texts count 0.

    The vocabulary file is read where the driver runs and sent to the workers, which need not have it.
    """
    if os.path.getsize(tokenizer) > MOST_VOCABULARY:
        raise ValueError(f"vocabulary too large to be sent: {tokenizer}")
    with open(tokenizer, "rb") as f:
        sent = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer, sent.value)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.lower(F.trim(F.regexp_replace(F.col(source), r"^[\s\u00a0]+|[\s\u00a0]+$", ""))).alias("source"), F.col(text_col).alias("text")).filter("doc_id is not null").mapInArrow(run, "doc_id bigint, source string, tokens bigint")


def temperature(shares: dict[str, float], toward: dict[str, float], power: float) -> dict[str, float]:
    """Normalised weights toward^power * shares^(1 - power): natural shares at 0, the target at 1."""
    w = {k: math.exp(power * math.log(toward[k]) + (1 - power) * math.log(shares[k])) for k in shares}
    total = sum(w.values())
    return {k: x / total for k, x in w.items()}


def bisect_power(fits, steps: int = 60) -> float:
    """Largest power in [0, 1] that fits, for a condition that holds from 0 up to some power."""
    if fits(1.0):
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fits(mid) else (lo, mid)
    return lo


def plan_mix(tokens: dict[str, int], target: dict[str, float], limits: dict[str, int], budget: float | None = None, entropy: float | None = None) -> tuple[float, dict[str, float], float]:
    """(budget, weights, power) of a mixture.

    Sources without tokens drop out and the other targets are normalised.
    The exponent between natural shares (0) and the target (1) is bisected to the
    nearest mixture to the target at which the budget keeps to every source's
    repeats; where even natural shares exceed them the budget is lowered.
    Without a budget, it is the largest at which the target itself is reached,
    so the exponent comes out as 1.  ``entropy`` (nats) instead flattens natural
    shares by a temperature until it is met.
    """
    live = [k for k in target if tokens.get(k, 0) > 0 and target[k] > 0 and limits[k] > 0]
    if not live:
        return 0.0, {}, 1.0
    total, goal = sum(tokens[k] for k in live), sum(target[k] for k in live)
    natural = {k: tokens[k] / total for k in live}
    aim = {k: target[k] / goal for k in live}
    room = lambda w: min(limits[k] * tokens[k] / w[k] for k in live)
    if entropy is not None:
        flat = {k: 1 / len(live) for k in live}
        h = lambda w: -sum(x * math.log(x) for x in w.values() if x > 0)
        power = bisect_power(lambda p: h(temperature(natural, flat, p)) <= entropy)
        weights = temperature(natural, flat, power)
        return (room(weights) if budget is None else min(budget, room(weights))), weights, power
    wanted = room(aim) if budget is None else budget
    power = bisect_power(lambda p: room(temperature(natural, aim, p)) >= wanted * (1 - 1e-12))
    weights = temperature(natural, aim, power)
    return min(wanted, room(weights)), weights, power


def mix_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, budget: float | None = None, entropy: float | None = None, budget_share: float | None = None, entropy_share: float | None = None, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mixture, report).

    mixture: doc_id, source, tokens, copies, first_block, for every document used at least
    once.  report: source, docs, tokens, target_share, planned_share,
    reached_tokens, reached_share, repeats, max_repeats, exponent; a row per source
    of targets.  ``budget_share`` gives the budget as a share of all tokens of the
    listed sources, ``entropy_share`` the entropy as a share of the highest
    possible.

    Method: temperature mixing (see plan_mix); a source's tokens are then
    realised as whole passes over all its documents and one partial pass over a
    permutation of blocks: documents fall into blocks by hash, blocks into random
    order, whole blocks are taken while the budget lasts and the block at the
    edge is taken document by document.  Only block totals of the edge search
    meet in one place, never the documents of a source.

    Sources are compared after trimming and lower-casing; documents of other or
    null sources, and null ids, are not used; documents without tokens go with
    their pass.  A source that is listed twice counts with its summed share.
    """
    goal = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter("source is not null")
    if goal.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} listed sources")
    goals = {r["source"]: r for r in goal.collect()}  # a row per listed source, counted before
    counted = staged(token_counts(documents, tokenizer), "tokens")
    used = counted.join(bounded(goal.select("source"), 10_000), "source", "left_semi")
    sums = {r["source"]: r for r in used.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens")).collect()}
    tokens = {k: int(sums[k]["tokens"] or 0) if k in sums else 0 for k in goals}
    if budget_share is not None:
        budget = budget_share * sum(tokens.values())
    if entropy_share is not None:
        entropy = entropy_share * math.log(max(1, sum(n > 0 for n in tokens.values())))
    size, weights, power = plan_mix(tokens, {k: float(r["target_share"] or 0) for k, r in goals.items()}, {k: int(r["max_repeats"] or 0) for k, r in goals.items()}, budget, entropy)
    plan = []
    for k, w in weights.items():
        want = min(size * w, float(goals[k]["max_repeats"]) * tokens[k])
        passes = min(int(want // tokens[k] + 1e-9), int(goals[k]["max_repeats"]))
        plan.append((k, passes, max(0.0, want - passes * tokens[k]), min(MOST_BLOCKS, max(1, sums[k]["docs"] // BLOCK_DOCS))))
    spark = documents.sparkSession
    steps = spark.createDataFrame(plan, "source string, passes int, rest double, blocks long")
    placed = used.join(F.broadcast(steps), "source").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("blocks")))
    totals = placed.groupBy("source", "rest", "block").agg(F.sum("tokens").alias("size"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed + 1)), "block")
    before = totals.withColumn("before", F.sum("size").over(order) - F.col("size"))
    taken = before.filter("before < rest").select("source", "block", F.col("before"), (F.col("before") + F.col("size") <= F.col("rest")).alias("whole"))
    edge = taken.filter("not whole")
    inside = Window.partitionBy("source", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id")
    keyed = placed.join(F.broadcast(edge.select("source", "block", "before")), ["source", "block"])
    partly = keyed.withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).filter("upto <= rest").select("source", "block", "doc_id")
    extra = placed.join(bounded(taken.filter("whole").select("source", "block")), ["source", "block"], "left_semi").select("source", "block", "doc_id").unionByName(partly)
    once = placed.filter("passes > 0").select("doc_id", "source", "tokens", "passes", "block")
    more = extra.join(placed.select("doc_id", "tokens", "block"), ["doc_id", "block"]).select("doc_id", "source", "tokens", F.lit(1).alias("passes"), "block")
    mixture = staged(once.unionByName(more).groupBy("doc_id", "source", "tokens").agg(F.sum("passes").cast("int").alias("copies"), F.min("block").alias("first_block")), "mixture")
    reached = mixture.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"))
    whole = reached.agg(F.sum("reached_tokens").alias("all_tokens"))
    facts = spark.createDataFrame([(k, sums[k]["docs"] if k in sums else 0, tokens[k], weights.get(k, 0.0)) for k in goals] or [("", 0, 0, 0.0)], "source string, docs long, tokens long, planned_share double").filter("source <> ''")
    report = (
        goal.join(facts, "source").join(reached, "source", "left").crossJoin(F.broadcast(whole))
        .select("source", "docs", "tokens", "target_share", "planned_share", F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
                F.round(F.coalesce(F.col("reached_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
                F.round(F.coalesce(F.col("reached_tokens") / F.nullif("tokens", F.lit(0)), F.lit(0.0)), 6).alias("repeats"), "max_repeats", F.round(F.lit(power), 6).alias("exponent"))
    )
    return mixture, report
