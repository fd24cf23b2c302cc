"""Count sketch and id filter of bounded size, both merged on the executors.

A sketch has one-byte cells in slices of 2**20, about four to a distinct triple
and never more than 2**MOST_BITS; a filter has at most 2**27 bits.  So both may
be broadcast at any scale.  They only order or thin out work; no result depends
on their collisions.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .kernel import mix

SLOT_BITS = 26
LEAST_BITS, MOST_BITS = 20, 27
SLICE_BITS = 20
GRAM_BITS = 40
FLUSH = 6_000_000
LEVEL = 63
FLAG_A, FLAG_B = 64, 128


def sketch_bits(chars: int) -> int:
    """Bits of a cell's number for texts of so many characters: some six make a word, and a third of all triples are new ones."""
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(chars, 1) / 4)))))


def cell_of(cells: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """The cells of 40-bit grams."""
    return cells[(gram >> np.uint64(GRAM_BITS - (len(cells).bit_length() - 1))).astype(np.int64)]


class SketchWriter:
    """Gathers 40-bit grams of a task and yields (slice, packed counts) records."""

    def __init__(self, bits: int = SLOT_BITS) -> None:
        self.bits = bits
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, gram: np.ndarray) -> list[tuple[int, bytes]]:
        self.parts.append((gram >> np.uint64(GRAM_BITS - self.bits)).astype(np.uint32))
        self.size += len(gram)
        return self.flush() if self.size > FLUSH else []

    def flush(self) -> list[tuple[int, bytes]]:
        if not self.size:
            return []
        slots = np.sort(np.concatenate(self.parts))
        self.parts, self.size = [], 0
        first = np.flatnonzero(np.concatenate([[True], slots[1:] != slots[:-1]]))
        count = np.minimum(np.diff(np.append(first, len(slots))), 65535).astype(np.uint16)
        slots = slots[first]
        cut = np.searchsorted(slots >> np.uint32(SLICE_BITS), np.arange((1 << (self.bits - SLICE_BITS)) + 1))
        out = []
        for k in range(len(cut) - 1):
            a, b = cut[k], cut[k + 1]
            if a < b:
                inside = slots[a:b] & np.uint32((1 << SLICE_BITS) - 1)
                gaps = np.diff(inside, prepend=np.uint32(0)).astype(np.uint32)
                narrow = gaps.astype(np.uint8) if gaps.max() < 256 else gaps.astype(np.uint16) if gaps.max() < 65536 else gaps
                head = bytes([narrow.itemsize]) + int(b - a).to_bytes(4, "little")
                out.append((k, zlib.compress(head + narrow.tobytes() + count[a:b].view(np.uint8).reshape(-1, 2).T.tobytes(), 1)))
        return out


def _read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(data)
    width, n = raw[0], int.from_bytes(raw[1:5], "little")
    gaps = np.frombuffer(raw, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[width], count=n, offset=5)
    planes = np.frombuffer(raw, dtype=np.uint8, offset=5 + n * width).reshape(2, n).astype(np.int64)
    return np.cumsum(gaps.astype(np.int64)), planes[0] | (planes[1] << 8)


_LEVELS: np.ndarray | None = None


def level(count: np.ndarray) -> np.ndarray:
    """Counts as at most 63 levels: exact up to 8, then three to a doubling (from 2**21 on all alike)."""
    global _LEVELS
    if _LEVELS is None:
        c = np.arange((1 << 21) + 1)
        _LEVELS = np.where(c <= 8, c, np.minimum(LEVEL, 8 + np.floor(3 * np.log2(np.maximum(c, 1) / 8)))).astype(np.uint8)
    return _LEVELS[np.minimum(count, 1 << 21)]


def merge_sketch(parts: DataFrame, side: str | None = None, bits: int = SLOT_BITS) -> np.ndarray:
    """Cells of the whole table from records (part int, data binary[, side int]).

    A cell holds the level of its count; with ``side``, also in which of the two
    sides (0, 1) it occurs.  The records are summed by slice on the executors;
    at most 128 slices of one megabyte reach the driver whatever the table's size.
    """

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["part"].iloc[0])
        s = pdf[side].to_numpy() if side else np.zeros(len(pdf), dtype=int)
        sums = np.zeros((2 if side else 1, 1 << SLICE_BITS), dtype=np.int64)
        for d, w in zip(pdf["data"], s):
            at, n = _read(d)
            sums[w][at] += n
        cells = level(sums.sum(axis=0) if side else sums[0])
        if side:
            cells |= np.where(sums[0] > 0, FLAG_A, 0).astype(np.uint8) | np.where(sums[1] > 0, FLAG_B, 0).astype(np.uint8)
        return pd.DataFrame({"part": [k], "cells": [zlib.compress(cells.tobytes(), 1)]})

    # records are first summed in groups of at most 256, so that no task holds all records of a slice
    def partial(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for w in sorted(set(pdf[side])) if side else [0]:
            own = pdf[pdf[side] == w] if side else pdf
            if len(own) == 1:
                out.append((int(own["part"].iloc[0]), own["data"].iloc[0], int(w)))
                continue
            sums = np.zeros(1 << SLICE_BITS, dtype=np.int64)
            for d in own["data"]:
                at, n = _read(d)
                sums[at] += n
            at = np.flatnonzero(sums)
            if len(at):
                gaps = np.diff(at, prepend=0).astype(np.uint32)
                head = bytes([4]) + len(at).to_bytes(4, "little")
                count = np.minimum(sums[at], 65535).astype(np.uint16)
                out.append((int(own["part"].iloc[0]), zlib.compress(head + gaps.tobytes() + count.view(np.uint8).reshape(-1, 2).T.tobytes(), 1), int(w)))
        return pd.DataFrame(out, columns=["part", "data", "w"])

    n = parts.count()
    if n > 256 << (bits - SLICE_BITS):
        groups = n // (256 << (bits - SLICE_BITS)) + 1
        parts = parts.withColumn("g", (F.rand(5) * groups).cast("int")).groupBy("part", "g").applyInPandas(partial, "part int, data binary, w int")
        parts = parts.withColumnRenamed("w", side) if side else parts.drop("w")
    cells = np.zeros(1 << bits, dtype=np.uint8)
    for k, data in parts.groupBy("part").applyInPandas(total, "part int, cells binary").toLocalIterator():
        cells[k << SLICE_BITS : (k + 1) << SLICE_BITS] = np.frombuffer(zlib.decompress(bytes(data)), dtype=np.uint8)
    return cells


class Shared:
    """A byte array sent to the workers compressed, and opened once in each worker process."""

    _open: dict[str, np.ndarray] = {}

    def __init__(self, spark: SparkSession, array: np.ndarray):
        self.sent = spark.sparkContext.broadcast(zlib.compress(array.tobytes(), 1))
        self.key = uuid.uuid4().hex

    @property
    def value(self) -> np.ndarray:
        if self.key not in Shared._open:
            Shared._open.clear()
            Shared._open[self.key] = np.frombuffer(zlib.decompress(self.sent.value), dtype=np.uint8)
        return Shared._open[self.key]


def id_filter(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A Bloom filter with two probes over a column of longs: bits and mask; its size is bounded, not the id count.

    Partial filters are united on the executors by a tree of fan-in 32.
    """
    n = ids.count()
    bits = int(min(27, max(16, np.ceil(np.log2(max(n, 1) * 16)))))
    mask = (1 << bits) - 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.zeros(1 << bits, dtype=bool)
        some = False
        for batch in batches:
            for p in _probes(batch.column(0).to_numpy(zero_copy_only=False), mask):
                b[p] = True
            some = some or batch.num_rows > 0
        if some:
            yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(np.packbits(b).tobytes(), 1)]})

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                b |= np.frombuffer(zlib.decompress(x), dtype=np.uint8)
        yield pa.RecordBatch.from_pydict({"bits": [zlib.compress(b.tobytes(), 1)]})

    width = max(1, min(4096, n // 500_000 + 1))
    parts = ids.coalesce(width).mapInArrow(build, "bits binary")
    while width > 32:
        width = width // 32 + 1
        parts = parts.repartition(width).mapInArrow(unite, "bits binary")
    out = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for (x,) in parts.collect():
        out |= np.frombuffer(zlib.decompress(bytes(x)), dtype=np.uint8)
    return np.unpackbits(out).astype(bool), mask


def _probes(ids: np.ndarray, mask: int) -> list[np.ndarray]:
    h = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x5BD1E995))
    return [(h & np.uint64(mask)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(mask)).astype(np.int64)]


def member(packed: np.ndarray, mask: int, ids: np.ndarray) -> np.ndarray:
    a, b = _probes(ids, mask)
    return ((packed[a >> 3] << (a & 7).astype(np.uint8)) & (packed[b >> 3] << (b & 7).astype(np.uint8)) & 128).astype(bool)


def keep_ids(df: DataFrame, col: str, ids: DataFrame) -> DataFrame:
    """Rows of df whose id may be in ids (a superset; an exact join has to follow).  Other columns stay in the JVM."""
    bits, mask = id_filter(ids)
    filt = Shared(df.sparkSession, np.packbits(bits))

    @F.pandas_udf("boolean")
    def may(x: pd.Series) -> pd.Series:
        return pd.Series(member(filt.value, mask, x.fillna(-1).to_numpy(dtype=np.int64)))

    return df.filter(F.col(col).isNotNull()).filter(may(F.col(col)))
