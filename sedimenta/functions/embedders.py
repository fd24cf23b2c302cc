"""Text to vectors through a callback: a protocol, a deterministic stand-in, a factory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


class Embedder(Protocol):
    dimension: int

    def embed_texts(self, texts: list[str]) -> np.ndarray: ...

    def embed_query(self, text: str) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of lower-cased words, of unit length.  A stand-in for a trained model, not one."""

    def __init__(self, dimension: int = 256):
        self.dimension = dimension

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = crc32(w.encode())
                out[i, h % self.dimension] += 1 if h >> 31 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size > 0, size, 1)

    def embed_query(self, text: str) -> np.ndarray:
        return self.embed_texts([text])[0]


EMBEDDERS: dict[str, Callable[..., Embedder]] = {"hashing": HashingEmbedder}


def create_embedder(backend: str = "hashing", **settings) -> Embedder:
    """An embedder by name; others are registered in EMBEDDERS.  ValueError for an unknown one."""
    if backend not in EMBEDDERS:
        raise ValueError(f"unknown embedder {backend!r}; known: {', '.join(sorted(EMBEDDERS))}")
    return EMBEDDERS[backend](**settings)


def embed(text: Column, embedder: Embedder, batch: int = 64) -> Column:
    """array<float> of each text, in Arrow batches cut to ``batch`` texts a call; null for null."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[np.ndarray | None] = []
            for a in range(0, len(s), batch):
                some = s.iloc[a : a + batch]
                for t, v in zip(some, embedder.embed_texts([x or "" for x in some])):
                    out.append(None if t is None else v)
            yield pd.Series(out, dtype="object")

    return run(text)


def generate(rows: DataFrame, answer: Callable[[str], str], column: str = "instruction", to: str = "generated", attempts: int = 3, pause: float = 1.0) -> DataFrame:
    """rows with ``to`` = answer(column) and ``error``: a callback that fails is asked again after pause * 2**n seconds.

    What it raises last becomes the row's error, and the answer is null.
    """
    import time

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            got, error = None, None
            for n in range(attempts):
                try:
                    got, error = answer(x), None
                    break
                except Exception as e:
                    error = str(e)
                    if n + 1 < attempts:
                        time.sleep(pause * 2**n)
            out.append((got, error))
        return pd.DataFrame(out, columns=["answer", "error"])

    return rows.withColumn("_a", run(F.col(column))).select("*", F.col("_a.answer").alias(to), F.col("_a.error").alias("error")).drop("_a")
