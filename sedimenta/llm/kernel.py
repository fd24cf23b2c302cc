"""Vectorised text kernels (numpy) shared by the operators of this subpackage.

They run inside ``mapInArrow``: a whole Arrow batch is turned into code points
once and words, word triples and character windows come out as flat arrays, so
that no Python loop touches single words.  Work is cut into slices of about a
million characters, which bounds the memory of a task whatever the batch holds;
a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)
_ALNUM: np.ndarray | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least n of each."""
    global _POW, _INV
    if len(_POW) < n:
        m = max(n, 2 * len(_POW), SLICE_CHARS + 4096)
        _POW = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, _BASE, dtype=np.uint64)]))
        _INV = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(m - 1, _BASE_INV, dtype=np.uint64)]))
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def alnum_table() -> np.ndarray:
    """For every code point whether it is a letter or a digit."""
    global _ALNUM
    if _ALNUM is None:
        t = np.zeros(0x110000, dtype=bool)
        for lo, hi in ((0, 0x3400), (0xA000, 0xABFF), (0xF900, 0x10000), (0x10000, 0x12000), (0x1D400, 0x1F200)):
            t[lo:hi] = [chr(c).isalnum() for c in range(lo, hi)]
        t[0x3400:0xA000] = [chr(c).isalnum() for c in range(0x3400, 0xA000)]
        t[0xAC00:0xD7A4] = True
        t[0x12000:0x1D400] = [chr(c).isalnum() for c in range(0x12000, 0x1D400)]
        t[0x1F200:0x32000] = [chr(c).isalnum() for c in range(0x1F200, 0x32000)]
        _ALNUM = t
    return _ALNUM


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each closed by a zero, and the offsets of the texts (one more than texts)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    return cp, offsets


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    pw, _ = _powers(len(cp) + 1)
    h = np.zeros(len(cp) + 1, dtype=np.uint64)
    np.cumsum((cp.astype(np.uint64) + np.uint64(0x51ED27)) * pw[: len(cp)], out=h[1:])
    return h


def range_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of cp[start:end], equal for equal content wherever it stands."""
    _, inv = _powers(len(h))
    return mix((h[end] - h[start]) * inv[start])


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_CHARS characters and fewer than 65,000 texts."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and (size + len(t) > SLICE_CHARS or i - at >= 60_000):
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


class Words:
    """Words of a slice of texts: hash, text index and character range of each."""

    def __init__(self, texts: list[str], lower: bool = True):
        cp, offsets = code_points([t.lower() for t in texts] if lower else texts)
        word = alnum_table()[cp]
        edge = np.diff(word.astype(np.int8), prepend=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)  # every text ends in a zero, so every word is closed
        self.hash = range_hash(prefix_hash(cp), self.start, self.end)
        self.text = np.searchsorted(offsets, self.start, side="right") - 1
        self.offsets = offsets
        self.n_texts = len(texts)
        self._cp = cp


def triples(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word and 40-bit hash of every sequence of three words within one text.

    Forty bits leave room for a text number and a frequency class in one sortable
    64-bit key.  Two triples of one comparison (some 250) fall together with a
    chance below 1e-7; across texts a collision only adds a candidate.
    """
    n = len(w.hash)
    if n < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(w.text[:-2] == w.text[2:])
    a, b, c = w.hash[first], w.hash[first + 1], w.hash[first + 2]
    return first, mix(a * np.uint64(3) + b * np.uint64(0x9E3779B1) + c * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(24)


def paragraphs(w: Words, least: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, 40-bit hash and words of every line with at least so many words; spelling of words counts, spacing doesn't."""
    if not len(w.hash):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    lines = np.flatnonzero((w._cp == 10) | (w._cp == 0))
    line = np.searchsorted(lines, w.start)
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    n = np.diff(np.append(first, len(line)))
    at = (np.arange(len(line)) - np.repeat(first, n)).astype(np.uint64)
    sums = np.add.reduceat(mix(w.hash + at * np.uint64(0x9E3779B97F4A7C15)), first)
    long = n >= least
    return w.text[first[long]], mix(sums[long]) >> np.uint64(24), n[long]


def distinct(text: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, 40-bit gram) in order."""
    key = np.sort((text.astype(np.uint64) << np.uint64(40)) | gram)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1)


def bounds(text: np.ndarray, n_texts: int) -> np.ndarray:
    """Where each text's run begins in a sorted column of text numbers (one more than texts)."""
    return np.searchsorted(text, np.arange(n_texts + 1))


def pack(gram: np.ndarray) -> bytes:
    """40-bit grams as five bytes each."""
    return gram.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), dtype=np.uint8)
    wide[:, :5] = raw
    return wide.view("<u8").ravel()
