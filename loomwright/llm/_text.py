"""Shared pieces of the text operators: 64-bit mixing, word hashes and bounded batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)
BASE = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser, elementwise."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHash(dict):
    """word -> 64-bit hash, remembered for at most ``limit`` words."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def array(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def slices(sizes: np.ndarray, most: int, rows: int = 30_000) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges whose sizes add up to about ``most`` (a larger row stands alone)."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and (total + size > most or i - start >= rows):
            yield start, i
            start, total = i, 0
        total += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Sub-batches of bounded text size; the text is the column named ``text``."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sizes = np.fromiter((len(t) if t else 1 for t in texts), np.int64, len(texts))
        for a, b in slices(sizes, most):
            yield batch.slice(a, b - a), texts[a:b]


def grams(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` values (unmixed; a run may cross a boundary of documents)."""
    if len(values) < n:
        return np.empty(0, np.uint64)
    out = values[: len(values) - n + 1].copy()
    for k in range(1, n):
        out *= BASE
        out += values[k : len(values) - n + 1 + k]
    return out
