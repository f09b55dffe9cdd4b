"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the sets of its hashed words, leading letters of words (inflected forms share
them), word pairs and pairs with one word between them. FTRL-proximal keeps a learning rate per
coordinate and an L1 threshold, so most weights are exactly zero; only the others are broadcast to the
scoring tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import BASE, WordHash, mix, text_slices

#: Most labelled documents that training uses; above it, a hash of doc_id picks about as many.
TRAIN_ROWS = 6_000
BITS = 20
THRESHOLD = 0.7
#: Leading letters of a word that make a feature of their own.
STEM = 4

_WORDS = re.compile(r"\w+")
_U = np.uint64


def _features(texts: list[str | None], words: WordHash) -> tuple[np.ndarray, np.ndarray]:
    """(document index, feature index) of every occurrence of a feature."""
    lists = [_WORDS.findall(t.lower()) if t else [] for t in texts]
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    flat = [w for x in lists for w in x]
    h = words.array(flat)
    out = [(doc, mix(h)), (doc, mix(words.array([w[:STEM] for w in flat]) + _U(0x27D4EB2F)))]
    for gap, salt in ((1, _U(0x51ED270B)), (2, _U(0xC2B2AE35))):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            out.append((doc[:-gap][same], mix(h[:-gap][same] * BASE + h[gap:][same] + salt)))
    return np.concatenate([d for d, _ in out]), np.concatenate([f >> _U(64 - BITS) for _, f in out]).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """The weights that are not zero, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scorer(self):
        dense = np.zeros(1 << BITS)
        dense[self.index] = self.weight
        words, bias = WordHash(), self.bias

        def score(texts: list[str | None]) -> np.ndarray:
            doc, feature = _features(texts, words)
            some = dense[feature] != 0
            pairs = np.unique(doc[some] * (1 << BITS) + feature[some])
            total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], len(texts)) + bias
            return 1 / (1 + np.exp(-np.clip(total, -35, 35)))

        return score


def ftrl(
    rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.0, epochs: int = 5, seed: int = 7
) -> Model:
    """Fit by FTRL-proximal: one example at a time, a rate per coordinate, L1 by thresholding z.

    ``rows`` holds the distinct features of each example, ``labels`` 0 or 1.
    """
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= np.where(i == size, 0, l1), 0.0, (np.sign(zi) * np.where(i == size, 0, l1) - zi) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = np.append(rows[k], np.int32(size))
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[k]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    index = np.flatnonzero(np.abs(z[:size]) > l1)
    return Model(index, weights(index), float(weights(np.array([size]))[0]))


def held_out(doc_id: str = "doc_id"):
    """True for the rows that training must not use: crc32 of doc_id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, y, text) of at most about ``train_rows`` labelled documents that are not held out.

    ``labels`` has doc_id and toxic; rows with a null in either are ignored, and a document labelled
    twice is toxic if any label says so. A hash of doc_id picks the rows, so that the sample, and the
    broadcast of its ids, is bounded at any input size.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    share = min(1.0, train_rows / max(known.count(), 1))
    picked = known.where((F.xxhash64("doc_id") % 1_000_003 + 1_000_003) % 1_000_003 < int(share * 1_000_003))
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "y", "text")


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Train on the documents that ``training_rows`` picks, in one task.

    Only the weights that are not zero reach the driver. Without rows to learn from, every score is one half.
    """
    rows = training_rows(docs, labels, train_rows)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for batch, texts in text_slices(batches):
            doc, feature = _features(texts, words)
            pairs = np.unique(doc * (1 << BITS) + feature)
            ends = np.searchsorted(pairs, np.arange(len(texts) + 1) << BITS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y").cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))],
                ["doc_id", "y", "features"],
            )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        ids = table["doc_id"].to_numpy()
        features = [x.values.to_numpy() for x in table["features"]]
        y = table["y"].to_numpy()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], features[k].tobytes(), y[k]))
        model = ftrl([features[k] for k in order], y[order])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.index, -1), pa.int64()), pa.array(np.append(model.weight, model.bias))], ["index", "weight"])

    found = rows.mapInArrow(encode, "doc_id long, y int, features array<int>").repartition(1).mapInArrow(train, "index long, weight double").toArrow()
    index, weight = found["index"].to_numpy(), found["weight"].to_numpy()
    return Model(index[:-1], weight[:-1], float(weight[-1])) if len(index) else Model(index, weight, 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and its score from 0 to 1 for the whole text; a null or empty text gets the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(texts))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch, texts in text_slices(batches):
            yield batch.filter(pa.array(scorer(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
