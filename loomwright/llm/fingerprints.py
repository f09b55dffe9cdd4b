"""Document fingerprints: Order MinHash over occurrence-numbered k-mers.

A fingerprint has ``sketches`` parts. For each part every k-mer of characters, numbered by its
occurrence, gets a hash of its own; the ``keep`` k-mers with the smallest hashes are put in text order
and hashed as a tuple. Parts of two texts agree when they select the same k-mers in the same order, so
the share of equal parts falls with edit distance, not only with lost k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import GOLD, grams, mix

K = 8
KEEP = 2
SKETCHES = 32

_U = np.uint64
_TOP = np.uint32((1 << 32) - 1)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def numbered(codes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each k-mer together with its occurrence number, in text order.

    A text shorter than ``k`` is one k-mer; an empty one has none.
    """
    codes = codes.astype(np.uint64)
    if 0 < len(codes) < k:
        return mix(grams(mix(codes + GOLD), len(codes)) + _U(len(codes)))
    h = mix(grams(codes + GOLD, k))
    n = len(h)
    if n < 2:
        return h
    bits = _U(max(1, int(n - 1).bit_length()))
    ordered = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
    again = np.flatnonzero(np.diff(ordered >> bits) == 0) + 1
    if len(again):
        runs = np.flatnonzero(np.diff(again, prepend=-1) != 1)
        occurrence = again - np.repeat(again[runs], np.diff(runs, append=len(again))) + 1
        place = (ordered[again] & ((_U(1) << bits) - _U(1))).astype(np.int64)
        h[place] = mix(h[place] + GOLD * occurrence.astype(np.uint64))
    return h


def order_minhash(text: str, k: int = K, keep: int = KEEP, sketches: int = SKETCHES) -> np.ndarray:
    """The parts of the fingerprint as unsigned 32-bit numbers; an empty text gives zeros."""
    h = numbered(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), k)
    n = len(h)
    if n == 0:
        return np.zeros(sketches, np.uint32)
    factors = (mix(np.arange(1, sketches + 1, dtype=np.uint64) * GOLD) >> _U(32)).astype(np.uint32) | np.uint32(1)
    short = (h >> _U(32)).astype(np.uint32)
    keep = min(keep, n)
    picked = np.empty((sketches, keep), np.int64)
    step = max(1, (1 << 19) // n)
    for a in range(0, sketches, step):
        values = short[None, :] * factors[a : a + step, None]
        rows = np.arange(len(values))
        for j in range(keep):
            picked[a : a + step, j] = least = values.argmin(axis=1)
            values[rows, least] = _TOP
    chosen = h[np.sort(picked, axis=1)]
    state = np.arange(sketches, dtype=np.uint64)
    for j in range(keep):
        state = mix(state * GOLD + chosen[:, j])
    return (state >> _U(32)).astype(np.uint32)


def edited(text: str, following: str) -> str:
    """The text with its last floor(n/2) characters replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _in_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, extra): each partition holds a run of ascending doc_id, and behind it the next row.

    Runs end at approximate quantiles of doc_id, as many as there are shuffle partitions, so that the
    texts are shuffled once; only the first doc_id of each run passes through the driver. The last
    run is followed by the first row of all.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("doc_key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select("doc_key").approxQuantile("doc_key", [i / wanted for i in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    cuts = np.array(sorted({int(c) for c in cuts}), np.int64)

    @F.pandas_udf("int")
    def run_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right").astype(np.int32))

    heads = sorted((r.run, r.head) for r in rows.select("doc_key", run_of("doc_key").alias("run")).groupBy("run").agg(F.min("doc_key").alias("head")).collect())
    starts = np.array([h for _, h in heads], np.int64)
    runs = max(1, len(starts))

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        k = keys.to_numpy()
        run = np.searchsorted(starts, k, side="right") - 1
        return pd.Series([[r, (r - 1) % runs] if head else [r] for r, head in zip(run.tolist(), (starts[run] == k).tolist(), strict=True)])

    dealt = rows.withColumn("places", places("doc_key")).select("*", F.posexplode("places").alias("extra", "run")).drop("places")
    return dealt.repartitionById(runs, F.col("run")).sortWithinPartitions("extra", "doc_key", "text").select("doc_id", "text", "extra")


def fingerprint_pairs(docs: DataFrame, k: int = K, keep: int = KEEP, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness.

    The next document is the next by doc_id (null first, equal ids by text), after the last the first.
    Null texts count as empty, repeated rows each for themselves; further columns are ignored; an empty
    table gives no rows. Likeness is the share of equal parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        done = False
        out: list[tuple] = []
        for batch in batches:
            for doc_id, value, extra in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("extra").to_pylist(), strict=True):
                if done:
                    continue
                text = value.as_py()
                parts = order_minhash(text, k, keep, sketches)
                if before:
                    was, old, own = before
                    new = edited(old, text)
                    other = own if new == old else order_minhash(new, k, keep, sketches)
                    out.append((was, len(old), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u4").tobytes().hex(), other.astype(">u4").tobytes().hex(), float((own == other).mean()), float((own == parts).mean())))
                before, done = (doc_id, text, parts), bool(extra)
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)

    names = [x.split()[0] for x in RESULT.split(", ")]
    return _in_runs(docs).mapInArrow(run, RESULT)


def op10_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))
