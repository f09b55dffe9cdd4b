"""Sharding: sort by Hilbert index over quantised metadata, cut the order into runs of equal bytes.

The dimensions are source, language and size, eight bits each: the rank of the value for the first two
(scaled down beyond 256 values) and a logarithmic step for the size. Files cut from this order have
narrow ranges in all three, so a filter on any of them skips files. Equal texts form a group, which has
the least source and language of its rows and lies in one place of the order; a cut goes through a group
only if it is larger than a ``1 / WHOLE`` share of a shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ._order import with_prefix

SHARDS = 24
BITS = 8
LAW = "bytes"
#: Groups of equal texts up to this part of a shard are never cut.
WHOLE = 16


def hilbert_index(axes: list[np.ndarray], bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve through the grid, by Skilling's transposed form."""
    x = [np.array(a, dtype=np.int64) for a in axes]
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
    out = np.zeros_like(t)
    for b in range(bits - 1, -1, -1):
        for a in x:
            out = (out << 1) | (((a ^ t) >> b) & 1)
    return out


def _ranked(rows: DataFrame, name: str) -> DataFrame:
    """Each distinct value of a column with its rank scaled to the grid; one row per value."""
    values = cut(with_prefix(rows.select(F.col(name).alias("value")).distinct(), [F.col("value").asc_nulls_last()], []))
    scale = max(values.count(), 1 << BITS)
    return values.select("value", F.expr(f"(position * {1 << BITS}) div {scale}").cast("long").alias(f"{name}_axis"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    A null text has 0 bytes (size 8) and the checksum of an empty one, with which it forms a group; null
    sources and languages are values of their own, after all others; repeated rows are placed each for
    themselves; an empty table gives no rows; further columns are ignored. A group (of equal texts, told
    by 96 bits of hash and the size) or, if it is larger than a share of a shard, each of its rows belongs to
    the shard in which its middle byte falls, so shards differ from an equal share by at most one of these.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    ))
    placed = rows
    for name in ("source", "lang"):
        ranks = _ranked(rows, name)
        placed = placed.join(ranks, F.col(name).eqNullSafe(F.col("value"))).drop("value")

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy(), b.to_numpy(), c.to_numpy()]))

    length = F.length(F.bin("size")) - 1
    axis = F.least(F.lit((1 << BITS) - 1), (length - 3) * 8 + F.expr("shiftright(size, cast(length(bin(size)) - 4 as int)) & 7L")).cast("long")
    text_key = ["text_hash", "text_crc32", "size"]
    groups = placed.groupBy(*text_key).agg(F.min(F.struct("source_axis", "lang_axis")).alias("least"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    groups = groups.select(*text_key, "rows", "bytes", curve("least.source_axis", "least.lang_axis", axis).alias("curve"))
    groups = cut(with_prefix(groups, [F.col(c) for c in ("curve", *text_key)], ["rows", "bytes"]))
    total = groups.agg(F.sum("bytes")).first()[0] or 1

    groups = groups.select(*[F.col(c).alias(f"of_{c}") for c in text_key], F.col("position").alias("group"), "bytes", "before_rows", "before_bytes")
    same = (F.col("text_hash") == F.col("of_text_hash")) & (F.col("text_crc32") == F.col("of_text_crc32")) & (F.col("size") == F.col("of_size"))
    found = rows.select("doc_id", *text_key).join(groups, same).select("doc_id", "size", "text_crc32", "group", "bytes", "before_rows", "before_bytes")
    found = with_prefix(found, [F.col("group"), F.col("doc_id")], [])
    whole = F.col("bytes") * (WHOLE * shards) <= total
    start = F.col("before_bytes") + F.when(whole, 0).otherwise((F.col("position") - F.col("before_rows")) * F.col("size"))
    found = found.withColumn("start", start).withColumn("unit", F.when(whole, F.col("bytes")).otherwise(F.col("size")))
    found = cut(found.withColumn("shard", F.least(F.lit(shards - 1), F.expr(f"((2 * start + unit) * {shards}) div {2 * total}")).cast("int")))
    first = found.groupBy("shard").agg(F.min("position").alias("first")).withColumnRenamed("shard", "of_shard")
    return found.join(F.broadcast(first), F.col("shard") == F.col("of_shard")).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
