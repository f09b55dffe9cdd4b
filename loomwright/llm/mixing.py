"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Only DataFrame expressions run here. Sizes are counted once and kept, without texts, in a checkpoint.
A source's target is its weight's share of all words, at most ``max_epochs`` times its size; what is
cut off goes to the others by weight until none is above. A target is met by whole repetitions of the
source and a fractional one: documents in the order of a seeded hash until the words are full, the
last of them in part. Where the fractional repetition ends is found on hash buckets; only documents
of the one bucket of a source in which it ends are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ._order import with_prefix

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = 17
SALTS = 64
#: A run of characters that are neither space nor the control characters from tab to return.
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source goes in and out.

    Sources by code point, null last, take the weights in turn. The water level follows from the order
    of cap / weight: the first k sources are capped, with the least k that leaves the next below its cap.
    Both orders are global ones over any number of sources; only sums and the level reach the driver.
    """
    by_name = F.col("source").asc_nulls_last()
    turn = (F.col("position") % len(weights) + 1).cast("int")
    rows = with_prefix(sizes, [by_name], []).select("source", "source_size", F.element_at(F.array(*[F.lit(w) for w in weights]), turn).cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    rows = rows.withColumn("rise", F.col("cap").cast("double") / F.col("weight"))
    rows = cut(with_prefix(rows, [F.col("rise"), by_name], ["cap", "weight"]))
    total, all_weights = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, open_ = F.lit(total or 0).cast("long") - F.col("before_cap"), F.lit(all_weights or 0).cast("long") - F.col("before_weight")
    fits = rest.cast("double") * F.col("weight") <= F.col("cap").cast("double") * open_.cast("double")
    level = rows.where(fits).agg(F.min(F.struct("position", rest.alias("rest"), open_.alias("open"))).alias("level")).first()["level"]
    target = F.col("cap").cast("double")
    if level:
        share = (F.col("weight") * F.lit(level["rest"]).cast("long")).cast("double") / F.lit(level["open"]).cast("double")
        target = F.when(F.col("position") < level["position"], target).otherwise(share)
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row.

    A null text has no words and is never taken; a null source is a source of its own; rows that
    repeat a doc_id count each for themselves; an empty table gives no rows; further columns are ignored.
    """
    return _mix(docs, weights, max_epochs, seed).select("doc_id", "size", "source_size", "target", "taken")


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    The one document of a source that is taken in part stays if at least half of it is taken. Documents
    without words (null texts too) have nothing to take and go. Rows equal in doc_id, text and source are
    one document: one of them stands for all, with their repetitions added up. Column names may be any.
    """
    taken = _mix(docs, weights, max_epochs, seed).where("taken > 0")
    taken = taken.groupBy(F.col("doc_id").alias("of_doc"), F.col("source").alias("of_source"), F.col("text_key").alias("of_text")).agg(
        F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("times"), F.count(F.lit(1)).alias("n")
    )
    # From a checkpoint, so that both sides of the join are shuffled for it and a hot document can be split.
    taken = cut(taken.where("times > 0"))
    inner = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    marked = docs.toDF(*inner.values()).withColumn("text_key", F.xxhash64(inner["text"]))
    same = F.col(inner["doc_id"]).eqNullSafe(F.col("of_doc")) & F.col(inner["source"]).eqNullSafe(F.col("of_source")) & (F.col("text_key") == F.col("of_text"))
    found = marked.join(taken.where("n = 1"), same)
    if taken.where("n > 1").limit(1).count():
        found = found.union(marked.join(taken.where("n > 1"), same).dropDuplicates(["of_doc", "of_source", "of_text"]))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*inner.values()).toDF(*inner)


def _mix(docs: DataFrame, weights: tuple[int, ...], max_epochs: int, seed: int) -> DataFrame:
    """The columns of ``mix``, source and text_key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    slim = cut(docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("digest")))
    slim = slim.withColumn("bucket", F.conv(F.substring("digest", 1, 3), 16, 10).cast("int"))
    buckets = slim.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    goals = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    whole = F.least(F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0), F.lit(max_epochs)).cast("long")
    goals = goals.withColumn("whole", whole).withColumn("part", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
    same = F.col("source").eqNullSafe(F.col("of"))
    renamed = goals.withColumnRenamed("source", "of")
    ends = (
        buckets.withColumn("upto", upto)
        .join(renamed, same)
        .where(F.col("upto") > F.col("part"))
        .groupBy("source")
        .agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("end"))
    )
    plan = renamed.join(ends, same, "left").select(
        "of", "source_size", "target", "whole", "part", F.coalesce("end.bucket", F.lit(1 << 12)).alias("last"), F.coalesce("end.before", F.lit(0)).alias("before")
    )
    # A source that holds most rows is dealt over as many tasks as there are salts.
    salted = plan.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = slim.join(salted, same & (F.col("bucket") % SALTS == F.col("of_salt"))).drop("of", "of_salt")
    ordered = Window.partitionBy("source").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("part") - F.col("before") - (F.sum("size").over(ordered) - F.col("size"))
    inside = rows.where(F.col("bucket") == F.col("last")).withColumn("extra", F.greatest(F.lit(0), F.least("size", left)))
    outside = rows.where(F.col("bucket") != F.col("last")).withColumn("extra", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(0))
    return inside.unionByName(outside).select("doc_id", "source", "text_key", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken"))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = f"""
WITH slim AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat('{SEED}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS weight, source_size * {MAX_EPOCHS} AS cap FROM s),
r AS (SELECT *, row_number() OVER o AS k,
        coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
        sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        sum(source_size) OVER () AS total
      FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST)),
lvl AS (SELECT k AS k0, total - capped AS rest0, open AS open0 FROM r
        WHERE CAST(total - capped AS DOUBLE) * weight <= CAST(cap AS DOUBLE) * open ORDER BY k LIMIT 1),
g AS (SELECT source, source_size,
        CASE WHEN k0 IS NULL OR k < k0 THEN CAST(cap AS DOUBLE) ELSE CAST(weight * rest0 AS DOUBLE) / CAST(open0 AS DOUBLE) END AS target
      FROM r LEFT JOIN lvl ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {MAX_EPOCHS}) ELSE 0 END AS whole FROM g),
d AS (SELECT slim.doc_id, slim.size, p.source_size, p.target, p.whole,
        CAST(floor(p.target + 0.5) AS BIGINT) - p.whole * p.source_size AS part,
        coalesce(sum(slim.size) OVER (PARTITION BY slim.source ORDER BY digest, doc_id, slim.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM slim JOIN p ON slim.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, part - before)) AS BIGINT) AS taken FROM d
"""
