"""Key profiles: frequencies, byte counts, cumulative shares, samples and first-wins dedup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_frequencies(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) in the order of the keys."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("key")


def byte_count_per_key(rows: DataFrame, key: Column, size: Column) -> DataFrame:
    """(key, n, bytes)."""
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))


def cumulative_shares(frequencies: DataFrame) -> DataFrame:
    """(n, keys, cdf, ccdf): for each frequency, the share of all records on keys of at most that frequency.

    Keys are first counted by frequency, so the ordered window runs over distinct frequencies only.
    """
    by_n = frequencies.groupBy("n").agg(F.count(F.lit(1)).alias("keys"))
    upto = F.sum(F.col("n") * F.col("keys")).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum(F.col("n") * F.col("keys")).over(Window.partitionBy())
    return by_n.select("n", "keys", (upto / total).alias("cdf"), (1 - upto / total).alias("ccdf"))


def sample(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """A Bernoulli sample without replacement."""
    return rows.sample(False, fraction, seed)


def first_by_total(sizes: DataFrame) -> DataFrame:
    """Of (app, dependency, bytes), the first dependency of each app with a given total of bytes.

    A dependency may be any value that can be ordered, such as (stage, number).
    """
    totals = sizes.groupBy("app", "dependency").agg(F.sum("bytes").alias("total"))
    return totals.groupBy("app", "total").agg(F.min("dependency").alias("dependency"))


def keys_by_dependency(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """(app, stage, dependency, key, n) of the dependencies that no earlier one of the app equals in bytes.

    ``keys`` has (app, stage, dependency, key), ``sizes`` (app, stage, dependency, bytes) a row per file.
    """
    first = first_by_total(sizes.select("app", F.struct("stage", "dependency").alias("dependency"), "bytes")).select("app", "dependency.*")
    return keys.join(first, ["app", "stage", "dependency"], "left_semi").groupBy("app", "stage", "dependency", "key").agg(F.count(F.lit(1)).alias("n"))
