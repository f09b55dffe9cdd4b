"""Sinks: itemsets, samples, key frequencies and byte counts as text, tables as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_itemsets(itemsets: DataFrame, path: str, sep: str = " ") -> None:
    """``i1,i2 support`` on each line, items ascending."""
    itemsets.select(F.concat_ws(sep, F.array_join(F.sort_array("items"), ","), F.col("support").cast("string"))).write.text(path)


def write_key_frequencies(frequencies: DataFrame, path: str) -> None:
    """``key n`` on each line, in the order of the keys."""
    frequencies.orderBy("key").select(F.concat_ws(" ", "key", F.col("n").cast("string"))).write.text(path)


def write_key_tree(counts: DataFrame, path: str) -> None:
    """Frequencies of (app, stage, dependency, key, n) in a folder for each dependency, ``key n`` on each line, keys ascending."""
    place = ["app", "stage", "dependency"]
    # Dealt by ranges of keys, so that a large dependency fills several files in order.
    rows = counts.repartitionByRange(*place, "key").sortWithinPartitions(*place, "key")
    rows.select(*place, F.concat_ws(" ", "key", F.col("n").cast("string")).alias("value")).write.partitionBy(*place).text(path)


def write_byte_counts(counts: DataFrame, path: str) -> None:
    """key, number and bytes, separated by tabs."""
    counts.select("key", "n", "bytes").write.csv(path, sep="\t")


def write_sample(lines: DataFrame, source: str, fraction: float, seed: int) -> str:
    """A Bernoulli sample of lines beside its source, as ``<source>-<fraction>-<seed>.sample``; returns the path."""
    path = f"{source}-{fraction}-{seed}.sample"
    lines.sample(False, fraction, seed).write.text(path)
    return path


def write_table(df: DataFrame, path: str) -> None:
    df.write.parquet(path)
