"""Positions and running sums in a global order, without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def with_prefix(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """Add ``position`` (from 0) and, for each column of ``sums``, ``before_<column>``: its sum over earlier rows.

    The rows are range-partitioned and checkpointed; totals of partitions, one row each, give every
    partition its offset.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = placed.withColumn("part", F.shiftright("place", 33))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(f"total_{c}") for c in sums])
    none = F.lit(0).cast("long")
    totals = totals.select(F.col("part").alias("of_part"), F.coalesce(F.sum("rows").over(earlier), none).alias("rows_before"), *[F.coalesce(F.sum(f"total_{c}").over(earlier), none).alias(f"offset_{c}") for c in sums])
    inner = [F.coalesce(F.sum(c).over(upto), none).alias(f"inner_{c}") for c in sums]
    joined = placed.select("*", *inner).join(totals, F.col("part") == F.col("of_part"))
    position = F.col("rows_before") + F.col("place") - F.shiftleft("part", 33)
    return joined.select(*rows.columns, position.alias("position"), *[(F.col(f"offset_{c}") + F.col(f"inner_{c}")).alias(f"before_{c}") for c in sums])
