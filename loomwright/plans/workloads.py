"""SQL workloads: revenue by source, ranked visits within a range of dates, and a timing harness."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def revenue_by_source(visits: DataFrame) -> DataFrame:
    """Sum of adRevenue for each sourceIP."""
    return visits.groupBy("sourceIP").agg(F.sum("adRevenue").alias("sumAdRevenue"))


def ranked_visits(rankings: DataFrame, visits: DataFrame, start: str = "1999-01-01", end: str = "2000-01-01") -> DataFrame:
    """Average pageRank and total revenue for each sourceIP over visits from start to end, both included, highest revenue first.

    The dates are compared as a range on the column itself, so that Parquet can skip row groups.
    """
    within = visits.where((F.col("visitDate") >= F.lit(start).cast("timestamp")) & (F.col("visitDate") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    joined = rankings.join(within, rankings["pageURL"] == within["destURL"])
    return joined.groupBy("sourceIP").agg(F.avg("pageRank").alias("avgPageRank"), F.sum("adRevenue").alias("totalRevenue")).orderBy(F.desc("totalRevenue"))


def time_query(spark: SparkSession, query: str | Callable[[SparkSession], DataFrame], iterations: int = 3) -> list[float]:
    """Milliseconds of each run of a query over the registered views, without keeping its rows."""
    out = []
    for _ in range(iterations):
        began = time.perf_counter()
        df = spark.sql(query) if isinstance(query, str) else query(spark)
        df.write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - began) * 1000)
    return out


def run_benchmark(spark: SparkSession, name: str, queries: dict[str, str], iterations: int = 3) -> dict:
    """Name, milliseconds of each run and tables read of one of the named queries."""
    plan = spark.sql(queries[name])._jdf.queryExecution().analyzed().toString()
    tables = sorted(t.lower() for t in set(re.findall(r"SubqueryAlias `?(\w+)`?", plan)) if spark.catalog.tableExists(t))
    return {"query": name, "milliseconds": time_query(spark, queries[name], iterations), "tables": tables}
