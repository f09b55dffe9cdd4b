"""Frequent itemsets: level-wise joins, prefix projection and the library's FP-growth.

All three give (items, support) of the sets that occur in more than ``floor(min_support * N)`` of the N
baskets; empty baskets count in N, and an item counts once in a basket.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

ITEMSETS = "items array<int>, support long"
#: Most paths before a suffix that one task mines.
MOST_PATHS = 50_000


def min_count(baskets: DataFrame, min_support: float) -> tuple[int, int]:
    """(number of baskets, the count that a frequent set must exceed)."""
    n = baskets.count()
    return n, math.floor(min_support * n)


def item_frequencies(baskets: DataFrame, threshold: int) -> DataFrame:
    """(item, support) of the items in more than ``threshold`` baskets."""
    return baskets.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") > threshold)


def levelwise(baskets: DataFrame, min_support: float, partitions: list[int] | None = None) -> DataFrame:
    """Level by level over the vertical table (prefix, last, tid), a prefix being the id of a frequent set.

    Sets of a level that share all but the last item meet in their baskets by one grouping on (tid,
    prefix), whose groups are no longer than a basket; a longer set goes on only if its last two items
    are a frequent pair. Supports are partial counts before the shuffle. Only the number of frequent
    sets of a level reaches the driver. ``partitions`` gives the partitions of each level's grouping, the
    last one for all further levels.
    """
    baskets = cut(baskets)
    _, threshold = min_count(baskets, min_support)
    long = baskets.select("tid", F.explode(F.array_distinct("items")).alias("last"))
    frequent = cut(item_frequencies(baskets, threshold).select(F.lit(-1).cast("long").alias("prefix"), F.col("item").alias("last"), F.array("item").alias("items"), F.col("item").cast("long").alias("id"), "support"))
    level = long.join(frequent.select("last", "prefix"), "last").select("prefix", "last", "tid")
    out = frequent.select("items", "support")
    found, depth, doubles = frequent.count(), 0, None
    while found > 1:
        if partitions:
            level = level.repartition(partitions[min(depth, len(partitions) - 1)], "tid", "prefix")
        meeting = level.groupBy("tid", "prefix").agg(F.sort_array(F.collect_list("last")).alias("lasts")).where("size(lasts) > 1")
        pairs = meeting.select("tid", "prefix", "lasts", F.posexplode("lasts").alias("at", "last")).where("at < size(lasts) - 1")
        pairs = pairs.select("tid", "prefix", "last", F.explode(F.slice("lasts", F.col("at") + 2, F.size("lasts"))).alias("next"))
        if doubles is not None:
            pairs = pairs.join(doubles, ["last", "next"], "left_semi")
        pairs = cut(pairs.select("prefix", "last", "next", "tid"))
        counted = pairs.groupBy("prefix", "last", "next").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") > threshold)
        shorter = frequent.select("prefix", "last", F.col("items").alias("short"), F.col("id").alias("short_id"))
        frequent = cut(counted.join(shorter, ["prefix", "last"]).select("prefix", "last", "next", "short_id", F.array_append("short", F.col("next")).alias("items"), F.monotonically_increasing_id().alias("id"), "support"))
        found, depth = frequent.count(), depth + 1
        out = out.union(frequent.select("items", "support"))
        if doubles is None:
            doubles = frequent.select("last", "next")
        if found > 1:
            level = pairs.join(frequent.select("prefix", "last", "next", "short_id"), ["prefix", "last", "next"]).select(F.col("short_id").alias("prefix"), F.col("next").alias("last"), "tid")
        frequent = frequent.select(F.col("short_id").alias("prefix"), F.col("next").alias("last"), "items", "id", "support")
    return out


def fp_growth(baskets: DataFrame, min_support: float, partitions: int | None = None) -> DataFrame:
    """By the library's parallel FP-growth, its threshold set so that the same sets are frequent."""
    from pyspark.ml.fpm import FPGrowth

    baskets = cut(baskets)
    n, threshold = min_count(baskets, min_support)
    if not n or threshold >= n:
        return baskets.sparkSession.createDataFrame([], ITEMSETS)
    growth = FPGrowth(itemsCol="items", minSupport=(threshold + 0.5) / n)
    if partitions:
        growth = growth.setNumPartitions(partitions)
    model = growth.fit(baskets.select(F.array_distinct("items").alias("items")))
    return model.freqItemsets.select(F.sort_array("items").alias("items"), F.col("freq").alias("support"))


def _grow(rows: list[tuple[tuple[int, ...], int]], suffix: tuple[int, ...], threshold: int) -> Iterator[tuple[list[int], int]]:
    """All frequent sets that extend ``suffix`` by items of the weighted paths."""
    counts: Counter = Counter()
    for path, count in rows:
        for item in path:
            counts[item] += count
    for item, support in counts.items():
        if support <= threshold:
            continue
        found = (item, *suffix)
        yield sorted(found), support
        shorter: Counter = Counter()
        for path, count in rows:
            if item in path:
                rest = tuple(x for x in path[: path.index(item)] if counts[x] > threshold)
                if rest:
                    shorter[rest] += count
        if shorter:
            yield from _grow(list(shorter.items()), found, threshold)


def projected(baskets: DataFrame, min_support: float, rho: int = 2, mu: int = 0, partitions: int | None = None, most_paths: int = MOST_PATHS) -> DataFrame:
    """By conditional pattern bases, split over suffixes of ``rho`` items.

    Baskets keep their frequent items, most frequent first, and equal baskets are counted once. Every
    suffix of up to ``rho`` items gets its support by a grouped sum; the paths before a suffix of
    ``rho`` items, again counted once, are mined on their own. A suffix with more than ``most_paths``
    paths is split further, item by item, until its groups are small or used up. ``mu`` > 0 deals the
    baskets by their first ``mu`` items before they are projected, so that equal beginnings meet in a
    task and fold there; it changes the work of tasks, not the result.
    """
    baskets = cut(baskets)
    _, threshold = min_count(baskets, min_support)
    frequent = item_frequencies(baskets, threshold)
    ranked = baskets.select("tid", F.explode(F.array_distinct("items")).alias("item")).join(frequent, "item")
    ordered = ranked.groupBy("tid").agg(F.sort_array(F.collect_list(F.struct(F.negate("support").alias("k"), "item"))).alias("path"))
    paths = ordered.select(F.col("path.item").alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("count"))
    if mu > 0:
        begin = F.slice("path", F.lit(1), F.lit(mu))
        paths = paths.repartition(partitions, begin) if partitions else paths.repartition(begin)
    rows = paths.select(F.array().cast("array<int>").alias("suffix"), "path", "count")
    out, small, depth = None, None, 0
    while True:
        rows = rows.select("suffix", "path", "count", F.posexplode("path").alias("at", "item"))
        rows = rows.select(F.concat(F.array("item"), "suffix").alias("suffix"), F.slice("path", F.lit(1), F.col("at")).alias("path"), "count")
        rows = cut(rows.groupBy("suffix", "path").agg(F.sum("count").alias("count")))
        sums = cut(rows.groupBy("suffix").agg(F.sum("count").alias("support"), F.count_if(F.size("path") > 0).alias("paths")).where(F.col("support") > threshold))
        level = sums.select(F.sort_array("suffix").alias("items"), "support")
        out = level if out is None else out.union(level)
        depth += 1
        rows = rows.where(F.size("path") > 0)
        if depth < rho:
            rows = rows.join(sums.where("paths > 0").select("suffix"), "suffix")
            continue
        here = rows.join(sums.where((F.col("paths") > 0) & (F.col("paths") <= most_paths)).select("suffix"), "suffix")
        small = here if small is None else small.union(here)
        large = sums.where(F.col("paths") > most_paths).select("suffix")
        if not large.limit(1).count():
            break
        rows = rows.join(large, "suffix")

    def mine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(_grow([(tuple(p), int(c)) for p, c in zip(pdf["path"], pdf["count"], strict=True)], tuple(key[0]), threshold))
        return pd.DataFrame(found, columns=["items", "support"])

    groups = small.repartition(partitions, "suffix") if partitions else small
    return out.union(groups.groupBy("suffix").applyInPandas(mine, ITEMSETS))
