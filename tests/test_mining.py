import itertools

import pytest
from pyspark.sql import functions as F

from loomwright.mining.itemsets import fp_growth, levelwise, projected
from loomwright.sources.text import bad_tokens, baskets

LINES = ["2 1", "3 1 2 5", "1 6", "3 4 1", "3 4 2", "7 3 1", "5 4 2 1"]
MINERS = {"levelwise": levelwise, "fp_growth": fp_growth, "projected": projected}


def lines(spark, rows, partitions=2):
    return spark.createDataFrame([(r,) for r in rows], "value string").repartition(partitions)


def brute(rows, min_support):
    sets = [{int(t) for t in r.split() if t.lstrip("-").isdigit()} for r in rows]
    least = int(min_support * len(sets))
    items = sorted(set().union(*sets)) if sets else []
    out = {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            n = sum(set(c) <= s for s in sets)
            if n > least:
                out[c] = n
    return out


def found(df):
    rows = df.collect()
    out = {tuple(sorted(r["items"])): r["support"] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("name", MINERS)
@pytest.mark.parametrize(("support", "size"), [(0.0001, 32), (0.2, 14), (0.3, 6), (0.5, 3), (1.0, 0)])
def test_known_baskets(spark, name, support, size):
    got = found(MINERS[name](baskets(lines(spark, LINES)), support))
    assert len(got) == size and got == brute(LINES, support)


@pytest.mark.parametrize("name", MINERS)
def test_odd_lines(spark, name):
    rows = ["1 1 2", "1 x 2", "", "  1 2", "9", "1 2 3"]
    assert found(MINERS[name](baskets(lines(spark, rows)), 0.3)) == brute(rows, 0.3)
    assert found(MINERS[name](baskets(lines(spark, [])), 0.3)) == {}


@pytest.mark.parametrize("rho", [1, 2, 3])
def test_projection_does_not_depend_on_split(spark, rho):
    assert found(projected(baskets(lines(spark, LINES, 3)), 0.0001, rho=rho, partitions=3)) == brute(LINES, 0.0001)


def test_partition_lists(spark):
    assert found(levelwise(baskets(lines(spark, LINES)), 0.1, partitions=[3, 2])) == brute(LINES, 0.1)


def test_separator_and_bad_tokens(spark):
    assert baskets(lines(spark, ["1,2,2"], 1), ",").first()["items"] == [1, 2]
    assert bad_tokens(lines(spark, ["1 x", " 2 y", ""])).first()["bad"] == 4


def test_supports_fall_with_size(spark):
    got = found(levelwise(baskets(lines(spark, LINES)), 0.0001))
    for items, n in got.items():
        assert all(got[s] >= n for s in itertools.combinations(items, len(items) - 1) if s)


def test_item_order_of_columns(spark):
    assert levelwise(baskets(lines(spark, LINES)), 0.5).where(F.size("items") < 1).count() == 0


@pytest.mark.parametrize("options", [{"mu": 2}, {"mu": 1, "rho": 1}, {"most_paths": 1}, {"mu": 3, "rho": 3, "most_paths": 2, "partitions": 3}])
def test_ways_to_split_the_projection(spark, options):
    rows = [" ".join(str(i) for i in range(1, 9) if (k * 7 + i * i) % 5 > 1) for k in range(40)]
    found = {tuple(r["items"]): r["support"] for r in projected(baskets(lines(spark, rows)), 0.1, **options).collect()}
    assert found == brute(rows, 0.1)


def test_deep_levels(spark):
    rows = ["1 2 3 4 5 6", "1 2 3 4 5 6", "1 2 3 4 6", "2 3 5", "1 4 6"]
    found = {tuple(sorted(r["items"])): r["support"] for r in levelwise(baskets(lines(spark, rows)), 0.3).collect()}
    assert found == brute(rows, 0.3) and max(map(len, found)) == 6
