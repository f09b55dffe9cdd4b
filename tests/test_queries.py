"""Every registered query against its SQL twin, on the smallest tables."""

import oracle
import pytest

from loomwright.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert not oracle.differences(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE_SQL[name]).df())


def test_sample_is_repeatable(spark):
    a, b = (QUERIES["sample_rows"](spark, SF).toPandas() for _ in range(2))
    assert a.equals(b) and 50 < len(a) < 150


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_date_range_is_inclusive(spark):
    from loomwright.plans.workloads import ranked_visits, time_query

    visits = spark.createDataFrame(
        [("ip", "u", "1998-12-31 23:59:59", 1.0), ("ip", "u", "1999-01-01 00:00:00", 2.0), ("ip", "u", "2000-01-01 23:59:59", 4.0), ("ip", "u", "2000-01-02 00:00:00", 8.0), ("ip", "x", "1999-06-01 00:00:00", 16.0)],
        "sourceIP string, destURL string, visitDate string, adRevenue double",
    ).withColumn("visitDate", __import__("pyspark.sql.functions", fromlist=["x"]).col("visitDate").cast("timestamp"))
    rankings = spark.createDataFrame([("u", 3), ("v", 9)], "pageURL string, pageRank int")
    assert [tuple(r) for r in ranked_visits(rankings, visits).collect()] == [("ip", 3.0, 6.0)]
    assert len(time_query(spark, "SELECT 1", 2)) == 2


def test_date_range_is_pushed_down(spark):
    from loomwright.plans.registry import join_rankings_visits

    plan = join_rankings_visits(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
