from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwright.functions import stats
from loomwright.operators import profile
from loomwright.sinks import text as sinks
from loomwright.sources import text


def test_byte_counts_round_trip(spark, tmp_path):
    (tmp_path / "in").write_text("a b 5\na b 7\nc 1\n")
    counts = profile.byte_count_per_key(text.byte_counts(text.read_lines(spark, str(tmp_path / "in"))), F.col("key"), F.col("bytes"))
    assert sorted(tuple(r) for r in counts.collect()) == [("ab", 2, 12), ("c", 1, 1)]
    sinks.write_byte_counts(counts.coalesce(1), str(tmp_path / "out"))
    assert sorted(next(Path(tmp_path, "out").glob("part-*")).read_text().split("\n"))[1:] == ["ab\t2\t12", "c\t1\t1"]


def test_cumulative_shares(spark):
    freq = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "key string, n long")
    rows = {r["n"]: (r["keys"], r["cdf"], r["ccdf"]) for r in profile.cumulative_shares(freq).collect()}
    assert rows == {1: (2, 0.5, 0.5), 2: (1, 1.0, 0.0)}


def test_key_files_and_sinks(spark, tmp_path):
    for part, keys in (("app/1/2/part-0", "b\na\n"), ("app/1/2/part-1", "a\n"), ("app/1/3/part-0", "c\n")):
        path = tmp_path / "keydist" / part
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(keys)
    rows = text.key_files(spark, str(tmp_path / "keydist"))
    assert rows.count() == 4 and {tuple(r) for r in rows.select("app", "stage", "dependency").distinct().collect()} == {("app", "1", "2"), ("app", "1", "3")}
    freq = profile.key_frequencies(rows, "key")
    sinks.write_key_frequencies(freq, str(tmp_path / "agg"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "agg")).orderBy("value").collect()] == ["a 2", "b 1", "c 1"]
    sizes = text.file_sizes(spark, str(tmp_path / "keydist"))
    assert {r["length"] for r in sizes.collect()} == {4, 2}
    sets = spark.createDataFrame([([2, 1], 3)], "items array<int>, support long")
    sinks.write_itemsets(sets, str(tmp_path / "sets"))
    assert spark.read.text(str(tmp_path / "sets")).first()["value"] == "1,2 3"
    path = sinks.write_sample(spark.range(100).select(F.col("id").cast("string").alias("value")), str(tmp_path / "s"), 0.5, 1)
    assert path.endswith("s-0.5-1.sample") and 20 < spark.read.text(path).count() < 80


def test_first_by_total(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 2, 2), ("a", 3, 4), ("b", 9, 5)], "app string, dependency int, bytes long")
    assert sorted(tuple(r) for r in profile.first_by_total(rows).collect()) == [("a", 4, 3), ("a", 5, 1), ("b", 5, 9)]


def one(spark, values, column):
    return spark.createDataFrame([(float(v), float(w)) for v, w in values], "x double, y double").agg(column).first()[0]


def test_statistics(spark):
    v = [(x, 7) for x in (1, 2, 3, 10)]
    assert one(spark, v, stats.sample_skewness(F.col("x"))) == pytest.approx(1.7636326)
    assert [one(spark, v, stats.legacy_percentile(F.col("x"), p)) for p in (0.25, 0.5, 0.75, 0.0, 1.0)] == [1.25, 2.5, 8.25, 1.0, 10.0]
    assert one(spark, v, stats.guarded_correlation(F.col("x"), F.col("y"))) == 1.0
    assert one(spark, [(1, 0), (2, 0)], stats.guarded_correlation(F.col("x"), F.col("y"))) == 0.0
    assert one(spark, [(1, 3), (2, 2), (3, 1)], stats.guarded_correlation(F.col("x"), F.col("y"))) == pytest.approx(-1)
    assert one(spark, [(1, 1)], stats.sample_skewness(F.col("x"))) is None
    assert one(spark, [(0, 0)], stats.max_over_mean(F.col("x"))) == 1.0
    assert one(spark, [(4, 0)], F.max(stats.ratio(F.col("x"), F.col("y")))) is None


def test_keys_by_dependency(spark, tmp_path):
    """Of dependencies with equal bytes in an application the first counts; each has a listing of its own."""
    parts = {"app1/1/1/part-0": "b\na\n", "app1/1/1/part-1": "a\n", "app1/1/2/part-0": "c\nc\nd\n", "app1/2/1/part-0": "long key\n", "app2/1/2/part-0": "z\ny\nx\n"}
    for part, keys in parts.items():
        path = tmp_path / "keydist" / part
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(keys)
    from loomwright import cli

    cli.run(spark, cli.parser().parse_args(["keys", "--input", str(tmp_path / "keydist")]))
    out = tmp_path / "keydist-aggregated"
    got = {str(d.relative_to(out)): [line for f in sorted(d.glob("part-*")) for line in f.read_text().split("\n")[:-1]] for d in out.glob("*/*/*")}
    assert got == {"app=app1/stage=1/dependency=1": ["a 2", "b 1"], "app=app1/stage=2/dependency=1": ["long key 1"], "app=app2/stage=1/dependency=2": ["x 1", "y 1", "z 1"]}


def test_views_and_named_queries(spark, tmp_path, capsys):
    import json

    from loomwright import cli

    spark.range(5).write.parquet(str(tmp_path / "tables/numbers"))
    spark.range(3).write.parquet(str(tmp_path / "tables/others"))
    (tmp_path / "q.sql").write_text("SELECT count(*) FROM numbers n JOIN others o ON n.id = o.id")
    assert text.register_views(spark, str(tmp_path / "tables")) == ["numbers", "others"]
    cli.run(spark, cli.parser().parse_args(["query", "--input", str(tmp_path / "tables"), "--name", "q1", "--sql", str(tmp_path / "q.sql"), "--iterations", "2"]))
    out = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert out["query"] == "q1" and len(out["milliseconds"]) == 2 and out["tables"] == ["numbers", "others"]
