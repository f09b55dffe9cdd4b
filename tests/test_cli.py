import json

from loomwright import cli


def run(spark, *args):
    cli.run(spark, cli.parser().parse_args([str(a) for a in args]))


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "baskets").write_text("1 2\n1 2\n3\n")
    (tmp_path / "edges").write_text("1 2\n2 1\n5 6\n")
    (tmp_path / "sizes").write_text("a b 5\na b 7\n")
    for miner in ("levelwise", "projected", "fpgrowth"):
        run(spark, "itemsets", "--input", tmp_path / "baskets", "--miner", miner, "--min-support", 0.5, "--partitions", 2, 3, "--output", tmp_path / miner)
        assert sorted(r["value"] for r in spark.read.text(str(tmp_path / miner)).collect()) == ["1 2", "1,2 2", "2 2"]
    run(spark, "itemsets", "--input", tmp_path / "baskets")
    run(spark, "pagerank", "--input", tmp_path / "edges", "--static", "--output", tmp_path / "ranks")
    assert spark.read.parquet(str(tmp_path / "ranks")).count() == 4
    run(spark, "pagerank", "--input", tmp_path / "edges", "--iterations", 2)
    capsys.readouterr()
    run(spark, "components", "--input", tmp_path / "edges")
    assert json.loads(capsys.readouterr().out.split("\n")[0]) == {"vertices": 4, "components": 2}
    run(spark, "bytes", "--input", tmp_path / "sizes", "--output", tmp_path / "bytes")
    assert spark.read.text(str(tmp_path / "bytes")).first()["value"] == "ab\t2\t12"
    run(spark, "sample", "--input", tmp_path / "baskets", "--fraction", 1.0)
    assert "1.0-42.sample" in capsys.readouterr().out


def test_plan_of_a_real_log(tmp_path):
    """A job writes its log under a named point; the plan that follows from it leaves its answer unchanged."""
    import subprocess
    import sys
    import textwrap

    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(__import__('pathlib').Path(cli.__file__).resolve().parents[1])!r})
        from loomwright.session import local_session
        from loomwright.tuner.apply import Tuner
        from pyspark.sql import functions as F
        log = {str(tmp_path)!r}
        spark = local_session(2, 8, **{{"spark.eventLog.enabled": "true", "spark.eventLog.dir": log, "spark.driver.memory": "1g",
            "spark.sql.adaptive.coalescePartitions.enabled": "false"}})
        run = lambda t: sorted(map(tuple, t.shuffle(spark.range(1000).select((F.col("id") % 3).alias("k")), "counting", "k", default_partitions=8).groupBy("k").count().collect()))
        tuner = Tuner(spark)
        with tuner.point("counting"):
            first = run(tuner)
        spark.stop()
        spark = local_session(2, 8, **{{"spark.eventLog.enabled": "false", "spark.driver.memory": "1g"}})
        again = Tuner(spark, log)
        actions = again.cursor.plan["counting"]
        assert actions[0].kind == "partitions" and actions[0].num_partitions <= 3, actions
        assert run(again) == first
        print("same answer")
    """)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "same answer" in out.stdout, out.stderr[-2000:]
