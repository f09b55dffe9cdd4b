import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from loomwright.tuner import actions as act
from loomwright.tuner import eventlog
from loomwright.tuner import planner as pl
from loomwright.tuner import profile as prof
from loomwright.tuner.apply import Tuner, analyze, apply_action

COLUMNS = "stage_id long, idx int, executor_id string, run_time long, gc_time long, input_records long, input_bytes long, mem_spilled long, disk_spilled long, sr_records long, sr_bytes long, fetch_wait long, sw_records long, sw_bytes long"


def stage(spark, n, **columns):
    base = {"run_time": [100] * n, "gc_time": [0] * n, "input_records": [1] * n, "sr_records": [0] * n, "sr_bytes": [0] * n, "mem_spilled": [0] * n, "sw_bytes": [10] * n, "fetch_wait": [0] * n} | columns
    rows = [(1, i, "e", base["run_time"][i], base["gc_time"][i], base["input_records"][i], 0, base["mem_spilled"][i], 0, base["sr_records"][i], base["sr_bytes"][i], base["fetch_wait"][i], 0, base["sw_bytes"][i]) for i in range(n)]
    return prof.profile(spark.createDataFrame(rows, COLUMNS)).first()


def chosen(row, policies=pl.DEFAULT):
    return pl.first_valid(pl.Instance("p", 1, [row]), policies)


def test_empty_tasks(spark):
    a = chosen(stage(spark, 8, input_records=[0] * 3 + [1] * 5))
    assert (a.kind, a.num_partitions, a.policy) == (act.PARTITIONS, 5, "empty-tasks")
    assert chosen(stage(spark, 3, input_records=[0] * 3)).num_partitions == 1


def test_spill(spark):
    assert chosen(stage(spark, 10, mem_spilled=[15] * 10)).num_partitions == 25
    assert chosen(stage(spark, 10)).kind == act.NONE


def test_garbage_collection(spark):
    a = chosen(stage(spark, 10, run_time=[800] * 10, gc_time=[100] * 9 + [800]))
    assert (a.num_partitions, a.policy) == (17, "garbage-collection")
    assert chosen(stage(spark, 10, run_time=[800] * 9 + [0], gc_time=[100] * 10)).policy != "garbage-collection"


def test_imbalance(spark):
    slow = [100] * 9 + [10_000]
    a = chosen(stage(spark, 10, run_time=slow, sr_records=slow, sr_bytes=slow))
    assert (a.kind, a.partitioner) == (act.PARTITIONER, "range")
    mixed = [5, 6] * 5
    assert chosen(stage(spark, 10, run_time=slow, sr_records=mixed, sr_bytes=mixed)).message == "inherent"
    assert chosen(stage(spark, 10, run_time=slow, sr_records=slow, sr_bytes=mixed)).message == "variable cost"


def test_fetch_wait_and_custom_policies(spark):
    row = stage(spark, 4, fetch_wait=[90, 90, 0, 0])
    assert pl.fetch_wait(pl.Instance("p", 1, [row])).num_partitions == 8
    assert chosen(row, [*pl.DEFAULT, ("own", lambda i: act.Action(i.point, act.WARN, message="own"))]).message == "own"


def instance(point, rdd, n, records, rdds=3, name="s", **more):
    row = Row(stage_id=rdd, name=name, num_rdds=rdds, num_tasks=n, empty_tasks=0, records_read=records, spilled=more.get("spilled", 0), shuffle_write=100, gc_skew=None, gc_target=None, gc_partitions=None, run_skew=None, corr_bytes=0.0, corr_records=0.0, blocked_tasks=0, run_max_over_mean=more.get("mm", 1.0), gc_max_over_mean=more.get("gc_mm", 1.0), gc_max=8, gc_min=2)
    return pl.Instance(point, rdd, [row])


def test_planners():
    once = pl.make_plan([instance("a", 1, 10, 5, spilled=50)])
    assert [(x.kind, x.num_partitions) for x in once["a"]] == [(act.PARTITIONS, 15), (act.NONE, 0)]
    regular = pl.make_plan([instance("a", 1, 10, 100, spilled=50), instance("a", 2, 10, 95, spilled=90), instance("a", 3, 10, 95, rdds=4, spilled=90)])
    assert [x.num_partitions for x in regular["a"]] == [15, 19, 19, 0]
    irregular = pl.make_plan([instance("a", 1, 10, 100), instance("a", 2, 10, 250), instance("a", 3, 10, 1)])
    assert [x.num_partitions for x in irregular["a"]] == [10, 25, 1, 0]
    pair = pl.make_plan([instance("a", 1, 10, 5, spilled=50), instance("b", 2, 10, 5, spilled=10)], pairs=[("a", "b")])
    assert [x.num_partitions for x in pair["b"]] == [15, 0]


def test_actions(tmp_path):
    a = act.Action("p", act.PARTITIONS, 4)
    assert a.scaled(0.01).num_partitions == 1 and a.scaled(2.3).num_partitions == 10
    assert a.most(act.Action("p", act.PARTITIONS, 9)).num_partitions == 9
    assert act.Action("p").most(a) is a and act.Action("p", act.WARN).most(a) is a
    r = act.Action("p", act.PARTITIONER, partitioner="range")
    assert r.most(a) is r and not act.Action("p").valid
    act.save({"p": [a, r]}, str(tmp_path / "plan.json"))
    plan = act.load(str(tmp_path / "plan.json"))
    cursor = act.Cursor({"p-join": plan["p"]})
    assert [cursor.next("p", "join").kind for _ in range(3)] == [act.PARTITIONS, act.PARTITIONER, act.PARTITIONER]
    assert cursor.next("other").kind == act.NONE


def test_apply(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert apply_action(df, ["k"], act.Action("p", act.PARTITIONS, 7)).rdd.getNumPartitions() == 7
    assert apply_action(df, ["k"], act.Action("p"), 3).rdd.getNumPartitions() == 3
    assert "rangepartitioning" in apply_action(df, ["k"], act.Action("p", act.PARTITIONER, partitioner="range"), 3)._jdf.queryExecution().executedPlan().toString()


def test_event_log(spark, tmp_path):
    """A written log with a retried task, a task that is not logged and a stage without an adaptable RDD."""
    rdd = lambda i, scope: {"RDD ID": i, "Name": "x", "Parent IDs": [], "Callsite": "c", **({"Scope": json.dumps(scope)} if scope else {})}
    submit = lambda s, n, rdds, attempt=0: {"Event": "SparkListenerStageSubmitted", "Stage Info": {"Stage ID": s, "Stage Attempt ID": attempt, "Stage Name": f"n{s}", "Number of Tasks": n, "Parent IDs": [], "RDD Info": rdds}, "Properties": {"loomwright.point": "here"}}
    end = lambda s, i, attempt, ms, reason="Success": {"Event": "SparkListenerTaskEnd", "Stage ID": s, "Task End Reason": {"Reason": reason}, "Task Info": {"Index": i, "Attempt": attempt, "Executor ID": "1"}, **({"Task Metrics": {"Executor Run Time": ms, "Input Metrics": {"Records Read": 5}}} if reason == "Success" else {})}
    events = [
        submit(0, 4, [rdd(1, {"id": "1", "name": "Exchange"}), rdd(2, None)]), submit(0, 9, [], 1), submit(1, 1, [rdd(3, {"id": "2", "name": "map"})]),
        end(0, 0, 0, 1, "ExecutorLost"), end(0, 0, 1, 10), end(0, 1, 0, 10), end(0, 2, 0, 10), end(1, 0, 0, 5), {"Event": "SparkListenerJobStart"},
    ]
    # Files are named by the cluster manager; the status file beside rolled parts is no log.
    for name in ("application_1700_0001", "app-20240101-0000", "local-1700", "eventlog_v2_x/events_1_x"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(map(json.dumps, events)))
        assert [(x.kind, x.num_partitions) for x in analyze(spark, str(path))["here"]] == [(act.PARTITIONS, 3), (act.NONE, 0)]
    (tmp_path / "eventlog_v2_x/appstatus_x").write_text("\n".join(map(json.dumps, events)))
    assert eventlog.read_events(spark, str(tmp_path / "eventlog_v2_x")).count() == len(events) - 1
    (tmp_path / "log").write_text("\n".join(map(json.dumps, events)))
    plan = analyze(spark, str(tmp_path / "log"))
    assert [(x.kind, x.num_partitions) for x in plan["here"]] == [(act.PARTITIONS, 3), (act.NONE, 0)]
    tuner = Tuner(spark, str(tmp_path / "log"))
    with tuner.point("here"):
        df = tuner.shuffle(spark.range(10), "here", "id")
    assert df.rdd.getNumPartitions() == 3
    tuner.add_policy(lambda i: act.Action(i.point, act.WARN))
    assert tuner.cursor.at == {"here": 0}
    counted = Tuner(spark, str(tmp_path / "log")).aggregate(spark.range(10).selectExpr("id % 4 AS k"), "here", ["k"], F.count("*").alias("n"))
    assert sorted(map(tuple, counted.collect())) == [(0, 3), (1, 3), (2, 2), (3, 2)]
    (tmp_path / "lines").write_text("a\nb\n")
    assert Tuner(spark, str(tmp_path / "log")).read_lines(str(tmp_path / "lines"), "here").rdd.getNumPartitions() == 3
    joined = tuner.join(spark.range(5), spark.range(3, 9), "here", "id")
    assert sorted(r["id"] for r in joined.collect()) == [3, 4]


@pytest.mark.parametrize("policies", [pl.DEFAULT, pl.LEGACY])
def test_policy_sets(policies):
    assert chosen(instance("p", 1, 10, 5, spilled=250).stage, policies).num_partitions == (35 if policies is pl.DEFAULT else 25)


def test_legacy_policies():
    legacy = lambda **more: chosen(instance("p", 1, 10, 5, **more).stage, pl.LEGACY)
    assert legacy(gc_mm=2.0).kind == act.NONE and legacy(gc_mm=2.1).num_partitions == 40
    assert legacy(mm=1.9).kind == act.NONE and legacy(mm=2.1).message == "inherent"
    rows = [instance("p", 1, 10, 5, rdds=n).stage for n in (2, 5, 3)]
    assert pl.Instance("p", 1, rows, pl.most_rdds).stage.num_rdds == 5


def test_points_and_dependencies(spark):
    """Named and unnamed points, a scan, and three parents that are chained."""
    rdd = "array<struct<`RDD ID`: bigint, Name: string, Scope: string, `Parent IDs`: array<bigint>, Callsite: string>>"
    rows = [(1, "s", 2, "own", [], [(11, "x", '{"id":"1","name":"Exchange"}', [], "")]), (2, "s", 2, None, [], [(12, "y", '{"id":"1","name":"FileScan text"}', [], "")]),
            (3, "s", 2, None, [], [(13, "adaptive z", '{"id":"1","name":"join"}', [], "")]), (4, "s", 2, "end", [1, 2, 3], [(14, "x", '{"id":"1","name":"Exchange"}', [], "")])]
    stages = spark.createDataFrame(rows, f"stage_id long, name string, num_tasks int, point string, parent_ids array<bigint>, rdds {rdd}")
    found = eventlog.points(stages, eventlog.stage_rdds(stages))
    assert {r["stage_id"]: (r["point"], r["operator"], r["named"]) for r in found.collect()} == {1: ("own", "Exchange", True), 2: ("y-Scan", "Scan", False), 3: ("adaptive z", "join", True), 4: ("end", "Exchange", True)}
    assert sorted(map(tuple, eventlog.dependent_points(found).collect())) == [("adaptive z", "own"), ("own", "y-Scan")]
    assert {r["stage_id"] for r in eventlog.points(stages, eventlog.stage_rdds(stages), only_adaptive=True).collect()} == {1, 3, 4}


def test_one_pass_over_the_tasks(spark):
    """Task lines are parsed once and shuffled by stage once, without a join or a copy of all events on disk; hash aggregation keeps the last attempts."""
    from loomwright.plans import log_queries

    ended, stages, _ = log_queries._found(spark, "/root/testdata/sf0.001")
    plan = prof.profile(eventlog.task_metrics(ended, stages))._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("from_json") == 1
    assert "Join" not in plan and "SortAggregate" not in plan
