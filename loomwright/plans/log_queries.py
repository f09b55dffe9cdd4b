"""Queries of the tuner over an event log that is made from lineitem, and their SQL twins.

A stage for each supplier, a task for each of its lines (first in the order of order and line number):
its JSON lines go through the same parser, profiles, policies and planners as a log on disk. The log is
made in two parts, ends of tasks and submissions of stages; a query makes those that it needs. Suppliers
take turns in having empty tasks, spills, skewed garbage collection and skewed run times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, table
from ..tuner import eventlog, planner
from ..tuner.actions import Cursor, Plan
from ..tuner.apply import partitions_of, plan_events
from ..tuner.profile import profile

#: Visits of each point that ``planned_partitions`` asks for, and the default that it has without a plan.
VISITS, DEFAULT_PARTITIONS = 6, 7

_S = "CAST(l_suppkey AS BIGINT)"
_Q = "CAST(floor(l_quantity) AS BIGINT)"
_P = "CAST(floor(l_extendedprice) AS BIGINT)"
#: Metrics of a task, in SQL that both engines read.
_METRICS = {
    "run_time": f"CASE WHEN {_S} % 4 = 3 AND l_quantity >= 49 THEN 40 * {_P} ELSE {_P} END",
    "gc_time": f"CAST(floor(l_extendedprice / 64) AS BIGINT) * CASE WHEN {_S} % 4 = 2 AND l_tax >= 0.08 THEN 60 ELSE 1 END",
    "input_records": f"CASE WHEN {_S} % 4 = 0 AND l_quantity <= 2 THEN 0 ELSE {_Q} END * CASE WHEN {_S} % 5 = 2 THEN {_S} ELSE 1 END",
    "input_bytes": f"{_Q} * 100",
    "mem_spilled": f"CASE WHEN {_S} % 4 = 1 AND l_discount >= 0.08 THEN {_P} ELSE 0 END",
    "sr_bytes": f"{_P} * CASE WHEN {_S} % 8 = 3 AND l_quantity >= 49 THEN 40 ELSE 1 END",
    "sr_records": f"CASE WHEN {_S} % 8 = 3 AND l_quantity >= 49 THEN 4 * {_P} WHEN {_S} % 8 = 3 THEN {_P} ELSE 0 END",
    "fetch_wait": f"CASE WHEN {_S} % 4 = 0 AND l_tax >= 0.07 THEN {_P} ELSE 0 END",
    "sw_records": _Q,
    "sw_bytes": f"CAST(floor(l_extendedprice / 2) AS BIGINT)",
}
#: Properties of a stage, by its number and that of its tasks.
_STAGE = {
    "num_tasks": "logged + CASE WHEN stage_id % 6 = 5 THEN 2 ELSE 0 END",
    "name": "'stage ' || CAST(stage_id % 7 AS STRING)",
    "own_point": "CASE WHEN stage_id % 6 <> 0 THEN 'point ' || CAST(stage_id % 5 AS STRING) END",
    "rdd_id": "10 * CAST(floor(stage_id / 8) AS BIGINT) + 1",
    "rdd_name": "CASE WHEN stage_id % 12 = 0 THEN 'an adaptive one' ELSE 'rdd ' || CAST(stage_id % 2 AS STRING) END",
    "num_rdds": "CASE WHEN stage_id % 13 = 4 THEN 1 WHEN stage_id % 3 = 0 THEN 3 ELSE 2 END",
}


def _log_lines(spark: SparkSession, d: str, parents: bool) -> tuple[DataFrame, DataFrame]:
    """(value) of the lines for ends of tasks and for submissions of stages; with ``parents`` every stage reads the two before it, else only the ninth does."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    # Numbered first: the columns of the table are fewer than the metrics that are made from them.
    numbered = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", (F.row_number().over(order) - 1).alias("i"))
    tasks = numbered.select(F.expr(f"{_S} AS s"), "i", F.expr("CAST(l_partkey % 4 AS STRING) AS executor"), F.expr("l_quantity <= 1 AS lost"), *[F.expr(f"{v} AS {k}") for k, v in _METRICS.items()])
    nested = lambda **c: F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k.replace("_", " ")) for k, v in c.items()])
    metrics = nested(
        Executor_Run_Time="run_time", JVM_GC_Time="gc_time", Memory_Bytes_Spilled="mem_spilled", Disk_Bytes_Spilled=F.lit(0),
        Input_Metrics=nested(Records_Read="input_records", Bytes_Read="input_bytes"),
        Shuffle_Read_Metrics=nested(Total_Records_Read="sr_records", Remote_Bytes_Read=F.expr("sr_bytes div 3"), Local_Bytes_Read=F.expr("sr_bytes - sr_bytes div 3"), Fetch_Wait_Time="fetch_wait"),
        Shuffle_Write_Metrics=nested(Shuffle_Records_Written="sw_records", Shuffle_Bytes_Written="sw_bytes"),
    )
    # A lost task ends twice: without metrics first, then with them.
    ends = tasks.withColumn("attempt", F.explode(F.when(F.col("lost"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    bad = F.col("lost") & (F.col("attempt") == 0)
    end = nested(
        Event=F.lit("SparkListenerTaskEnd"), Stage_ID="s", Task_End_Reason=nested(Reason=F.when(bad, "ExecutorLostFailure").otherwise("Success")),
        Task_Info=nested(Index="i", Attempt="attempt", Executor_ID="executor"), Task_Metrics=F.when(~bad, metrics),
    )
    stages = tasks.groupBy(F.col("s").alias("stage_id")).agg(F.count(F.lit(1)).alias("logged")).select("stage_id", *[F.expr(f"{v} AS {k}") for k, v in _STAGE.items()])
    scope = lambda k, name: F.lit(f'{{"id":"{k}","name":"{name}"}}')
    rdd = lambda at, name, s: nested(RDD_ID=at, Name=name, Scope=s, Parent_IDs=F.array().cast("array<bigint>"))
    narrow, wide, scan = rdd(F.col("stage_id") * 100, F.lit("m"), scope(3, "map")), rdd(F.col("rdd_id"), F.col("rdd_name"), scope(2, "Exchange hashpartitioning")), rdd(F.col("stage_id") * 100 + 2, F.lit("t"), scope(2, "FileScan text"))
    feeds = F.array(F.col("stage_id") - 2, F.col("stage_id") - 1)
    info = nested(
        Stage_ID="stage_id", Stage_Attempt_ID=F.lit(0), Stage_Name="name", Number_of_Tasks="num_tasks",
        Parent_IDs=feeds if parents else F.when(F.col("stage_id") == 9, feeds).otherwise(F.array().cast("array<bigint>")),
        RDD_Info=F.when(F.col("num_rdds") == 1, F.array(narrow)).when(F.col("num_rdds") == 2, F.array(narrow, wide)).otherwise(F.array(narrow, wide, scan)),
    )
    submitted = nested(Event=F.lit("SparkListenerStageSubmitted"), Stage_Info=info, Properties=F.create_map(F.lit(eventlog.POINT_PROPERTY), F.col("own_point")))
    # Generators: a projection would make the line again for every condition on it.
    line = lambda event: F.explode(F.array(F.to_json(event))).alias("value")
    return ends.select(line(end)), stages.select(line(submitted))


def _events(spark: SparkSession, d: str, parents: bool = False) -> tuple[DataFrame, DataFrame]:
    """(ends of tasks, submissions of stages)."""
    ended, submitted = map(eventlog.parse_events, _log_lines(spark, d, parents))
    return ended, submitted


def _found(spark: SparkSession, d: str, parents: bool = False, only_adaptive: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ends of tasks, stages, points)."""
    ended, submitted = _events(spark, d, parents)
    stages = cut(eventlog.stages(submitted))
    return ended, stages, eventlog.points(stages, eventlog.stage_rdds(stages), only_adaptive)


def _instances(spark: SparkSession, d: str, choose=planner.latest) -> list[planner.Instance]:
    ended, stages, found = _found(spark, d)
    return planner.instances_of(profile(eventlog.task_metrics(ended, stages)), found, choose)


def log_task_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Every task of every stage, those that were never logged with zeros."""
    ended, submitted = _events(spark, d)
    return eventlog.task_metrics(ended, cut(eventlog.stages(submitted))).select("stage_id", "idx", *_METRICS)


def log_points(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)[2].select("stage_id", "name", "num_rdds", "rdd_id", "operator", "point", "named")


def log_points_only_adaptive(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d, only_adaptive=True)[2].select("stage_id", "point")


def dependent_points(spark: SparkSession, d: str) -> DataFrame:
    return eventlog.dependent_points(_found(spark, d, parents=True)[2])


def _actions(spark: SparkSession, instances: list[planner.Instance], policies) -> DataFrame:
    rows = []
    for i in instances:
        a = planner.first_valid(i, policies)
        rows.append((i.point, i.rdd_id, i.stage.stage_id, a.kind, a.num_partitions, a.partitioner, a.message, a.policy))
    return spark.createDataFrame(rows, "point string, rdd_id long, stage_id long, kind string, num_partitions long, partitioner string, message string, policy string")


def policy_actions(spark: SparkSession, d: str) -> DataFrame:
    """The first valid action for each visit of a point."""
    return _actions(spark, _instances(spark, d), planner.DEFAULT)


def policy_actions_legacy(spark: SparkSession, d: str) -> DataFrame:
    """The older policies, thresholds and choice of a stage."""
    return _actions(spark, _instances(spark, d, planner.most_rdds), planner.LEGACY)


def policy_fetch_wait(spark: SparkSession, d: str) -> DataFrame:
    return _actions(spark, _instances(spark, d), [("fetch-wait", planner.fetch_wait)])


def point_classes(spark: SparkSession, d: str) -> DataFrame:
    """Whether the planner takes each point as iterative and as regular."""
    points: dict[str, list[planner.Instance]] = {}
    for i in sorted(_instances(spark, d), key=lambda i: i.rdd_id):
        points.setdefault(i.point, []).append(i)
    return spark.createDataFrame([(p, planner.is_iterative(own), planner.is_regular(own)) for p, own in points.items()], "point string, iterative boolean, regular boolean")


def _plan(spark: SparkSession, d: str) -> Plan:
    ended, submitted = _events(spark, d)
    return plan_events(ended, submitted=submitted)


def log_plan(spark: SparkSession, d: str) -> DataFrame:
    """The whole plan of the log."""
    return planner.plan_rows(spark, _plan(spark, d))


def planned_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The partitions that visits of each point get, the last ones after the plan is used up."""
    plan = _plan(spark, d)
    cursor = Cursor(plan)
    rows = [(p, k, partitions_of(cursor.next(p), DEFAULT_PARTITIONS)) for p in plan for k in range(VISITS)]
    return spark.createDataFrame(rows, "point string, visit int, partitions long")


QUERIES = {
    f.__name__: f
    for f in (log_task_metrics, log_points, log_points_only_adaptive, dependent_points, policy_actions, policy_actions_legacy, policy_fetch_wait, point_classes, log_plan, planned_partitions)
}


def _percentile(q: int) -> str:
    v, n = "list_sort(list(gc))", "count(gc)"
    pos = f"({q / 4} * ({n} + 1))"
    low = f"CAST(floor({pos}) AS BIGINT)"
    return f"CASE WHEN {pos} < 1 THEN {v}[1] WHEN {pos} >= {n} THEN {v}[{n}] ELSE {v}[{low}] + ({pos} - {low}) * ({v}[{low} + 1] - {v}[{low}]) END"


def _corr(y: str) -> str:
    return f"CASE WHEN sum(run_time) = 0 OR sum({y}) = 0 THEN 0.0 WHEN min(run_time) = max(run_time) OR min({y}) = max({y}) OR count(*) < 2 THEN 1.0 ELSE corr(run_time, {y}) END"


_TASKS = f"""logged AS (SELECT {_S} AS stage_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _METRICS.items())} FROM lineitem),
s AS (SELECT stage_id, {', '.join(f'{v} AS {k}' for k, v in _STAGE.items())} FROM (SELECT stage_id, count(*) AS logged FROM logged GROUP BY stage_id)),
t AS (SELECT e.stage_id, e.idx, {', '.join(f'coalesce({k}, 0) AS {k}' for k in _METRICS)} FROM (SELECT stage_id, unnest(range(num_tasks)) AS idx FROM s) e LEFT JOIN logged l ON e.stage_id = l.stage_id AND e.idx = l.idx)"""
_POINTS = f"""{_TASKS},
p AS (SELECT stage_id, name, num_rdds, rdd_id, 'Exchange' AS operator, own_point IS NOT NULL OR rdd_name LIKE '%adaptive%' AS named,
      coalesce(own_point, CASE WHEN rdd_name LIKE '%adaptive%' THEN rdd_name ELSE rdd_name || '-Exchange' END) AS point FROM s WHERE num_rdds > 1)"""
_PROFILE = f"""{_POINTS},
x AS (SELECT *, CASE WHEN run_time <> 0 THEN CAST(gc_time AS DOUBLE) / run_time END AS gc FROM t),
f AS (SELECT stage_id, count(*) AS n, count(*) FILTER (WHERE input_records + sr_records = 0) AS empty, CAST(sum(mem_spilled) AS DOUBLE) AS spilled, CAST(sum(sw_bytes) AS DOUBLE) AS written, sum(input_records + sr_records) AS records,
      CASE WHEN count(gc) = count(*) THEN skewness(gc) END AS gc_skew, {_percentile(2)} AS q2, {_percentile(3)} AS q3, skewness(run_time) AS run_skew, {_corr('sr_bytes')} AS cb, {_corr('sr_records')} AS cr,
      count(*) FILTER (WHERE run_time <> 0 AND CAST(fetch_wait AS DOUBLE) / run_time > 0.8) AS blocked, max(run_time) / avg(run_time) AS run_mm, max(gc_time) / avg(gc_time) AS gc_mm, max(gc_time) AS gc_max, min(gc_time) AS gc_min FROM x GROUP BY stage_id),
g AS (SELECT stage_id, least(CASE WHEN q2 > 0 THEN q2 END, CASE WHEN q3 > 0 THEN q3 END) AS target FROM f),
h AS (SELECT stage_id, CAST(sum(greatest(1, ceil(gc / target))) AS BIGINT) AS split FROM x JOIN g USING (stage_id) GROUP BY stage_id),
inst AS (SELECT point, rdd_id, max(stage_id) AS stage_id FROM p GROUP BY ALL)"""


def _chain(*policies: tuple[str, str, str, str, str, str]) -> str:
    """Columns of the first policy (name, condition, kind, number, partitioner, message) whose condition holds."""
    out = []
    for k, (column, none) in enumerate((("kind", "'none'"), ("num_partitions", "0"), ("partitioner", "''"), ("message", "''"))):
        out.append(f"CASE {' '.join(f'WHEN {p[1]} THEN {p[2 + k]}' for p in policies)} ELSE {none} END AS {column}")
    out.append(f"CASE {' '.join(f'WHEN {p[1]} THEN ' + repr(p[0]) for p in policies)} ELSE '' END AS policy")
    return ", ".join(out)


def _unbalanced(skew: str, limit: float, high: float) -> tuple[str, str, str, str, str, str]:
    both = f"cb >= {high} AND cr >= {high}"
    return ("task-imbalance", f"{skew} > {limit}", f"CASE WHEN {both} THEN 'partitioner' ELSE 'warn' END", "0", f"CASE WHEN {both} THEN 'range' ELSE '' END", f"CASE WHEN {both} THEN '' WHEN cb < {high} AND cr < {high} THEN 'inherent' ELSE 'variable cost' END")


def _number(name: str, condition: str, number: str) -> tuple[str, str, str, str, str, str]:
    return (name, condition, "'partitions'", f"CAST(greatest(1, {number}) AS BIGINT)", "''", "''")


_EMPTY = _number("empty-tasks", "empty > 0", "n - empty")
_FIRST = _chain(_EMPTY, _number("spill", "written > 0 AND spilled > 0", "n + ceil(spilled / written * n)"), _number("garbage-collection", "gc_skew > 1.5 AND target IS NOT NULL", "split"), _unbalanced("run_skew", 1.5, 0.8))
_OLDER = _chain(_EMPTY, _number("spill", "written > 0 AND spilled > 0", "floor(spilled / written * n)"), _number("garbage-collection", "gc_mm > 2 AND gc_min > 0", "floor(CAST(gc_max AS DOUBLE) / gc_min * n)"), _unbalanced("run_mm", 2.0, 0.7))
_BLOCKED = _chain(_number("fetch-wait", "blocked > 0", "n + 2 * blocked"))
_ALL = "inst JOIN f USING (stage_id) JOIN g USING (stage_id) LEFT JOIN h USING (stage_id)"
_MAPS = """m AS (SELECT point, rdd_id, name, max_by(records, stage_id) AS records FROM p JOIN f USING (stage_id) GROUP BY ALL),
o AS (SELECT point, rdd_id, row_number() OVER (PARTITION BY point ORDER BY rdd_id) AS i, count(*) OVER (PARTITION BY point) AS visits FROM inst),
near AS (SELECT a.point, bool_and(greatest(x.records, y.records) = 0 OR least(x.records, y.records) / greatest(x.records, y.records) >= 0.9) AS regular
  FROM o a JOIN o b ON a.point = b.point AND b.i = a.i + 1 JOIN m x ON x.point = a.point AND x.rdd_id = a.rdd_id JOIN m y ON y.point = b.point AND y.rdd_id = b.rdd_id AND x.name = y.name GROUP BY a.point),
kinds AS (SELECT point, max(visits) > 1 AS iterative, coalesce(regular, true) AS regular FROM o LEFT JOIN near USING (point) GROUP BY point, regular)"""


def _most(field: str, a: str = "v", b: str = "a") -> str:
    larger = f"{a}.kind = 'partitions' AND {b}.kind = 'partitions'"
    return f"CASE WHEN {larger} THEN CASE WHEN {a}.num_partitions >= {b}.num_partitions THEN {a}.{field} ELSE {b}.{field} END WHEN {a}.kind IN ('none', 'warn') THEN {b}.{field} ELSE {a}.{field} END"


_FIELDS = ("kind", "num_partitions", "partitioner", "message", "policy")
_PLAN = f"""RECURSIVE {_PROFILE}, {_MAPS},
a AS (SELECT o.point, o.i, o.visits, num_rdds, f.n, f.records, {_FIRST} FROM o JOIN {_ALL} ON o.point = inst.point AND o.rdd_id = inst.rdd_id JOIN (SELECT stage_id, num_rdds FROM p) r USING (stage_id)),
fold AS (SELECT point, i, num_rdds, {', '.join(_FIELDS)}, false AS changed FROM a WHERE i = 1
  UNION ALL SELECT a.point, a.i, a.num_rdds, {', '.join(f"CASE WHEN a.num_rdds = v.num_rdds THEN v.{c} ELSE {_most(c)} END" for c in _FIELDS)}, a.num_rdds <> v.num_rdds FROM fold v JOIN a ON a.point = v.point AND a.i = v.i + 1),
regular AS (SELECT v.point, v.i, {', '.join(f"CASE WHEN w.changed THEN w.{c} ELSE v.{c} END AS {c}" for c in _FIELDS)} FROM fold v LEFT JOIN fold w ON w.point = v.point AND w.i = v.i + 1),
head AS (SELECT point, CASE WHEN kind = 'none' THEN 'partitions' ELSE kind END AS kind, CASE WHEN kind = 'none' THEN n ELSE num_partitions END AS num_partitions, partitioner, message, CASE WHEN kind = 'none' THEN 'irregular' ELSE policy END AS policy, records FROM a WHERE i = 1),
irregular AS (SELECT a.point, a.i, head.kind, CASE WHEN a.i = 1 OR head.kind <> 'partitions' OR head.records = 0 THEN head.num_partitions ELSE greatest(1, CAST(ceil(a.records / head.records * head.num_partitions) AS BIGINT)) END AS num_partitions, head.partitioner, head.message, head.policy FROM a JOIN head USING (point)),
planned AS (SELECT point, i, {', '.join(f"CASE WHEN NOT iterative THEN a.{c} WHEN regular THEN r.{c} ELSE q.{c} END AS {c}" for c in _FIELDS)}
  FROM a JOIN kinds USING (point) JOIN regular r USING (point, i) JOIN irregular q USING (point, i)),
pair AS (SELECT least(x.point, y.point) AS one, greatest(x.point, y.point) AS two FROM p x JOIN p y ON x.stage_id = 7 AND y.stage_id = 8 AND x.point <> y.point WHERE EXISTS (SELECT 1 FROM p WHERE stage_id = 9)),
shared AS (SELECT one, two, v.i, {', '.join(f"{_most(c)} AS {c}" for c in _FIELDS)} FROM pair JOIN planned v ON v.point = one JOIN planned a ON a.point = two AND a.i = v.i),
final AS (SELECT * FROM planned WHERE point NOT IN (SELECT one FROM pair UNION SELECT two FROM pair)
  UNION ALL SELECT one, i, {', '.join(_FIELDS)} FROM shared UNION ALL SELECT two, i, {', '.join(_FIELDS)} FROM shared),
plan AS (SELECT point, CAST(i - 1 AS INTEGER) AS position, {', '.join(_FIELDS)} FROM final UNION ALL SELECT point, CAST(max(i) AS INTEGER), 'none', 0, '', '', 'wildcard' FROM final GROUP BY point)"""

ORACLE_SQL = {
    "log_task_metrics": f"WITH {_TASKS} SELECT stage_id, idx, {', '.join(_METRICS)} FROM t",
    "log_points": f"WITH {_POINTS} SELECT stage_id, name, num_rdds, rdd_id, operator, point, named FROM p",
    "log_points_only_adaptive": f"WITH {_POINTS} SELECT stage_id, point FROM p WHERE named",
    "dependent_points": f"WITH {_POINTS} SELECT DISTINCT least(x.point, y.point) AS a, greatest(x.point, y.point) AS b FROM p x JOIN p y ON y.stage_id = x.stage_id + 1 JOIN p z ON z.stage_id = x.stage_id + 2 WHERE x.point <> y.point",
    "policy_actions": f"WITH {_PROFILE} SELECT point, rdd_id, stage_id, {_FIRST} FROM {_ALL}",
    "policy_actions_legacy": f"WITH {_PROFILE}, old AS (SELECT point, rdd_id, max_by(stage_id, CAST(num_rdds AS BIGINT) * 1000000000 - stage_id) AS stage_id FROM p GROUP BY ALL) SELECT point, rdd_id, stage_id, {_OLDER} FROM {_ALL.replace('inst', 'old', 1)}",
    "policy_fetch_wait": f"WITH {_PROFILE} SELECT point, rdd_id, stage_id, {_BLOCKED} FROM {_ALL}",
    "point_classes": f"WITH {_PROFILE}, {_MAPS} SELECT point, iterative, regular FROM kinds",
    "log_plan": f"WITH {_PLAN} SELECT point, position, {', '.join(_FIELDS)} FROM plan",
    "planned_partitions": f"""WITH {_PLAN}, ends AS (SELECT point, max(position) AS last FROM plan GROUP BY point)
        SELECT point, CAST(visit AS INTEGER) AS visit, CASE WHEN kind = 'partitions' THEN num_partitions ELSE {DEFAULT_PARTITIONS} END AS partitions
        FROM ends CROSS JOIN range({VISITS}) r(visit) JOIN plan USING (point) WHERE position = least(visit, last)""",
}
ORACLE_SQL = {name: sql.replace("AS STRING", "AS VARCHAR") for name, sql in ORACLE_SQL.items()}
