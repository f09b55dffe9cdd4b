"""Tables from Spark event logs: stages, their RDDs and the metrics of their tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The local property that names an adaptive point in the log.
POINT_PROPERTY = "loomwright.point"

_RDD = "struct<`RDD ID`: bigint, Name: string, Scope: string, `Parent IDs`: array<bigint>, Callsite: string>"
_STAGE = f"struct<`Stage ID`: bigint, `Stage Attempt ID`: int, `Stage Name`: string, `Number of Tasks`: int, `Parent IDs`: array<bigint>, `RDD Info`: array<{_RDD}>>"
_METRICS = (
    "struct<`Executor Run Time`: bigint, `JVM GC Time`: bigint, `Memory Bytes Spilled`: bigint, `Disk Bytes Spilled`: bigint, "
    "`Input Metrics`: struct<`Records Read`: bigint, `Bytes Read`: bigint>, "
    "`Shuffle Read Metrics`: struct<`Total Records Read`: bigint, `Remote Bytes Read`: bigint, `Local Bytes Read`: bigint, `Fetch Wait Time`: bigint>, "
    "`Shuffle Write Metrics`: struct<`Shuffle Records Written`: bigint, `Shuffle Bytes Written`: bigint>>"
)
SCHEMA = f"Event string, `Stage ID` bigint, `Stage Info` {_STAGE}, Properties map<string, string>, `Task End Reason` struct<Reason: string>, `Task Info` struct<Index: int, Attempt: int, `Executor ID`: string>, `Task Metrics` {_METRICS}"

#: Operators whose output partitions can be chosen; "Scan" stands for the scans of all formats.
ADAPTABLE = ("reduceByKey", "join", "aggregateByKey", "textFile", "partitionBy", "Exchange", "AQEShuffleRead", "Scan")


def parse_events(lines: DataFrame) -> DataFrame:
    """The submissions of stages and ends of tasks among the JSON lines (value) of a log."""
    wanted = F.col("value").contains("SparkListenerStageSubmitted") | F.col("value").contains("SparkListenerTaskEnd")
    # A generator: with a projection, every use of a field would parse the line again.
    return lines.where(wanted).select(F.inline(F.array(F.from_json("value", SCHEMA))))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The parsed events of a log: a file of any name, or a folder of rolled and possibly compressed parts.

    The status files that lie beside rolled parts hold no events.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).where("NOT startswith(_metadata.file_name, 'appstatus')")
    return parse_events(lines)


def stages(events: DataFrame) -> DataFrame:
    """A row per stage id; the first submission counts."""
    info = events.where("Event = 'SparkListenerStageSubmitted'").select(F.col("`Stage Info`").alias("i"), F.col("Properties").alias("p"))
    first = info.groupBy(F.col("i.`Stage ID`").alias("stage_id")).agg(F.min_by(F.struct("i", "p"), F.col("i.`Stage Attempt ID`")).alias("s"))
    return first.select(
        "stage_id", F.col("s.i.`Stage Attempt ID`").alias("attempt"), F.col("s.i.`Stage Name`").alias("name"), F.col("s.i.`Number of Tasks`").alias("num_tasks"),
        F.try_element_at(F.col("s.p"), F.lit(POINT_PROPERTY)).alias("point"),
        F.try_element_at(F.col("s.p"), F.lit("spark.sql.execution.id")).try_cast("bigint").alias("sql_id"), F.col("s.i.`Parent IDs`").alias("parent_ids"), F.col("s.i.`RDD Info`").alias("rdds"),
    )


def stage_rdds(stage_rows: DataFrame) -> DataFrame:
    """A row per RDD of a stage, with scope id and operator from its scope; RDDs without one have nulls."""
    rows = stage_rows.select("stage_id", F.explode("rdds").alias("r")).withColumn("scope", F.from_json("r.Scope", "id string, name string"))
    # "Scan parquet db.t" and "FileScan text" are scans, "Exchange hashpartitioning" is an exchange.
    operator = F.regexp_replace(F.regexp_replace(F.trim("scope.name"), r" .*", ""), r"^(File|Batch)?Scan.*", "Scan")
    return rows.select(
        "stage_id", F.col("r.`RDD ID`").alias("rdd_id"), F.col("r.Name").alias("name"), F.col("scope.id").try_cast("bigint").alias("scope_id"),
        operator.alias("operator"), F.col("r.`Parent IDs`").alias("parent_ids"), F.col("r.Callsite").alias("callsite"),
    )


def adaptive_rdds(rdds: DataFrame) -> DataFrame:
    """(stage_id, rdd_id, operator, name) of each stage's adaptable RDD: of those with the highest scope, the least id.

    Stages without one are left out.
    """
    fit = rdds.where(F.col("operator").isin(*ADAPTABLE) & F.col("scope_id").isNotNull())
    return fit.groupBy("stage_id").agg(F.max_by(F.struct("rdd_id", "operator", "name"), F.struct("scope_id", F.negate("rdd_id").alias("k"))).alias("a")).select("stage_id", "a.*")


def points(stage_rows: DataFrame, rdds: DataFrame, only_adaptive: bool = False) -> DataFrame:
    """(stage_id, name, num_rdds, parent_ids, rdd_id, operator, point, named) of each stage with an adaptable RDD.

    The point is the stage's property, else the RDD's own name if that says "adaptive", else the name
    with its operator. ``only_adaptive`` leaves out the points without a name of their own.
    """
    found = adaptive_rdds(rdds).select("stage_id", "rdd_id", "operator", F.coalesce("name", F.lit("")).alias("rdd_name"))
    rows = stage_rows.select("stage_id", "name", "point", "parent_ids", F.size("rdds").alias("num_rdds")).join(found, "stage_id")
    own = F.col("rdd_name").contains("adaptive")
    point = F.coalesce("point", F.when(own, F.col("rdd_name")).otherwise(F.concat_ws("-", "rdd_name", "operator")))
    rows = rows.select("stage_id", "name", "num_rdds", "parent_ids", "rdd_id", "operator", point.alias("point"), (F.col("point").isNotNull() | own).alias("named"))
    return rows.where("named") if only_adaptive else rows


def dependent_points(point_rows: DataFrame) -> DataFrame:
    """(a, b), a before b: points, named or not, whose stages feed the same later stage.

    Each parent of a stage is paired with the next one, by point, so any number of parents is chained.
    """
    parents = point_rows.select("stage_id", "point").join(
        point_rows.select(F.col("stage_id").alias("child"), F.explode("parent_ids").alias("parent")), F.col("stage_id") == F.col("parent")
    )
    fed = parents.groupBy("child").agg(F.sort_array(F.collect_set("point")).alias("p")).where("size(p) > 1")
    steps = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.struct(F.get("p", i - 1).alias("a"), F.get("p", i).alias("b")))
    return fed.select(F.explode(steps).alias("s")).select("s.*").distinct()


def task_metrics(events: DataFrame, stage_rows: DataFrame) -> DataFrame:
    """A row per task of a stage: its last successful attempt, else its last; zeros where none is logged.

    Tasks that should be there and those that were logged are shuffled once together, by stage, so that sums
    over stages need no further shuffle. Values are kept by rank one by one, which hash aggregation can do.
    """
    m, r, w = "`Task Metrics`", "`Task Metrics`.`Shuffle Read Metrics`", "`Task Metrics`.`Shuffle Write Metrics`"
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    metrics = {
        "run_time": zero(f"{m}.`Executor Run Time`"), "gc_time": zero(f"{m}.`JVM GC Time`"),
        "input_records": zero(f"{m}.`Input Metrics`.`Records Read`"), "input_bytes": zero(f"{m}.`Input Metrics`.`Bytes Read`"),
        "mem_spilled": zero(f"{m}.`Memory Bytes Spilled`"), "disk_spilled": zero(f"{m}.`Disk Bytes Spilled`"),
        "sr_records": zero(f"{r}.`Total Records Read`"), "sr_bytes": zero(f"{r}.`Remote Bytes Read`") + zero(f"{r}.`Local Bytes Read`"), "fetch_wait": zero(f"{r}.`Fetch Wait Time`"),
        "sw_records": zero(f"{w}.`Shuffle Records Written`"), "sw_bytes": zero(f"{w}.`Shuffle Bytes Written`"),
    }
    attempt, success = F.col("`Task Info`.Attempt"), F.col("`Task End Reason`.Reason") == "Success"
    # Success first (unknown least), then the attempt (unknown least); above -1, which stands for no log.
    rank = F.coalesce(F.when(success, 2).otherwise(F.when(success.isNotNull(), 1)), F.lit(0)).cast("long") * (1 << 34) + F.coalesce(attempt.cast("long") + (1 << 32), F.lit(0))
    ended = events.where("Event = 'SparkListenerTaskEnd'")
    logged = ended.select(
        F.col("`Stage ID`").alias("stage_id"), F.col("`Task Info`.Index").alias("idx"), rank.alias("rank"), attempt.alias("attempt"), F.col("`Task Info`.`Executor ID`").alias("executor_id"),
        *[c.alias(k) for k, c in metrics.items()],
    )
    every = stage_rows.where("num_tasks > 0").select(
        "stage_id", F.explode(F.sequence(F.lit(0), F.col("num_tasks") - 1)).alias("idx"), F.lit(-1).cast("long").alias("rank"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("executor_id"),
        *[F.lit(0).cast("long").alias(k) for k in metrics],
    )
    best = [F.max_by(c, "rank").alias(c) for c in ("attempt", "executor_id", *metrics)]
    rows = logged.union(every).repartition("stage_id").groupBy("stage_id", "idx").agg(F.min("rank").alias("least"), *best)
    return rows.where("least = -1").drop("least")
