"""Stage profiles: what the policies need to know of each stage, from the metrics of its tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import guarded_correlation, max_over_mean, percentile_of, ratio, sample_skewness

#: Skewness above which tasks count as skewed, and correlation from which metrics go together.
SKEW = 1.5
CORRELATION = 0.8
#: Share of time waiting for fetches above which a task counts as blocked.
BLOCKED = 0.8


def rollup(tasks: DataFrame) -> DataFrame:
    """Sums of the metrics of each stage."""
    sums = ("run_time", "gc_time", "input_records", "input_bytes", "mem_spilled", "disk_spilled", "sr_records", "sr_bytes", "fetch_wait", "sw_records", "sw_bytes")
    return tasks.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("num_tasks"), *[F.sum(c).alias(c) for c in sums],
        F.sum(F.col("input_records") + F.col("sr_records")).alias("records_read"), F.sum(F.col("input_bytes") + F.col("sr_bytes")).alias("records_read_bytes"),
        F.sum(F.col("mem_spilled") + F.col("disk_spilled")).alias("bytes_spilled"),
    )


def executor_gc(tasks: DataFrame) -> DataFrame:
    """Total and share of garbage collection for each executor of a stage."""
    return tasks.groupBy("stage_id", "executor_id").agg(F.sum("gc_time").alias("gc_time"), ratio(F.sum("gc_time"), F.sum("run_time")).alias("gc_overhead"))


def profile(tasks: DataFrame) -> DataFrame:
    """One row per stage with the figures of all policies, in one pass over the tasks."""
    gc = ratio(F.col("gc_time"), F.col("run_time"))
    rows = tasks.withColumn("gc", gc).withColumn("blocked", ratio(F.col("fetch_wait"), F.col("run_time")))
    # A task without a run time has no overhead, which makes the skewness of the stage undefined.
    known = F.count("gc") == F.count(F.lit(1))
    out = rows.groupBy("stage_id").agg(
        F.count(F.lit(1)).alias("num_tasks"),
        F.count_if((F.col("input_records") + F.col("sr_records")) == 0).alias("empty_tasks"),
        F.sum(F.col("mem_spilled") + F.col("disk_spilled")).alias("spilled"),
        F.sum("sw_bytes").alias("shuffle_write"),
        F.sum(F.col("input_records") + F.col("sr_records")).alias("records_read"),
        F.when(known, sample_skewness(F.col("gc"))).alias("gc_skew"),
        F.sort_array(F.collect_list("gc")).alias("gcs"),
        sample_skewness(F.col("run_time")).alias("run_skew"),
        guarded_correlation(F.col("run_time"), F.col("sr_bytes")).alias("corr_bytes"),
        guarded_correlation(F.col("run_time"), F.col("sr_records")).alias("corr_records"),
        F.count_if(F.col("blocked") > BLOCKED).alias("blocked_tasks"),
        max_over_mean(F.col("run_time")).alias("run_max_over_mean"),
        F.max("gc_time").alias("gc_max"), F.min("gc_time").alias("gc_min"), max_over_mean(F.col("gc_time")).alias("gc_max_over_mean"),
    )
    out = out.where("stage_id IS NOT NULL").withColumn("gc_q2", percentile_of(F.col("gcs"), 0.5)).withColumn("gc_q3", percentile_of(F.col("gcs"), 0.75))
    target = F.least(F.when(F.col("gc_q2") > 0, F.col("gc_q2")), F.when(F.col("gc_q3") > 0, F.col("gc_q3")))
    # Tasks without an overhead, and all tasks of a stage without a target, stay whole.
    split = F.aggregate("gcs", F.lit(0).cast("long"), lambda n, gc: n + F.greatest(F.lit(1).cast("long"), F.ceil(gc / F.col("gc_target"))))
    out = out.withColumn("gc_target", target)
    return out.withColumn("gc_partitions", (F.col("num_tasks") - F.size("gcs") + split).cast("long")).drop("gcs")


def empty_partitions(p: DataFrame) -> DataFrame:
    """(stage_id, partitions) where tasks had nothing to read: as many fewer, one at least."""
    return p.where("empty_tasks > 0").select("stage_id", F.greatest(F.lit(1), F.col("num_tasks") - F.col("empty_tasks")).alias("partitions"))


def spill_partitions(p: DataFrame) -> DataFrame:
    """(stage_id, partitions) where tasks spilled: more by the spilled share of what was written."""
    share = F.col("spilled") / F.col("shuffle_write")
    return p.where("shuffle_write > 0 AND spilled > 0").select("stage_id", (F.col("num_tasks") + F.ceil(share * F.col("num_tasks"))).cast("long").alias("partitions"))


def gc_partitions(p: DataFrame) -> DataFrame:
    """(stage_id, partitions) where garbage collection is skewed: each task split down to the target overhead."""
    return p.where(F.col("gc_skew") > SKEW).where("gc_target IS NOT NULL").select("stage_id", F.col("gc_partitions").alias("partitions"))


def imbalance(p: DataFrame) -> DataFrame:
    """(stage_id, source) of stages with skewed run times: key, inherent or variable cost."""
    both = (F.col("corr_bytes") >= CORRELATION).cast("int") + (F.col("corr_records") >= CORRELATION).cast("int")
    source = F.when(both == 2, "key").when(both == 0, "inherent").otherwise("variable")
    return p.where(F.col("run_skew") > SKEW).select("stage_id", source.alias("source"))
