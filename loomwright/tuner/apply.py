"""Applying a plan: the tuner that a job asks at its adaptive points."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession

from ..session import cut
from ..sources.text import read_lines
from . import eventlog
from .actions import PARTITIONER, PARTITIONS, Action, Cursor, Plan
from .planner import DEFAULT, LEGACY, Policy, instances_of, latest, make_plan, most_rdds
from .profile import profile


def partitions_of(action: Action, default_partitions: int | None = None) -> int | None:
    """The number of partitions that an action asks for; only a number of its own changes the default."""
    return action.num_partitions if action.kind == PARTITIONS else default_partitions


def apply_action(df: DataFrame, keys: list[str], action: Action, default_partitions: int | None = None) -> DataFrame:
    """Deal ``df`` by its keys as the action says; without one by hash into the default number, if given."""
    n = partitions_of(action, default_partitions)
    ranged = action.kind == PARTITIONER and action.partitioner == "range"
    if ranged and keys:
        return df.repartitionByRange(n, *keys) if n else df.repartitionByRange(*keys)
    if n or action.kind == PARTITIONER and keys:
        return df.repartition(*([n] if n else []), *keys)
    return df


def plan_events(events: DataFrame, policies=DEFAULT, only_adaptive: bool = False, submitted: DataFrame | None = None) -> Plan:
    """The plan that the parsed events of a log lead to; ``submitted`` has the submissions of stages, if ``events`` lack them."""
    stages = cut(eventlog.stages(events if submitted is None else submitted))
    found = eventlog.points(stages, eventlog.stage_rdds(stages), only_adaptive)
    pairs = sorted((r.a, r.b) for r in eventlog.dependent_points(found).collect())
    choose = most_rdds if tuple(policies) == LEGACY else latest
    return make_plan(instances_of(profile(eventlog.task_metrics(events, stages)), found, choose), policies, pairs)


def analyze(spark: SparkSession, log_path: str, policies=DEFAULT, only_adaptive: bool = False) -> Plan:
    """The plan that an event log leads to."""
    return plan_events(eventlog.read_events(spark, log_path), policies, only_adaptive)


class Tuner:
    """Plans from the log of an earlier run and applies the plan at named points.

    Policies may be (name, policy) pairs or plain functions; one added later makes the plan anew.
    """

    def __init__(self, spark: SparkSession, log_path: str | None = None, policies: list | None = None, only_adaptive: bool = False):
        self.spark, self.log_path, self.only_adaptive = spark, log_path or spark.conf.get("spark.adaptive.logpath", None), only_adaptive
        self.policies: list[tuple[str, Policy]] = list(DEFAULT)
        self._cursor: Cursor | None = None
        for p in policies or []:
            self.add_policy(p)

    def add_policy(self, policy) -> None:
        self.policies.append(policy if isinstance(policy, tuple) else (policy.__name__, policy))
        self._cursor = None

    @property
    def cursor(self) -> Cursor:
        if self._cursor is None:
            self._cursor = Cursor(analyze(self.spark, self.log_path, self.policies, self.only_adaptive) if self.log_path else {})
        return self._cursor

    @contextmanager
    def point(self, name: str) -> Iterator[None]:
        """Jobs run inside carry the point's name in the event log."""
        context = self.spark.sparkContext
        context.setLocalProperty(eventlog.POINT_PROPERTY, name)
        try:
            yield
        finally:
            context.setLocalProperty(eventlog.POINT_PROPERTY, None)

    def shuffle(self, df: DataFrame, name: str, *keys: str, default_partitions: int | None = None, operator: str = "") -> DataFrame:
        """``df`` dealt by keys as the next action of the point says."""
        return apply_action(df, list(keys), self.cursor.next(name, operator), default_partitions)

    def read_lines(self, path: str, name: str, default_partitions: int | None = None) -> DataFrame:
        """(value) per line of text files, in as many partitions as the next action of the point says."""
        return read_lines(self.spark, path, partitions_of(self.cursor.next(name, "Scan"), default_partitions))

    def aggregate(self, df: DataFrame, name: str, keys: list[str], *aggregates: Column, default_partitions: int | None = None) -> DataFrame:
        """``aggregates`` of ``df`` by its keys, in the planned partitions.

        A plan without a number leaves the shuffle to Spark, which pre-aggregates before it. A planned number
        deals the rows themselves, as the shuffle of partial results takes its number from the session alone.
        """
        action = self.cursor.next(name, "aggregateByKey")
        return apply_action(df, keys, action, default_partitions).groupBy(*keys).agg(*aggregates)

    def join(self, left: DataFrame, right: DataFrame, name: str, *keys: str, default_partitions: int | None = None) -> DataFrame:
        """An inner equi-join whose sides are dealt alike by the point's next action."""
        action = self.cursor.next(name, "join")
        deal = lambda df: apply_action(df, list(keys), action, default_partitions)
        return deal(left).join(deal(right), list(keys))
