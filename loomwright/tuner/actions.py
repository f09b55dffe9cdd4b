"""Actions of a tuning plan, plans on disk, and the cursor that consumes them."""

from __future__ import annotations

import dataclasses
import json
import logging
import math
from dataclasses import dataclass

log = logging.getLogger(__name__)

PARTITIONS, PARTITIONER, WARN, NONE = "partitions", "partitioner", "warn", "none"


@dataclass(frozen=True)
class Action:
    """What to do at a point: a new number of partitions, a new partitioner, a warning, or nothing."""

    point: str
    kind: str = NONE
    num_partitions: int = 0
    partitioner: str = ""
    message: str = ""
    policy: str = ""
    old_num_partitions: int = 0

    @property
    def valid(self) -> bool:
        return self.kind != NONE

    def scaled(self, factor: float) -> Action:
        """A number of partitions follows the input's growth; other actions stay."""
        if self.kind != PARTITIONS:
            return self
        return dataclasses.replace(self, num_partitions=max(1, math.ceil(factor * self.num_partitions)))

    def most(self, other: Action) -> Action:
        """The stronger of two: the larger number of partitions; anything over nothing or a warning."""
        if self.kind == PARTITIONS and other.kind == PARTITIONS:
            return self if self.num_partitions >= other.num_partitions else other
        return other if self.kind in (NONE, WARN) else self


Plan = dict[str, list[Action]]


def save(plan: Plan, path: str) -> None:
    with open(path, "w") as out:
        json.dump({point: [dataclasses.asdict(a) for a in actions] for point, actions in plan.items()}, out, indent=1)


def load(path: str) -> Plan:
    with open(path) as lines:
        return {point: [Action(**a) for a in actions] for point, actions in json.load(lines).items()}


class Cursor:
    """Hands out the actions of a plan, one a visit; the last one repeats once they are used up."""

    def __init__(self, plan: Plan):
        self.plan, self.at = plan, dict.fromkeys(plan, 0)

    def resolve(self, point: str, operator: str = "") -> str | None:
        """The point itself, else its name with the operator, else nothing."""
        return next((p for p in (point, f"{point}-{operator}") if p in self.plan), None)

    def next(self, point: str, operator: str = "") -> Action:
        name = self.resolve(point, operator)
        if name is None or not self.plan[name]:
            return Action(point)
        actions, k = self.plan[name], self.at[name]
        self.at[name] = k + 1
        if k >= len(actions):
            log.warning("the plan for %s is used up; its last action repeats", name)
        return actions[min(k, len(actions) - 1)]
