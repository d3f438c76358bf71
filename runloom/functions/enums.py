"""Names of stored codes and back; unknown text or code falls back and never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names in the order of their codes.
RUN_STATES = ["running", "success", "failed"]
TASK_STATES = ["pending", "running", "success", "failed", "upstream_failed", "retrying", "skipped"]
TRIGGER_TYPES = ["manual", "schedule"]
EXECUTORS = ["shell", "docker", "sensor", "noop"]
SENSORS = ["file", "http", "command"]
PULL_POLICIES = ["never", "if_not_present", "always"]
TRIGGER_RULES = [
    "all_success", "all_failed", "all_done", "one_success", "one_failed", "none_failed", "none_skipped", "all_done_min_one_success",
    "all_skipped", "one_done", "none_failed_min_one_success", "always",
]


def name_of(code: str | Column, names: list[str], default: str) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    listed = F.array(*[F.lit(n) for n in names])
    return F.when(code.between(0, len(names) - 1), F.element_at(listed, (code + 1).cast("int"))).otherwise(default)


def code_of(name: str | Column, names: list[str], default: int = 0) -> Column:
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(name) if isinstance(name, str) else name)
    return F.when(place > 0, place - 1).otherwise(default).cast("int")


def run_state_name(code: str | Column) -> Column:
    return name_of(code, RUN_STATES, "running")


def task_state_name(code: str | Column) -> Column:
    return name_of(code, TASK_STATES, "pending")


def trigger_type_name(code: str | Column) -> Column:
    return name_of(code, TRIGGER_TYPES, "manual")


def known_rule(name: str | Column) -> Column:
    """The rule's name; all_success for any other text."""
    return name_of(code_of(name, TRIGGER_RULES), TRIGGER_RULES, "all_success")
