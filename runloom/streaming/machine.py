"""Runs as state of a stream: which tasks start, are tried again or are left out, as the events of their tasks arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.state import FAILED, PENDING, RUNNING, SKIPPED, SUCCESS, UPSTREAM_FAILED

ACTIONS = "dag_run_id string, task_id string, action string, attempt int"
FINAL = (SUCCESS, FAILED, UPSTREAM_FAILED, SKIPPED)


def runs_task(rule: str, s: int, f: int, k: int) -> bool:
    """Whether a rule lets a task run after s, f and k dependencies that succeeded, failed and were skipped: all have ended."""
    t = s + f + k
    holds = {
        "all_failed": f == t, "all_done": True, "one_success": s > 0, "one_failed": f > 0, "none_failed": f == 0, "none_skipped": k == 0,
        "all_done_min_one_success": s > 0, "all_skipped": k == t, "one_done": True, "none_failed_min_one_success": f == 0 and s > 0, "always": True,
    }
    return t == 0 or holds.get(rule, s == t)


KNOWN = ("all_failed", "all_done", "one_success", "one_failed", "none_failed", "none_skipped", "all_done_min_one_success", "all_skipped", "one_done", "none_failed_min_one_success", "always")


class Run:
    """One run: its tasks by id, each with rule, deps, max_retries, state and attempt."""

    def __init__(self, text: str | None = None) -> None:
        self.tasks, self.told = json.loads(text) if text else ({}, False)

    def text(self) -> str:
        return json.dumps([self.tasks, self.told])

    def start(self, definition: str) -> Iterator[tuple[str | None, str, int]]:
        """Begins with a JSON array of tasks; a run that has begun goes on as it is."""
        if not self.tasks:
            self.tasks = {t["task_id"]: {"rule": t.get("rule", ""), "deps": t.get("deps", []), "max_retries": t.get("max_retries", 0), "state": PENDING, "attempt": 0} for t in json.loads(definition)}
            yield from self.go_on()

    def ended(self, task_id: str, attempt: int, state: int) -> Iterator[tuple[str | None, str, int]]:
        """An attempt's end. Only that of the attempt that is running counts, so what is delivered again changes nothing."""
        task = self.tasks.get(task_id)
        if task is None or task["state"] != RUNNING or task["attempt"] != attempt:
            return
        if state == FAILED and attempt < max(1, task["max_retries"]):
            task["attempt"] += 1
            yield task_id, "retry", task["attempt"]
            return
        task["state"] = state
        yield from self.go_on()

    def go_on(self) -> Iterator[tuple[str | None, str, int]]:
        """Decides tasks all of whose dependencies have ended, until there is none; tells the run's state once."""
        again = True
        while again:
            again = False
            for task_id, task in self.tasks.items():
                before = [self.tasks[d]["state"] if d in self.tasks else PENDING for d in task["deps"]]
                if task["state"] != PENDING or not all(x in FINAL for x in before):
                    continue
                s, f, u = before.count(SUCCESS), before.count(FAILED), before.count(UPSTREAM_FAILED)
                if runs_task(task["rule"], s, f, len(before) - s - f):
                    task["state"], task["attempt"] = RUNNING, 1
                    yield task_id, "run", 1
                else:
                    task["state"], again = (UPSTREAM_FAILED if task["rule"] not in KNOWN and f + u > 0 else SKIPPED), True
                    yield task_id, "upstream_failed" if task["state"] == UPSTREAM_FAILED else "skipped", 0
        states = [t["state"] for t in self.tasks.values()]
        if not self.told and all(x in FINAL for x in states):
            self.told = True
            yield None, "failed" if FAILED in states else "success", 0


def run_actions(events: DataFrame) -> DataFrame:
    """(dag_run_id, task_id, action, attempt) as they become due, from a stream of events.

    events: dag_run_id, kind (start or ended), definition (of a start: JSON array of task_id, rule, deps, max_retries),
    task_id, attempt and state (of an end). Actions: run, retry, skipped, upstream_failed; and for the run as a whole, with
    null task_id, success or failed. Events of a batch are taken in the order start, attempt. A start or end that is delivered
    again, or an end of an attempt that isn't running, gives no action. max_retries counts attempts. A run's state is one row.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, rows = Run(state.get[0] if state.exists else None), []
        for batch in [pd.concat(list(batches))]:
            for e in batch.sort_values(["kind", "attempt"], ascending=[False, True]).itertuples():
                rows += run.start(e.definition) if e.kind == "start" else run.ended(e.task_id, int(e.attempt), int(e.state))
        state.update((run.text(),))
        yield pd.DataFrame([(key[0], *r) for r in rows], columns=["dag_run_id", "task_id", "action", "attempt"])

    return events.groupBy("dag_run_id").applyInPandasWithState(update, ACTIONS, "run string", "append", GroupStateTimeout.NoTimeout)
