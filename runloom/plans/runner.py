"""Running the tasks of a DAG as PySpark callables; a thin driver-side loop, for small DAGs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RESULT = "dag_run_id string, task_id string, exit_code int, error string, n_rows bigint"


@dataclass
class Runner:
    """Task bodies by kind: ``run(spark, context) -> DataFrame or None``. A kind that is not known ends with exit code -1."""

    kinds: dict[str, Callable[[SparkSession, dict], DataFrame | None]] = field(default_factory=lambda: {"noop": lambda spark, context: None})

    def run(self, spark: SparkSession, dag_run_id: str, tasks: list[dict]) -> DataFrame:
        """Runs (task_id, kind, ...) in the given order, each in a job group of its own; returns results like an executor's."""
        rows = []
        for task in tasks:
            group = f"{dag_run_id}_{task['task_id']}"
            spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
            code, error, n = 0, None, 0
            body = self.kinds.get(task.get("kind", "noop"))
            if body is None:
                code, error = -1, f"no executor {task['kind']}"
            else:
                try:
                    out = body(spark, {"dag_run_id": dag_run_id} | task)
                    n = out.count() if out is not None else 0
                except Exception as e:  # a task's failure is a result
                    code, error = 1, str(e).splitlines()[0]
            rows.append((dag_run_id, task["task_id"], code, error, n))
        return spark.createDataFrame(rows, RESULT)

    @staticmethod
    def cancel(spark: SparkSession, dag_run_id: str, task_id: str) -> None:
        spark.sparkContext.cancelJobGroup(f"{dag_run_id}_{task_id}")
