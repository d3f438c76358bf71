"""Changes of task definitions, many at a time: each is accepted, or refused with a reason.

tasks: dag_id, task_id, further columns. deps: dag_id, task_id, dep. Every change is judged by the catalog as it is, not by
the other changes; of changes with the same key one is taken (``changelog.one_each``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

KEY = ["dag_id", "task_id"]


def _marked(changes: DataFrame, name: str, there: DataFrame, on: list[str]) -> DataFrame:
    return changes.join(there.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def _reason(*cases: tuple[Column, str]) -> Column:
    error = F.lit(None).cast("string")
    for holds, name in reversed(cases):
        error = F.when(holds, name).otherwise(error)
    return error


def _cycles(deps: DataFrame, new_deps: DataFrame) -> DataFrame:
    """(dag_id, task_id) whose new dependencies lead back to it."""
    edges = lambda df: df.select("dag_id", F.col("dep").alias("src"), F.col("task_id").alias("dst"))
    loops = new_deps.where("dep = task_id").select(*KEY)
    closing = graph.closing_edges(edges(deps), edges(new_deps.where("dep <> task_id")), "dag_id")
    return loops.unionByName(closing.select("dag_id", F.col("dst").alias("task_id"))).distinct()


def add_tasks(dags: DataFrame, tasks: DataFrame, deps: DataFrame, new: DataFrame, new_deps: DataFrame) -> DataFrame:
    """(dag_id, task_id, error) for each new task: NotFound without its DAG, AlreadyExists, InvalidArgument for a cycle,
    NotFound for a dependency that the DAG doesn't have; null if it is accepted. The first that holds counts."""
    asked = new.select(*KEY).distinct()
    missing = new_deps.join(tasks.select("dag_id", F.col("task_id").alias("dep")), ["dag_id", "dep"], "left_anti").select(*KEY)
    marked = _marked(_marked(asked, "dag", dags, ["dag_id"]), "there", tasks, KEY)
    marked = _marked(_marked(marked, "cycle", _cycles(deps, new_deps), KEY), "missing", missing, KEY)
    error = _reason((~F.col("dag"), "NotFound"), (F.col("there"), "AlreadyExists"), (F.col("cycle"), "InvalidArgument"), (F.col("missing"), "NotFound"))
    return marked.select(*KEY, error.alias("error"))


def update_tasks(tasks: DataFrame, deps: DataFrame, changed: DataFrame, new_deps: DataFrame) -> DataFrame:
    """(dag_id, task_id, error): NotFound without the task, InvalidArgument for a cycle; dependencies need not exist."""
    others = deps.join(changed.select(*KEY).distinct(), KEY, "left_anti")
    marked = _marked(_marked(changed.select(*KEY).distinct(), "there", tasks, KEY), "cycle", _cycles(others, new_deps), KEY)
    return marked.select(*KEY, _reason((~F.col("there"), "NotFound"), (F.col("cycle"), "InvalidArgument")).alias("error"))


def delete_tasks(dags: DataFrame, tasks: DataFrame, deps: DataFrame, gone: DataFrame) -> DataFrame:
    """(dag_id, task_id, error): NotFound without the DAG, InvalidArgument while another depends on it, NotFound without the task."""
    needed = deps.select("dag_id", F.col("dep").alias("task_id"))
    marked = _marked(_marked(_marked(gone.select(*KEY).distinct(), "dag", dags, ["dag_id"]), "needed", needed, KEY), "there", tasks, KEY)
    error = _reason((~F.col("dag"), "NotFound"), (F.col("needed"), "InvalidArgument"), (~F.col("there"), "NotFound"))
    return marked.select(*KEY, error.alias("error"))


def get_tasks(tasks: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked tasks (dag_id, task_id) with their columns, and error NotFound for those that aren't there."""
    found = asked.select(*KEY).distinct().join(tasks.withColumn("_there", F.lit(True)), KEY, "left")
    return found.withColumn("error", F.when(F.col("_there").isNull(), "NotFound")).drop("_there")


def create_dags(dags: DataFrame, new: DataFrame) -> DataFrame:
    """(dag_id, error): AlreadyExists for ids that are there."""
    marked = _marked(new.select("dag_id").distinct(), "there", dags, ["dag_id"])
    return marked.select("dag_id", _reason((F.col("there"), "AlreadyExists")).alias("error"))


def delete_dags(dags: DataFrame, gone: DataFrame) -> DataFrame:
    """(dag_id, error): NotFound for ids that aren't there."""
    marked = _marked(gone.select("dag_id").distinct(), "there", dags, ["dag_id"])
    return marked.select("dag_id", _reason((~F.col("there"), "NotFound")).alias("error"))


def accepted(rows: DataFrame, verdicts: DataFrame, on: list[str] | None = None) -> DataFrame:
    """The rows whose change was accepted."""
    return rows.join(verdicts.where("error is null"), on or KEY, "left_semi")
