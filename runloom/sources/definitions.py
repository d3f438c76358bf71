"""DAG definition files: YAML in a folder to one row for each file, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # PyYAML is an optional part
    yaml = None

TASK = (
    "struct<id:string,name:string,command:string,executor:string,trigger_rule:string,is_branch:boolean,branch_xcom_key:string,timeout:int,retry_interval:int,"
    "max_retries:int,depends_on_past:boolean,dependencies:array<struct<task:string,label:string>>>"
)
DEFINITION = f"dag_id string, path string, modified timestamp, name string, description string, cron string, start_date string, end_date string, catchup boolean, tasks array<{TASK}>, error string"

# What a task has where neither it nor default_args say otherwise.
DEFAULTS = {"executor": "shell", "trigger_rule": "all_success", "is_branch": False, "branch_xcom_key": "branch", "timeout": 300, "retry_interval": 60, "max_retries": 3, "depends_on_past": False}


def _task(raw: dict, defaults: dict) -> dict:
    task = {k: raw.get(k, v) for k, v in DEFAULTS.items()}
    task = {k: defaults[k] if k in defaults and v == DEFAULTS[k] else v for k, v in task.items()}
    deps = [{"task": str(d.get("task")), "label": d.get("label") or ""} if isinstance(d, dict) else {"task": str(d), "label": ""} for d in raw.get("dependencies") or []]
    return task | {"id": str(raw.get("id") or ""), "name": raw.get("name") or raw.get("id"), "command": raw.get("command") or "", "dependencies": deps}


def decode(text: str) -> dict:
    """One definition; raises ValueError if the text is none."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(str(e).splitlines()[0]) from None
    if not isinstance(raw, dict):
        raise ValueError("no mapping")
    day = lambda x: None if x is None else str(x)
    tasks = [_task(t, raw.get("default_args") or {}) for t in raw.get("tasks") or []]
    return {k: raw.get(k) for k in ("name", "description", "cron")} | {"start_date": day(raw.get("start_date")), "end_date": day(raw.get("end_date")), "catchup": bool(raw.get("catchup", False)), "tasks": tasks}


def encode(definition: dict) -> str:
    """YAML of a definition with what differs from the built-in values."""
    tasks = []
    for t in definition.get("tasks") or []:
        deps = [{"task": d["task"], "label": d["label"]} if d.get("label") else d["task"] for d in t.get("dependencies") or []]
        tasks.append({k: t[k] for k in ("id", "name", "command") if t.get(k)} | {k: t[k] for k, v in DEFAULTS.items() if t.get(k, v) != v} | ({"dependencies": deps} if deps else {}))
    head = {k: definition[k] for k in ("name", "description", "cron", "start_date", "end_date", "catchup") if definition.get(k)}
    return yaml.safe_dump(head | {"tasks": tasks}, sort_keys=False, allow_unicode=True)


def load(spark: SparkSession, folder: str, glob: str = "*.{yaml,yml}") -> DataFrame:
    """All definition files directly in a folder: one row each; a file that can't be read as one has its error and no tasks."""
    if yaml is None:
        raise ImportError("PyYAML is needed to read definitions")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["name", "description", "cron", "start_date", "end_date", "catchup", "tasks"]
        for batch in batches:
            rows = []
            for path, modified, content in batch.itertuples(index=False):
                row = {"dag_id": path.rsplit("/", 1)[-1].rsplit(".", 1)[0], "path": path, "modified": modified}
                try:
                    row |= decode(bytes(content).decode()) | {"error": None}
                except (ValueError, AttributeError) as e:
                    row |= dict.fromkeys(names) | {"error": str(e)}
                rows.append(row)
            yield pd.DataFrame(rows, columns=["dag_id", "path", "modified", *names, "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select("path", "modificationTime", "content").mapInPandas(parse, DEFINITION)


def tasks_of(definitions: DataFrame) -> DataFrame:
    """One row for each task with its place in the file."""
    return definitions.select("dag_id", F.posexplode("tasks").alias("task_idx", "t")).select("dag_id", "task_idx", F.col("t.id").alias("task_id"), "t.*").drop("id")


def edges_of(definitions: DataFrame) -> DataFrame:
    tasks = tasks_of(definitions)
    return tasks.select("dag_id", "task_id", F.explode("dependencies").alias("d")).select("dag_id", "task_id", F.col("d.task").alias("dep"), F.col("d.label").alias("label"))
