"""Live feeds: logs and events from a folder of files, high-water marks, and runs kept as state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def feed(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def messages(logs: DataFrame, dag_run_id: str | None = None) -> DataFrame:
    """Logs as JSON messages for subscribers, of one run or all; works on streams and tables."""
    logs = logs if dag_run_id is None else logs.where(F.col("dag_run_id") == dag_run_id)
    fields = [F.lit("log").alias("type"), "dag_run_id", "task_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "level", "stream", "message"]
    return logs.select("id", F.to_json(F.struct(*fields)).alias("message"))


def trigger_once_each(ticks: DataFrame, checkpoint: str, start: Callable[[DataFrame], None], existing: Callable[[], DataFrame]) -> StreamingQuery:
    """Starts a run for each tick (dag_id, execution_date) of a stream.

    A batch may be delivered again after a crash: ticks that already have a run (``existing``) are left out, so a run is
    triggered at least once and its tick is not triggered twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        start(rows.dropDuplicates(["dag_id", "execution_date"]).join(existing().select("dag_id", "execution_date"), ["dag_id", "execution_date"], "left_anti"))

    return ticks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def high_water_marks(ticks: DataFrame) -> DataFrame:
    """Last scheduled time of each DAG so far: state, not a lateness bound."""
    return ticks.groupBy("dag_id").agg(F.max("execution_date").alias("last_scheduled_at"))


PROGRESS = "dag_run_id string, n_done bigint, n_failed bigint, run_state string"


def run_progress(events: DataFrame) -> DataFrame:
    """State of each run from a stream of ended tasks (dag_run_id, task_id, state, n_tasks).

    Kept for each run: the ids of the tasks that ended, and of those that failed. A task that is delivered again counts
    once, with its last state. n_tasks is the size of the run.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, failed = (set(x) for x in state.get) if state.exists else (set(), set())
        size = 0
        for b in batches:
            for task, code in zip(b.task_id, b.state, strict=True):
                done.add(task)
                (failed.add if code == 3 else failed.discard)(task)
            size = int(b.n_tasks.max())
        state.update((sorted(done), sorted(failed)))
        name = "running" if len(done) < size else "failed" if failed else "success"
        yield pd.DataFrame([(key[0], len(done), len(failed), name)], columns=["dag_run_id", "n_done", "n_failed", "run_state"])

    return events.groupBy("dag_run_id").applyInPandasWithState(update, PROGRESS, "done array<string>, failed array<string>", "update", GroupStateTimeout.NoTimeout)


def watch(spark: SparkSession, folder: str, changed: Callable[[DataFrame], None], checkpoint: str, glob: str = "*.{yaml,yml}") -> StreamingQuery:
    """Calls ``changed`` with (path, modificationTime) of definition files that appear in a folder; removals show in a snapshot difference."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(folder).select("path", "modificationTime")
    return files.writeStream.foreachBatch(lambda rows, _: changed(rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
