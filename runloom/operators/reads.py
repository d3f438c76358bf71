"""Point, range and existence reads, listings, and the joins and aggregates behind the API views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enums import run_state_name, task_state_name
from ..plans.storage import stored


def dag_id_of(run_id: str | Column) -> Column:
    """Everything before the last underscore; empty without one."""
    return F.regexp_extract(run_id, r"^(.*)_[^_]*$", 1)


def runs_of_dag(runs: DataFrame, dag_id: str, compat_like: bool = False) -> DataFrame:
    """Runs of one DAG. ``compat_like`` matches as LIKE 'id_%' does without case, which other DAGs' runs fit, too."""
    if compat_like:
        return runs.where(F.col("dag_run_id").ilike(f"{dag_id}_%"))
    return runs.where(F.col("dag_id") == dag_id)


def run_state(runs: DataFrame, dag_run_id: str) -> DataFrame:
    return runs.where(F.col("dag_run_id") == dag_run_id).select("dag_run_id", "state")


def run_rows(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the asked runs (dag_run_id), each with the dag_id that its id tells; null columns for runs that aren't there."""
    rows = asked.select("dag_run_id").distinct().join(runs.drop("dag_id"), "dag_run_id", "left")
    return rows.withColumn("dag_id", dag_id_of("dag_run_id"))


def incomplete_runs(runs: DataFrame) -> DataFrame:
    return runs.where("state = 0 and dag_run_id <> ''").select("run_rowid", "dag_run_id")


def history(runs: DataFrame, limit: int = 50, dag_id: str | None = None) -> DataFrame:
    """Newest runs first, ties by run id: a top-k, never a full sort."""
    runs = runs if dag_id is None else runs_of_dag(runs, dag_id)
    columns = ["dag_run_id", "dag_id", "state", "trigger_type", "execution_date", "scheduled_at", "started_at", "finished_at"]
    return runs.select(*columns).orderBy(F.desc("scheduled_at"), "dag_run_id").limit(limit)


def logs(logs_: DataFrame, dag_run_id: str | None = None, task_id: str | None = None, attempt: int | None = None) -> DataFrame:
    for name, value in (("dag_run_id", dag_run_id), ("task_id", task_id), ("attempt", attempt)):
        logs_ = logs_ if value is None else logs_.where(F.col(name) == value)
    return logs_.select("id", "dag_run_id", "task_id", "attempt", "ts", "level", "stream", "message").orderBy("attempt", "ts", "id")


def parseable(xcoms: DataFrame, value: str = "value") -> DataFrame:
    """Rows whose value is JSON."""
    return xcoms.where(F.expr(f"try_parse_json({value}) is not null"))


def dags_with_tasks(dags: DataFrame, tasks: DataFrame) -> DataFrame:
    """Each DAG with the sorted list of its task ids; empty without tasks."""
    listed = tasks.groupBy("dag_id").agg(F.sort_array(F.collect_list("task_id")).alias("tasks"))
    return dags.join(listed, "dag_id", "left").withColumn("tasks", F.coalesce("tasks", F.array().cast("array<string>")))


def with_watermark(dags: DataFrame, runs: DataFrame) -> DataFrame:
    """Each DAG with the time its last scheduled run was for, null if none."""
    marks = runs.where("trigger_type = 1").groupBy("dag_id").agg(F.max("execution_date").alias("last_scheduled_at"))
    return dags.select("dag_id").join(marks, "dag_id", "left")


def run_exists(ticks: DataFrame, runs: DataFrame) -> DataFrame:
    return ticks.join(runs.select("dag_id", "execution_date"), ["dag_id", "execution_date"], "left_semi")


def without_existing_runs(ticks: DataFrame, runs: DataFrame) -> DataFrame:
    return ticks.join(runs.select("dag_id", "execution_date"), ["dag_id", "execution_date"], "left_anti")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds place: 1, 2, ... over all rows in the order of the columns.

    Rows are dealt out by range and stored; each range is numbered by itself, after the counts of the ranges before it.
    """
    dealt = stored(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    ranges = dealt.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    placed = dealt.withColumn("_own", own).join(F.broadcast(ranges), "_range")
    return placed.withColumn("place", F.col("_before") + F.col("_own")).drop("_range", "_before", "_own")


def run_tasks(instances: DataFrame, nodes: DataFrame) -> DataFrame:
    """Instances with their task ids by position; ``task_<idx>`` where the definition has none."""
    named = instances.join(nodes.select("run_rowid", "task_idx", "task_id"), ["run_rowid", "task_idx"], "left")
    name = F.coalesce("task_id", F.concat(F.lit("task_"), F.col("task_idx").cast("string")))
    return named.select("run_rowid", "task_idx", name.alias("task_id"), task_state_name("state").alias("state"), "attempt", "exit_code", "started_at")


def xcom_view(xcoms: DataFrame) -> DataFrame:
    """(dag_run_id, task_id, values): key to value of each task that has any; one row for each task."""
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct("xkey", "value"))))
    return xcoms.groupBy("dag_run_id", "task_id").agg(pairs.alias("values"))


def xcom_pull(pulls: DataFrame, xcoms: DataFrame, strict: bool = False) -> DataFrame:
    """Each pull (dag_run_id, source_task, xkey, env_var) with the value it gets; strict adds an error for missing keys."""
    found = xcoms.select("dag_run_id", F.col("task_id").alias("source_task"), "xkey", "value")
    pulled = pulls.join(found, ["dag_run_id", "source_task", "xkey"], "left")
    return pulled.withColumn("error", F.when(F.col("value").isNull(), "NotFound")) if strict else pulled


def unknown_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose source is no task of the same DAG."""
    return edges.join(nodes.select("run_rowid", F.col("task_idx").alias("src")), ["run_rowid", "src"], "left_anti")


def last_execution(runs: DataFrame) -> DataFrame:
    return runs.groupBy("dag_id").agg(F.max("execution_date").alias("last_execution_date"))


def previous_state(instances: DataFrame, runs: DataFrame) -> DataFrame:
    """As-of lookup: for each instance the state of the latest other run of its (dag, task) not after it.

    Runs of equal date count as previous whatever their id, ties go to the largest id. Sorted once by date in a window
    over (dag, task): the latest before or at a date is the largest so far, or the second largest where that is the run itself.
    """
    at = instances.join(runs.select("run_rowid", "dag_id", "dag_run_id", "execution_date"), "run_rowid")
    key = F.struct("execution_date", "dag_run_id", "state")
    window = Window.partitionBy("dag_id", "task_idx").orderBy("execution_date").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("dag_id", "task_idx").orderBy("execution_date", "dag_run_id")
    best = F.max(key).over(window)
    previous = F.when(best["dag_run_id"] == F.col("dag_run_id"), F.lag(key).over(earlier)).otherwise(best)
    return at.select("run_rowid", "task_idx", "dag_id", "dag_run_id", "state", previous["state"].alias("previous_state"))


def past_gate(previous: DataFrame) -> DataFrame:
    """run if there is no previous run or it succeeded or was skipped, else skip."""
    free = F.col("previous_state").isNull() | F.col("previous_state").isin(2, 6)
    return previous.withColumn("gate", F.when(free, "run").otherwise("skip"))


def run_numbers(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("dag_id").orderBy("scheduled_at", "dag_run_id")
    return runs.select("dag_id", "dag_run_id", F.row_number().over(order).cast("int").alias("run_number"))


def dispatch(nodes: DataFrame, running: DataFrame, max_concurrency: int, per_dag: bool = False) -> DataFrame:
    """Ready tasks (run_rowid, task_idx) in dispatch order as far as free places go.

    The global order is taken as a top-k; with ``per_dag`` each run has ``max_concurrency`` places of its own.
    """
    if per_dag:
        busy = running.groupBy("run_rowid").agg(F.count("*").alias("_busy"))
        place = F.row_number().over(Window.partitionBy("run_rowid").orderBy("task_idx"))
        placed = nodes.select("run_rowid", "task_idx").withColumn("_place", place).join(busy, "run_rowid", "left")
        return placed.where(F.col("_place") <= max_concurrency - F.coalesce("_busy", F.lit(0))).select("run_rowid", "task_idx")
    free = max(0, max_concurrency - running.count())
    return nodes.select("run_rowid", "task_idx").orderBy("run_rowid", "task_idx").limit(free)


def status(dags: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: number of DAGs and whether a run is active."""
    active = runs.agg(F.coalesce(F.bool_or(F.col("state") == 0), F.lit(False)).alias("active_runs"))
    return dags.agg(F.count("*").alias("dag_count")).join(active)


def dashboard(dags: DataFrame, tasks: DataFrame, runs: DataFrame) -> DataFrame:
    one = dags.agg(F.count("*").alias("dag_count"))
    return one.join(tasks.agg(F.count("*").alias("task_count"))).join(runs.agg(F.count_if(F.col("state") == 0).alias("active_runs")))


def cli_list(dags: DataFrame, tasks: DataFrame) -> DataFrame:
    counts = tasks.groupBy("dag_id").agg(F.count("*").alias("n"))
    cron = F.when(F.coalesce("cron", F.lit("")) == "", "-").otherwise(F.col("cron"))
    return dags.join(counts, "dag_id", "left").select("dag_id", F.substring("name", 1, 28).alias("name"), cron.alias("cron"), F.coalesce("n", F.lit(0)).alias("tasks"))


def cli_status(runs: DataFrame, limit: int = 20) -> DataFrame:
    newest = history(runs, limit)
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return newest.select("dag_run_id", run_state_name("state").alias("state"), seconds.alias("duration_s"))


def search(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any of the columns, whatever the case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return rows.where(found)
