"""Trigger rules, propagation of skips and failures, branching, retries and run states, over all runs at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import enums
from ..plans.storage import dealt, parts, share, stored
from . import graph

# Codes of task states, exit codes that skip a task or fail it without retry, and what recovery notes.
PENDING, RUNNING, SUCCESS, FAILED, UPSTREAM_FAILED, RETRYING, SKIPPED = range(7)
EXIT_SKIP, EXIT_FAIL = 100, 101
RECOVERED = "Recovered after crash"
CRASHED = "Scheduler crashed during execution"


def dependency_counts(edges: DataFrame, states: DataFrame, n: int | None = None) -> DataFrame:
    """Outcomes of the direct dependencies of each (run_rowid, task_idx) that has any; an edge given twice counts twice.

    Rows are dealt to more tasks the more there are, so that none sorts or aggregates more than its share; ``n``: how
    many, if that is known.
    """
    n, s = n or parts(states), F.col("s")
    src = dealt(states.select("run_rowid", F.col("task_idx").alias("src"), F.col("state").alias("s")), n, "run_rowid", "src")
    met = dealt(edges.select("run_rowid", "src", "dst"), n, "run_rowid", "src").join(src, ["run_rowid", "src"])
    return dealt(met.select("run_rowid", F.col("dst").alias("task_idx"), "s"), n, "run_rowid", "task_idx").groupBy("run_rowid", "task_idx").agg(
        F.count_if(s == SUCCESS).alias("n_success"), F.count_if(s == FAILED).alias("n_failed"),
        F.count_if(s.isin(SKIPPED, UPSTREAM_FAILED)).alias("n_skipped"), F.count_if(s == UPSTREAM_FAILED).alias("n_upstream"), F.count("*").alias("n_total"),
    )


def with_counts(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """Tasks with their ``dependency_counts``, null for those without dependencies."""
    n = parts(states)
    return dealt(nodes, n, "run_rowid", "task_idx").join(dependency_counts(edges, states, n), ["run_rowid", "task_idx"], "left")


COUNTS = ("n_success", "n_failed", "n_skipped", "n_total")


def _rules(s, f, k, t) -> dict:
    """What each rule but all_success, which any other text stands for too, asks of the counts; columns or arrays."""
    return {
        "all_failed": f == t, "all_done": s + f + k == t, "one_success": s >= 1, "one_failed": f >= 1, "none_failed": f == 0, "none_skipped": k == 0,
        "all_done_min_one_success": s >= 1, "all_skipped": k == t, "one_done": s + f + k >= 1, "none_failed_min_one_success": (f == 0) & (s >= 1), "always": t == t,
    }


def triggers(rule: str | Column = "trigger_rule", counts: tuple[Column, ...] | None = None) -> Column:
    """Whether a rule lets a task run, all of its dependencies having ended; without dependencies every task runs.

    ``counts``: dependencies that succeeded, failed, were skipped, and all; else the columns of these names.
    """
    rule = F.col(rule) if isinstance(rule, str) else rule
    s, f, k, t = counts or (F.coalesce(F.col(c), F.lit(0)) for c in COUNTS)
    chosen = s == t
    for name, holds in _rules(s, f, k, t).items():
        chosen = F.when(rule == name, holds).otherwise(chosen)
    return (t == 0) | ((s + f + k == t) & chosen)


def not_triggered(rule: str | Column = "trigger_rule", failed: Column | None = None) -> Column:
    """State of a task that its rule keeps from running; ``failed``: dependencies that failed, themselves or upstream."""
    rule = F.col(rule) if isinstance(rule, str) else rule
    others = rule.isin("all_failed", "all_done", "one_success", "one_failed", "none_failed", "none_skipped", "all_done_min_one_success", "all_skipped", "one_done", "none_failed_min_one_success", "always")
    failed = F.col("n_failed") + F.col("n_upstream") if failed is None else failed
    return F.when(~F.coalesce(others, F.lit(False)) & (failed > 0), UPSTREAM_FAILED).otherwise(SKIPPED)


def trigger_outcomes(nodes: DataFrame, edges: DataFrame, states: DataFrame) -> DataFrame:
    """ready, skipped or upstream_failed for each task from its dependencies' states."""
    joined = with_counts(nodes, edges, states)
    name = F.when(triggers(), "ready").when(not_triggered() == UPSTREAM_FAILED, "upstream_failed").otherwise("skipped")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_success", "n_failed", "n_skipped", "n_total")]
    return joined.select("run_rowid", "task_idx", "trigger_rule", *counts, name.alias("outcome"))


def propagate(nodes: DataFrame, edges: DataFrame, intrinsic: DataFrame) -> DataFrame:
    """Effective state of every task: what it would return if it runs, else skipped or upstream_failed, down the graph.

    The rows of a run meet in one task, which decides many runs at a time; only runs of more than ``graph.TASK_GRAPH`` rows
    go level by level. Tasks on or behind a cycle, or behind one without an own state, are left out.
    """
    key = "run_rowid"
    edges = stored(edges.select(key, "src", "dst"))  # counted, then read
    ids = nodes.select("task_idx").union(intrinsic.select("task_idx")).union(edges.select("src")).union(edges.select("dst"))
    columns = {"node": ids.schema["task_idx"].dataType.simpleString()}
    columns |= {"src": columns["node"], "rule": "tinyint", "own": "int"}

    def part(df: DataFrame, **has: str | Column) -> DataFrame:
        return df.select(key, *[(has[c] if isinstance(has.get(c), Column) else F.col(has[c]) if c in has else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])

    rows = part(nodes, node="task_idx", rule=_rule_code()).unionByName(part(intrinsic, node="task_idx", own="state")).unionByName(part(edges, node="dst", src="src"))
    n, large = graph.beyond(rows, key, graph.TASK_GRAPH)
    if large is None:
        return _decided(rows, share(n, rows), key)
    own = [df.join(F.broadcast(large), key, "left_semi") for df in (nodes, edges, intrinsic)]
    return _decided(rows.join(F.broadcast(large), key, "left_anti"), share(n, rows), key).unionByName(propagate_by_level(*own))


def _rule_code() -> Column:
    """A number for each rule, odd for those that are known, in the order of the texts."""
    rule = F.coalesce("trigger_rule", F.lit(""))
    code = F.lit(0)
    for name in sorted(enums.TRIGGER_RULES):
        code = code + (rule >= name).cast("int") + (rule > name).cast("int")
    return code


#: Rows that a task decides at once.
TOGETHER = 200_000


def _decided(rows: DataFrame, n: int, key: str) -> DataFrame:
    """(key, task_idx, state) of runs none of which is too large for a task; rows: key, node, src, rule, own."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most = [], 0, TOGETHER
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= most:
                table = pa.Table.from_batches(held).combine_chunks()
                run = _codes(table.column(key).combine_chunks())
                last = int(np.searchsorted(run, run[-1]))  # more rows of the last run may come
                if last:
                    yield _states(table.slice(0, last), run[:last], key)
                held, size = table.slice(last).to_batches(), table.num_rows - last
                most = max(TOGETHER, 2 * size)
        if size:
            table = pa.Table.from_batches(held).combine_chunks()
            yield _states(table, _codes(table.column(key).combine_chunks()), key)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    met = rows.where("node is not null").repartition(n, key).sortWithinPartitions(key)
    return met.mapInArrow(task, f"{key} {kinds[key]}, task_idx {kinds['node']}, state int")


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers from 0 for different values, in the order they are first seen; -1 for null."""
    return pc.dictionary_encode(values).indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _states(rows: pa.Table, run: np.ndarray, key: str) -> pa.RecordBatch:
    """States of the tasks of whole runs; ``run`` numbers them. Each round decides the tasks all of whose dependencies are
    decided, in all runs at once, and looks only at the edges out of them."""
    node, src, rule, own = (rows.column(c).combine_chunks() for c in ("node", "src", "rule", "own"))
    taken = lambda a: (a.is_valid().to_numpy(zero_copy_only=False), a.fill_null(0).to_numpy(zero_copy_only=False))
    ids, edge = _codes(pa.concat_arrays([node, src])), src.is_valid().to_numpy(zero_copy_only=False)
    width, n = int(ids.max()) + 1, len(node)
    run = run - run.min()
    places = _codes(pa.array(np.concatenate([run * width + ids[:n], (run * width + ids[n:])[edge]])))
    at, before, m = places[:n], places[n:], int(places.max()) + 1
    after = at[edge]
    unset = np.iinfo(np.int64).min
    rule_of, own_of = np.full(m, unset), np.full(m, unset)
    for found, column in ((rule_of, rule), (own_of, own)):
        valid, values = taken(column)
        np.maximum.at(found, at[valid], values[valid].astype(np.int64))
    known = (rule_of > unset) & (own_of > unset)
    names = sorted(enums.TRIGGER_RULES)
    number = np.array([enums.TRIGGER_RULES.index(names[c // 2]) if c % 2 else 0 for c in range(2 * len(names) + 1)])  # other texts: all_success
    rule_of = number[np.where(known, rule_of, 0)]

    total = np.bincount(after, minlength=m)
    first = np.concatenate([[0], np.cumsum(np.bincount(before, minlength=m))])
    ways, open_ = after[np.argsort(before, kind="stable")], total.copy()
    counts, state, decided = np.zeros((4, m), np.int64), np.zeros(m, np.int64), np.zeros(m, bool)
    ready = np.flatnonzero(known & (open_ == 0))
    while len(ready):
        (s, f, k, up), t, r = counts[:, ready], total[ready], rule_of[ready]
        holds = {"all_success": s == t} | _rules(s, f, k, t)
        holds = np.stack([holds[name] for name in enums.TRIGGER_RULES])[r, np.arange(len(ready))]
        runs = (t == 0) | ((s + f + k == t) & holds)
        state[ready] = np.where(runs, own_of[ready], np.where((r == 0) & (f + up > 0), UPSTREAM_FAILED, SKIPPED))
        decided[ready] = True
        size = first[ready + 1] - first[ready]
        to = ways[np.arange(size.sum()) + np.repeat(first[ready] - (np.cumsum(size) - size), size)]
        come = np.repeat(state[ready], size)
        for count, codes in zip(counts, ((SUCCESS,), (FAILED,), (SKIPPED, UPSTREAM_FAILED), (UPSTREAM_FAILED,)), strict=True):
            np.add.at(count, to[np.isin(come, codes)], 1)
        np.subtract.at(open_, to, 1)
        ready = np.unique(to[(open_[to] == 0) & known[to]])
    row = np.zeros(m, np.int64)
    row[at] = np.arange(n)
    chosen = pa.array(row[decided])
    return pa.record_batch([rows.column(key).combine_chunks().take(chosen), node.take(chosen), pa.array(state[decided].astype(np.int32))], names=[key, "task_idx", "state"])


def propagate_by_level(nodes: DataFrame, edges: DataFrame, intrinsic: DataFrame) -> DataFrame:
    """``propagate`` for runs of any size.

    Each round decides the tasks whose dependencies are all decided, with one join and one aggregation, and is stored; the
    number of rounds is that of the longest path.
    """
    open_ = nodes.select("run_rowid", "task_idx", "trigger_rule").join(intrinsic.select("run_rowid", "task_idx", F.col("state").cast("int").alias("own")), ["run_rowid", "task_idx"])
    edges = stored(edges.select("run_rowid", "src", "dst"))  # read in every round
    degree = edges.groupBy("run_rowid", F.col("dst").alias("task_idx")).agg(F.count("*").alias("n_edges"))
    open_ = stored(open_.join(degree, ["run_rowid", "task_idx"], "left"))
    done = stored(open_.where("n_edges is null").select("run_rowid", "task_idx", F.col("own").alias("state")))
    open_ = open_.where("n_edges is not null")
    fresh = done
    reached = None
    while not fresh.isEmpty():
        # Only edges out of what the last round decided are looked at; counts add up over the rounds.
        counts = dependency_counts(edges, fresh)
        reached = counts if reached is None else reached.unionByName(counts)
        names = [c for c in counts.columns if c.startswith("n_")]
        reached = stored(reached.groupBy("run_rowid", "task_idx").agg(*[F.sum(c).alias(c) for c in names]))
        ready = reached.join(open_, ["run_rowid", "task_idx"]).where("n_total = n_edges")
        fresh = stored(ready.select("run_rowid", "task_idx", F.when(triggers(), F.col("own")).otherwise(not_triggered()).cast("int").alias("state")))
        reached = reached.join(fresh.select("run_rowid", "task_idx"), ["run_rowid", "task_idx"], "left_anti")
        done = done.unionByName(fresh)
    return done


def branch_skips(edges: DataFrame, nodes: DataFrame, selections: DataFrame) -> DataFrame:
    """(run_rowid, task_idx) skipped by branching: direct dependents of a successful branch task that it didn't select.

    selections: run_rowid, task_idx of the branch task, state, and value, a JSON array of task ids. An empty, missing or
    unparseable selection skips nothing; items that are no text are ignored.
    """
    chosen = F.filter(F.try_parse_json("value").try_cast("array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    names = F.transform(chosen, lambda v: F.variant_get(v, "$", "string"))
    branches = nodes.where("is_branch").join(selections, ["run_rowid", "task_idx"]).where(F.col("state") == SUCCESS)
    branches = branches.select("run_rowid", F.col("task_idx").alias("src"), names.alias("selected")).where("size(selected) > 0")
    below = edges.join(branches, ["run_rowid", "src"]).withColumnRenamed("dst", "task_idx").join(nodes.select("run_rowid", "task_idx", "task_id"), ["run_rowid", "task_idx"])
    return below.where(~F.array_contains("selected", F.col("task_id"))).select("run_rowid", "task_idx").distinct()


def exit_outcome(exit_code: str = "exit_code", error: str | None = None) -> Column:
    """success, skipped (100), failed (101: no retry) or retry from an exit code and an error text."""
    code = F.col(exit_code)
    fine = (code == 0) & (F.lit(True) if error is None else F.coalesce(F.col(error), F.lit("")) == "")
    return F.when(fine, "success").when(code == EXIT_SKIP, "skipped").when(code == EXIT_FAIL, "failed").otherwise("retry")


def after_failure(attempt: str | Column, max_retries: str | Column) -> Column:
    """pending while attempts are left, else failed; max_retries is the number of attempts, 0 and 1 both mean one."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.when(c(attempt) < F.greatest(F.lit(1), c(max_retries)), "pending").otherwise("failed")


def final_attempt(attempts: DataFrame, max_retries: int = 3) -> DataFrame:
    """Final state of each task from a table of attempts, of which those beyond max_retries are not made."""
    made = attempts.where(F.col("attempt") <= max(1, max_retries))
    return made.groupBy("run_rowid", "task_idx").agg(F.max("attempt").alias("attempts"), F.max_by("state", "attempt").alias("state"))


def not_before(finished_at: str, retry_interval_s: int) -> Column:
    return F.col(finished_at) + F.make_interval(secs=F.lit(retry_interval_s))


def run_states(instances: DataFrame) -> DataFrame:
    """State of each run from those of its tasks: running while any is pending or running, failed if any failed, else success."""
    s = F.col("state")
    counts = instances.groupBy("run_rowid").agg(F.count_if(s.isin(PENDING, RUNNING, RETRYING)).alias("open"), F.count_if(s == FAILED).alias("failed"), F.count("*").alias("n"))
    state = F.when(F.col("open") > 0, "running").when(F.col("failed") > 0, "failed").otherwise("success")
    return counts.select("run_rowid", "n", "failed", state.alias("run_state"))


def recover(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """Tasks of incomplete runs as recovery leaves them: running ones are pending again, with the reason."""
    open_runs = runs.where("state = 0").select("run_rowid")
    state = F.when(F.col("state") == RUNNING, PENDING).otherwise(F.col("state"))
    note = F.when(F.col("state") == RUNNING, RECOVERED)
    return instances.join(open_runs, "run_rowid", "left_semi").select("run_rowid", "task_idx", state.cast("int").alias("state"), note.alias("note"))


def recovery_summary(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """recovered and failed runs, and tasks to retry; an incomplete run without tasks fails to recover."""
    counts = instances.groupBy("run_rowid").agg(F.count_if(F.col("state") == RUNNING).alias("retry"))
    joined = runs.where("state = 0").select("run_rowid").join(counts, "run_rowid", "left")
    return joined.agg(F.count("retry").alias("recovered"), F.count_if(F.col("retry").isNull()).alias("failed"), F.coalesce(F.sum("retry"), F.lit(0)).alias("tasks_to_retry"))


def crash(runs: DataFrame, instances: DataFrame) -> DataFrame:
    """Running tasks of incomplete runs as failed."""
    open_runs = runs.where("state = 0").select("run_rowid")
    hit = F.col("state") == RUNNING
    return instances.join(open_runs, "run_rowid", "left_semi").select(
        "run_rowid", "task_idx", F.when(hit, FAILED).otherwise(F.col("state")).cast("int").alias("state"), F.when(hit, CRASHED).alias("error_message")
    )


def runnable_dags(dags: DataFrame, tasks: DataFrame) -> DataFrame:
    """DAGs that can be triggered: those with a task."""
    return dags.join(tasks.select("dag_id"), "dag_id", "left_semi").select("dag_id")


def latest_states(instances: DataFrame) -> DataFrame:
    """Latest attempt of each task, ranked in a window."""
    newest = Window.partitionBy("run_rowid", "task_idx").orderBy(F.desc("attempt"))
    return instances.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
