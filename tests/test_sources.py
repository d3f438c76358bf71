import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from runloom.functions import enums
from runloom.operators import state
from runloom.plans.runner import Runner
from runloom.sources import container_logs, definitions
from runloom.streaming import feeds, machine

GOOD = """
name: Nightly
cron: "0 2 * * *"
start_date: 2024-01-01
default_args: {max_retries: 7}
tasks:
  - {id: a, command: echo a}
  - {id: b, command: echo b, max_retries: 2, dependencies: [a, {task: a, label: again}]}
"""


@pytest.mark.skipif(definitions.yaml is None, reason="needs PyYAML")
def test_definition_files(spark, tmp_path):
    (tmp_path / "nightly.yaml").write_text(GOOD)
    (tmp_path / "broken.yml").write_text("a: [")
    (tmp_path / "notes.txt").write_text("no")
    loaded = definitions.load(spark, str(tmp_path))
    rows = {r.dag_id: r for r in loaded.collect()}
    assert set(rows) == {"nightly", "broken"}
    assert rows["broken"].error and rows["broken"].tasks is None
    assert [(t.id, t.max_retries) for t in rows["nightly"].tasks] == [("a", 7), ("b", 2)]
    assert [(r.task_id, r.dep, r.label) for r in definitions.edges_of(loaded).collect()] == [("b", "a", ""), ("b", "a", "again")]
    again = definitions.decode(definitions.encode(definitions.decode(GOOD)))
    assert again == definitions.decode(GOOD)


def test_truncated_frame(spark):
    whole = F.concat(container_logs.frame(F.lit("stderr"), F.lit("é")), container_logs.frame(F.lit("stdout"), F.lit("")))
    df = spark.range(1).select("id", F.concat(whole, F.unhex(F.lit("0100000000000009AA"))).alias("raw"))
    assert [tuple(r) for r in container_logs.decoded(df, "id").collect()] == [(0, 0, "stderr", "é"), (0, 1, "stdout", "")]


def test_trigger_once_each(spark, tmp_path):
    ticks, started = str(tmp_path / "ticks"), str(tmp_path / "runs")
    schema = "dag_id string, execution_date timestamp"
    rows = [("a", dt.datetime(2024, 1, d)) for d in (1, 2)]
    spark.createDataFrame(rows[:1], schema).write.parquet(started)
    spark.createDataFrame(rows + rows, schema).write.parquet(ticks)
    query = feeds.trigger_once_each(feeds.feed(spark, ticks, schema), str(tmp_path / "ck"), lambda df: df.write.mode("append").parquet(started), lambda: spark.read.schema(schema).parquet(started))
    query.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(started).collect())) == rows


def test_runner(spark):
    runner = Runner()
    runner.kinds["sql"] = lambda s, c: s.sql(c["sql"])
    out = runner.run(spark, "d_1", [{"task_id": "a", "kind": "sql", "sql": "select 1"}, {"task_id": "b"}, {"task_id": "c", "kind": "docker"}, {"task_id": "d", "kind": "sql", "sql": "select no_such"}])
    assert {r.task_id: r.exit_code for r in out.collect()} == {"a": 0, "b": 0, "c": -1, "d": 1}


def test_run_progress(spark, tmp_path):
    ended, out = str(tmp_path / "ended"), []
    schema = "dag_run_id string, task_id string, state int, n_tasks int"
    for rows in ([("r1", "a", 2, 2), ("r2", "a", 2, 2)], [("r1", "b", 3, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(ended)
    stream = feeds.run_progress(feeds.feed(spark, ended, schema, files_at_once=1))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    query.awaitTermination(180)
    latest = {r.dag_run_id: (r.n_done, r.n_failed, r.run_state) for r in out}
    assert latest == {"r1": (2, 1, "failed"), "r2": (1, 0, "running")}


def test_messages_of_one_run(spark):
    logs = spark.createDataFrame([(1, "r1", "t", dt.datetime(2024, 1, 1), "INFO", "stdout", 'say "x"'), (2, "r2", "t", None, "INFO", "stdout", "")], "id long, dag_run_id string, task_id string, ts timestamp, level string, stream string, message string")
    assert [tuple(r) for r in feeds.messages(logs, "r1").collect()] == [(1, r'{"type":"log","dag_run_id":"r1","task_id":"t","timestamp":"2024-01-01T00:00:00Z","level":"INFO","stream":"stdout","message":"say \"x\""}')]


def test_many_frames(spark):
    """Logs of no, one and many frames, unknown streams, empty payloads and bytes that are no text."""
    rng = random.Random(1)
    logs, want = [], []
    for k in range(40):
        raw = b""
        for place in range(rng.choice([0, 1, 2, 30])):
            stream, payload = rng.choice([0, 1, 2, 7]), rng.choice([b"", b"text", "ü".encode(), b"\xff\xfe", b"x" * 300])
            raw += bytes([stream, 0, 0, 0]) + len(payload).to_bytes(4, "big") + payload
            want.append((k, place, container_logs.STREAMS.get(stream, "stdout"), payload.decode(errors="replace")))
        logs.append((k, bytearray(raw + rng.choice([b"", b"\x01\0\0", b"\x01\0\0\0\0\0\0\x09short"]))))
    df = spark.createDataFrame([*logs, (99, None)], "id long, raw binary").repartition(3)
    assert sorted(map(tuple, container_logs.decoded(df, "id").collect())) == sorted(want)


EVENTS = "dag_run_id string, kind string, definition string, task_id string, attempt int, state int"


def test_runs_as_state_of_a_stream(spark, tmp_path):
    """A worker that ends every attempt it is given, delivering each end twice: the final states are those of the batch operator."""
    rng = random.Random(7)
    nodes, edges, outcome, tries = [], [], {}, {}
    for g in range(8):
        for x in range(6):
            nodes.append((g, x, rng.choice([*enums.TRIGGER_RULES, "all_success"])))
            outcome[g, x], tries[g, x] = rng.choice([2, 2, 3, 6]), rng.choice([0, 1, 3])
            edges += [(g, a, x) for a in range(x) if rng.random() < 0.4]
    folder, out = tmp_path / "events", tmp_path / "out"
    todo = []
    for g in range(8):
        tasks = [{"task_id": f"t{x}", "rule": r, "deps": [f"t{a}" for h, a, b in edges if (h, b) == (g, x)], "max_retries": tries[g, x]} for h, x, r in nodes if h == g]
        todo.append((f"r{g}", "start", json.dumps(tasks), None, None, None))
    seen, found = 0, []
    for step in range(60):
        if not todo:
            break
        spark.createDataFrame(todo + todo, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
        actions = machine.run_actions(feeds.feed(spark, str(folder), EVENTS))
        actions.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).option("path", str(out)).trigger(availableNow=True).start().awaitTermination(120)
        found = sorted(map(tuple, spark.read.parquet(str(out)).collect()), key=str)
        fresh, todo = [r for r in found if r[2] in ("run", "retry")], []
        for run, task, _, attempt in [r for r in fresh if (r[0], r[1], r[3]) not in tries]:
            g, x = int(run[1:]), int(task[1:])
            tries[run, task, attempt] = True
            # A task that fails in the end fails every time; others fail until their last attempt.
            last = attempt >= max(1, tries[g, x])
            todo.append((run, "ended", None, task, attempt, outcome[g, x] if last or outcome[g, x] == 6 else 3))
        seen = step
    assert len(found) == len(set(found)) and seen < 59
    frames = [spark.createDataFrame(nodes, "run_rowid long, task_idx int, trigger_rule string"), spark.createDataFrame(edges, "run_rowid long, src int, dst int"), spark.createDataFrame([(*k, v) for k, v in outcome.items()], "run_rowid long, task_idx int, state int")]
    want = {(f"r{r.run_rowid}", f"t{r.task_idx}"): r.state for r in state.propagate(*frames).collect()}
    ran = {(r[0], r[1]) for r in found if r[2] == "run"}
    left = {(r[0], r[1]): {"skipped": 6, "upstream_failed": 4}[r[2]] for r in found if r[2] in ("skipped", "upstream_failed")}
    for k, s in want.items():
        assert (k in ran) != (k in left)
        assert left.get(k, outcome[int(k[0][1:]), int(k[1][1:])]) == s
    whole = {r[0]: r[2] for r in found if r[1] is None}
    assert whole == {f"r{g}": "failed" if any(s == 3 for (r, _), s in want.items() if r == f"r{g}") else "success" for g in range(8)}
