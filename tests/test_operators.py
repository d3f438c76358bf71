"""Literal cases of single operators."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from runloom import queries
from runloom.functions import cron, enums, text, values
from runloom.operators import catalog, changelog, graph, reads, schedule, state

CODES = {"s": 2, "f": 3, "k": 6, "u": 4}
# What each rule gives for dependencies that all succeed, all fail, are all skipped, and mixtures.
MIXES = ["sss", "fff", "kkk", "sf", "sk", "fk", "su", "sss"]


def expected(rule, mix):
    s, f, k, t = mix.count("s"), mix.count("f"), mix.count("k") + mix.count("u"), len(mix)
    runs = {
        "all_success": s == t, "all_failed": f == t, "all_done": True, "one_success": s > 0, "one_failed": f > 0, "none_failed": f == 0, "none_skipped": k == 0,
        "all_done_min_one_success": s > 0, "all_skipped": k == t, "one_done": True, "none_failed_min_one_success": f == 0 and s > 0, "always": True,
    }[rule]
    return "ready" if runs else "upstream_failed" if rule == "all_success" and (f or "u" in mix) else "skipped"


def test_trigger_rules(spark):
    nodes, edges, states, want = [], [], [], {}
    for i, rule in enumerate(enums.TRIGGER_RULES):
        for j, mix in enumerate(MIXES):
            run = i * 100 + j
            nodes.append((run, 99, rule))
            want[run] = expected(rule, mix)
            for x, c in enumerate(mix):
                edges.append((run, x, 99))
                states.append((run, x, CODES[c]))
    out = state.trigger_outcomes(spark.createDataFrame(nodes, "run_rowid long, task_idx int, trigger_rule string"), spark.createDataFrame(edges, "run_rowid long, src int, dst int"), spark.createDataFrame(states, "run_rowid long, task_idx int, state int"))
    assert {r.run_rowid: r.outcome for r in out.collect()} == want


def test_shares_of_tasks_do_not_grow(spark, data, monkeypatch):
    """Every shuffle of the counts goes to as many partitions as the size of the table asks for."""
    from runloom.plans import storage

    monkeypatch.setattr(storage, "PART", 4096, raising=False)
    for name in ("o48_dependency_counts", "o40_trigger_rule_outcomes", "o40_rule_one_done"):
        plan = queries.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        dealt = [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)]
        assert dealt and min(dealt) > 4, plan


def test_shares_go_by_rows(spark, data, monkeypatch):
    """A table that its files pack very tightly is dealt to as many tasks as any other with its rows, and not to ever more."""
    from runloom.plans import storage

    rows = spark.range(400_000).selectExpr("1 as a", "2 as b", "cast(id div 1000000 as int) as c")
    tight = storage.stored(rows.coalesce(1))
    monkeypatch.setattr(storage, "PART", 400_000 * 12 // 50)
    assert storage.parts(tight) == 50 and storage.parts(tight.limit(0)) >= 4
    monkeypatch.setattr(storage, "PART", 1024)
    assert storage.parts(tight) == -(-400_000 * 12 // (16 * 1024))
    monkeypatch.setattr(storage, "PART", 400_000 * 12 // 1000)
    assert storage.parts(tight) == 200  # a shuffle's writer holds no rows up to here


def test_gate_waits_for_all_dependencies(spark):
    nodes = spark.createDataFrame([(1, 2, "one_success")], "run_rowid long, task_idx int, trigger_rule string")
    edges = spark.createDataFrame([(1, 0, 2), (1, 1, 2)], "run_rowid long, src int, dst int")
    states = spark.createDataFrame([(1, 0, 2), (1, 1, 1)], "run_rowid long, task_idx int, state int")
    assert state.trigger_outcomes(nodes, edges, states).first().outcome == "skipped"  # not ready: a dependency still runs


def test_propagation_and_unknown_rule(spark):
    nodes = spark.createDataFrame([(1, 0, "all_success"), (1, 1, "whatever"), (1, 2, "all_done"), (1, 3, "none_skipped")], "run_rowid long, task_idx int, trigger_rule string")
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 1, 3)], "run_rowid long, src int, dst int")
    own = spark.createDataFrame([(1, 0, 3), (1, 1, 2), (1, 2, 2), (1, 3, 2)], "run_rowid long, task_idx int, state int")
    assert {r.task_idx: r.state for r in state.propagate(nodes, edges, own).collect()} == {0: 3, 1: 4, 2: 2, 3: 6}


@pytest.mark.parametrize(
    ("expression", "count"),
    [("@daily", 31), ("0 0 1 * *", 1), ("0 0 13 * fri", 5), ("*/30 * 1 1 *", 48), ("0 0 31 2 *", 0), ("0 12 * jan mon-wed", 15), ("0 0 * * 7", 4), ("0 0 * * 5-7", 12), ("5/10 0 1 1 *", 1), ("0 0 */1 * *", 31)],
)
def test_cron_counts(spark, expression, count):
    rows = spark.createDataFrame([("d", expression, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))], "dag_id string, cron string, start_date timestamp, end_date timestamp")
    assert schedule.ticks_between(rows).count() == count


@pytest.mark.parametrize("expression", ["", "* * * *", "60 * * * *", "5-1 * * * *", "@never", "* * 0 * *", "*/0 * * * *", "a * * * *"])
def test_cron_errors(expression):
    assert cron.parse(expression) is None


def test_next_after(spark):
    rows = spark.createDataFrame([("a", "0 0 29 2 *", dt.datetime(2023, 3, 1)), ("b", "30 5 * * *", dt.datetime(2024, 1, 1, 5, 30)), ("c", "0 0 31 2 *", dt.datetime(2024, 1, 1)), ("d", "30 5 * * *", dt.datetime(2024, 1, 1, 5, 29, 59))], "dag_id string, cron string, at timestamp")
    assert {r.dag_id: r.next_time for r in schedule.next_after(rows, "at").collect()} == {"a": dt.datetime(2024, 2, 29), "b": dt.datetime(2024, 1, 2, 5, 30), "c": None, "d": dt.datetime(2024, 1, 1, 5, 30)}


def test_next_after_row_by_row(spark):
    """Each row's next time is the first of its ticks after it, and no row is moved to meet its expression."""
    rng, cases = random.Random(3), []
    for i, e in enumerate(["0 0 29 2 *", "*/7 5-9 * * *", "0 12 13 * fri", "59 23 31 * *", "0 0 1 jan,jul *", "15 3 * * 7", "0 0 30 2 *", "@weekly", "nope", None]):
        cases += [(f"{i}_{k}", e, dt.datetime(2023, 1, 1) + dt.timedelta(minutes=rng.randrange(1000000))) for k in range(20)]
    rows = spark.createDataFrame(cases, "dag_id string, cron string, at timestamp").repartition(3)
    out = schedule.next_after(rows, "at")
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString() and "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()
    after = rows.select("dag_id", "cron", (F.date_trunc("minute", "at") + F.expr("interval 1 minute")).alias("start_date"), (F.col("at") + F.expr("interval 1900 days")).alias("end_date"))
    want = {r.dag_id: r.t for r in schedule.ticks_between(after, limit=None).groupBy("dag_id").agg(F.min("execution_date").alias("t")).collect()}
    assert {r.dag_id: r.next_time for r in out.collect()} == {k: want.get(k) for k, e, _ in cases if e not in ("nope", None)}


def test_first_ticks_are_not_sorted(spark):
    """The first ticks of each DAG are those of all its schedules together; only where it has several are they sorted."""
    at = lambda *a: dt.datetime(2024, *a)
    cases = [("a", "* * * * *", at(1, 1, 12, 7), at(3, 1)), ("b", "*/30 * * * *", at(1, 1), at(2, 1)), ("b", "0 */2 * * *", at(1, 3), at(3, 1)), ("c", "0 0 * * *", at(1, 5), at(1, 1)), ("d", "7 7 * * mon", at(1, 1, 8), at(2, 1)), ("e", "nope", at(1, 1), at(2, 1))]
    rows = spark.createDataFrame(cases, "dag_id string, cron string, start_date timestamp, end_date timestamp")
    every = {}
    for r in schedule.ticks_between(rows, limit=None).collect():
        every.setdefault(r.dag_id, []).append(r.execution_date)
    for limit in (1, 50, 700, 1000, 100000):
        got = [tuple(r) for r in schedule.ticks_between(rows, limit=limit).collect()]
        assert sorted(got) == sorted((d, t) for d, ticks in every.items() for t in sorted(ticks)[:limit])
    plan = schedule.ticks_between(rows)._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union" and "row_number" not in plan.children().head().toString()


def test_graph(spark):
    edges = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 2, 3), (2, 0, 1), (2, 1, 2), (2, 0, 2), (2, 0, 2), (3, 5, 5)], "run_rowid long, src int, dst int")
    nodes = spark.createDataFrame([(2, 0), (2, 1), (2, 2), (2, 9), (1, 0), (1, 1), (1, 2), (1, 3)], "run_rowid long, task_idx int")
    assert {(r.run_rowid, r.node) for r in graph.cyclic_nodes(edges).collect()} == {(1, 0), (1, 1), (1, 2), (3, 5)}
    assert {(r.run_rowid, r.task_idx): r.layer for r in graph.layers(nodes, edges).collect()} == {(2, 0): 0, (2, 9): 0, (2, 1): 1, (2, 2): 2}
    assert {(r.run_rowid, r.task_idx) for r in graph.roots(nodes, edges).collect()} == {(2, 0), (2, 9)}
    assert (1, 0, 0) in {tuple(r) for r in graph.reachable(edges, 3).collect()}


def test_prefix_of_dag_id(spark):
    runs = spark.createDataFrame([("etl_1", "etl"), ("etl2_1", "etl2"), ("etl_daily_1", "etl_daily"), ("ETL_2", "ETL")], "dag_run_id string, dag_id string")
    assert [r.dag_run_id for r in reads.runs_of_dag(runs, "etl").collect()] == ["etl_1"]
    assert reads.runs_of_dag(runs, "etl", compat_like=True).count() == 4
    assert [r[0] for r in runs.select(reads.dag_id_of("dag_run_id")).collect()] == ["etl", "etl2", "etl_daily", "ETL"]


def test_template(spark):
    cases = [("{{ds}}|{{ ts_nodash }}", "2024-01-02|20240102T030405"), (r"\{{ds}}", "{{ds}}"), ("{{ds", "{{ds"), ("{{nope}}", "{{nope}}"), ("{{xcom.t.a.b}}", "v"), ("a\n{{ds_nodash}}", "a\n20240102"), ("", ""), ("{{xcom.t.none}}", "{{xcom.t.none}}")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    out = df.select("i", text.resolve_template("t", text.date_values("at"), F.create_map(F.lit("t.a.b"), F.lit("v"))).alias("x"))
    assert {r.i: r.x for r in out.collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_values(spark):
    out = spark.createDataFrame([(0, 'log\n{"a": {"b": [1, 2.5]}}\nend', "e")], "exit_code int, stdout string, stderr string")
    take = lambda **k: values.extracted(out, "x", **k).select(values.text_form(F.col("value")).alias("v"), "error").first()
    assert tuple(take(source="json", path="a.b[0]")) == ("1", None)
    assert tuple(take(source="json", path=".a.b[1]")) == ("2.500000", None)
    assert take(source="json", path="a.c").error == "NotFound"
    assert tuple(take(source="stdout", pattern="(l)(og)", group=2)) == ("og", None)
    assert take(source="stderr", pattern="zzz").error == "NotFound"
    assert tuple(take(source="exit_code")) == ("0", None)
    with pytest.raises(ValueError):
        values.regex_group("stdout", "x", 1)


def test_changelog(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 2, 3), ("b", 5, 2), ("a", None, 2)], "k string, v int, version int")
    assert {r.k: r.v for r in changelog.current(log, ["k"]).collect()} == {"a": 2, "b": 5}
    table, change = log.where("version > 2").drop("version"), spark.createDataFrame([("a", None), ("z", 1)], "k string, v int")
    assert {r.k: r.v for r in changelog.merge(table, change, ["k"]).collect()} == {"a": None, "z": 1}
    applied, unmatched = changelog.update(table, change, ["k"])
    assert [tuple(r) for r in applied.collect()] == [("a", None)]
    assert [r.k for r in unmatched.collect()] == ["z"]


def test_branching_edge_cases(spark):
    nodes = spark.createDataFrame([(i, x, f"t{x}", x == 0) for i in range(4) for x in range(3)], "run_rowid long, task_idx int, task_id string, is_branch boolean")
    edges = spark.createDataFrame([(i, 0, x) for i in range(4) for x in (1, 2)], "run_rowid long, src int, dst int")
    chosen = spark.createDataFrame([(0, 0, 2, '["t1", 3, "zz"]'), (1, 0, 2, "[]"), (2, 0, 2, "oops"), (3, 0, 3, '["t1"]')], "run_rowid long, task_idx int, state int, value string")
    assert [tuple(r) for r in state.branch_skips(edges, nodes, chosen).collect()] == [(0, 2)]


def test_reachable_of_many_pairs(spark):
    """More pairs than a recursive query of Spark may return."""
    edges = spark.range(600_000).selectExpr("id div 4 as run_rowid", "cast(id % 4 as int) as src", "cast(id % 4 as int) + 1 as dst")
    out = graph.reachable(edges, 3)
    assert out.count() == 150_000 * (4 + 3 + 2)
    assert sorted((r.src, r.dst) for r in out.where("run_rowid = 7").collect()) == [(a, b) for a in range(5) for b in range(a + 1, 5) if b - a <= 3]


def test_numbered_in_ranges(spark):
    """Places go on from range to range, and no window holds all rows."""
    rows = spark.range(5000).select(F.col("id"), (F.col("id") * 7919 % 50).alias("ts"))
    out = reads.numbered(rows.repartition(7), "ts", "id")
    want = sorted((i * 7919 % 50, i) for i in range(5000))
    assert sorted((r.place, r.ts, r.id) for r in out.collect()) == [(n, *x) for n, x in enumerate(want, 1)]
    assert reads.numbered(rows.limit(0), "ts", "id").count() == 0


def test_all_log_lines_are_numbered(spark, data):
    found = queries.queries()
    n = spark.read.parquet(f"{data}/events.parquet").count()
    assert found["o56g_all_logs_by_time"](spark, data).agg(F.max("place")).first()[0] == n
    plan = found["o56b_logs_by_time"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ts" not in plan  # no order over all rows without a partition


def test_layers_of_small_and_large_graphs(spark, monkeypatch):
    """The same layers whether a graph is one row or peeled; nodes on or behind cycles, or behind unknown ones, are left out."""
    rng = random.Random(3)
    edges = [(g, a, b) for g in range(12) for a in range(14) for b in range(a + 1, 14) if rng.random() < 0.12]
    edges += [(50, 0, 1), (50, 1, 2), (50, 2, 1), (50, 2, 3), (50, 4, 5), (51, 77, 1), (51, 1, 2), (52, 3, 3)]
    nodes = [(g, x) for g in range(12) for x in range(14)] + [(50, x) for x in range(6)] + [(51, 1), (51, 2), (51, 9), (52, 3)]
    e, n = spark.createDataFrame(edges, "run_rowid long, src int, dst int"), spark.createDataFrame(nodes, "run_rowid long, task_idx int")
    want = {}
    for g, x in sorted(nodes):
        if g < 12:
            want[g, x] = max((1 + want[g, a] for h, a, b in edges if (h, b) == (g, x)), default=0)
    want |= {(50, 0): 0, (50, 4): 0, (50, 5): 1, (51, 9): 0}
    for size in (64, 20, 0):
        monkeypatch.setattr(graph, "SMALL_GRAPH", size)
        assert {(r.run_rowid, r.task_idx): r.layer for r in graph.layers(n, e).collect()} == want


def test_propagation_of_small_and_large_runs(spark, monkeypatch):
    rng = random.Random(4)
    edges = [(g, a, b) for g in range(30) for a in range(8) for b in range(a + 1, 8) if rng.random() < 0.3]
    nodes = [(g, x, rng.choice([*enums.TRIGGER_RULES, "whatever", None])) for g in range(30) for x in range(8)]
    states = [(g, x, rng.choice([2, 3, 6])) for g in range(30) for x in range(8) if (g, x) != (5, 0)]
    own, rule, want = {(g, x): s for g, x, s in states}, {(g, x): r for g, x, r in nodes}, {}
    for g, x, _ in nodes:
        before = [want.get((g, a)) for h, a, b in edges if (h, b) == (g, x)]
        if None in before or (g, x) not in own:
            continue
        mix = "".join({2: "s", 3: "f", 6: "k", 4: "u"}[s] for s in before)
        known = rule[g, x] if rule[g, x] in enums.TRIGGER_RULES else "all_success"
        want[g, x] = own[g, x] if not mix else {"ready": own[g, x], "skipped": 6, "upstream_failed": 4}[expected(known, mix)]
    frames = [spark.createDataFrame(nodes, "run_rowid long, task_idx int, trigger_rule string"), spark.createDataFrame(edges, "run_rowid long, src int, dst int"), spark.createDataFrame(states, "run_rowid long, task_idx int, state int")]
    for size in (64, 25, 0):
        monkeypatch.setattr(graph, "SMALL_GRAPH", size)
        assert {(r.run_rowid, r.task_idx): r.state for r in state.propagate(*frames).collect()} == want


@pytest.mark.parametrize(("in_task", "together"), [(100_000, 200_000), (40, 30), (0, 30)])
def test_propagation_of_runs_beyond_a_row(spark, monkeypatch, in_task, together):
    """Long runs are decided in a task, without rounds, wherever its rows are cut; those too large for one go by level."""
    monkeypatch.setattr(graph, "TASK_GRAPH", in_task)
    monkeypatch.setattr(state, "TOGETHER", together, raising=False)
    tables, stored = [], state.stored
    for module in (state, graph):
        monkeypatch.setattr(module, "stored", lambda df: tables.append(1) or stored(df))
    rng, length = random.Random(6), {"a": 30, "b": 5, "c": 12, "d": 1, "e": 2}
    edges = [(g, str(x), str(x + 1)) for g, n in length.items() for x in range(n)] + [("a", "3", "7"), ("a", "3", "7"), ("b", "9", "2"), ("c", "6", "4"), ("e", "zz", "1")]
    nodes = [(g, str(x), rng.choice([*enums.TRIGGER_RULES, "oo", None])) for g, n in length.items() for x in range(n + 1)]
    states = [(g, x, rng.choice([1, 2, 2, 3, 4, 6])) for g, x, _ in nodes]
    own, want = {(g, x): s for g, x, s in states}, {}
    for g, x, r in nodes:
        before = [want.get((g, a)) for h, a, b in edges if (h, b) == (g, x)]
        if None in before or (g, x) in {("b", "2"), ("c", "4")}:
            continue
        mix = "".join({2: "s", 3: "f", 6: "k", 4: "u"}.get(s, "?") for s in before)
        known = r if r in enums.TRIGGER_RULES else "all_success"
        verdict = expected(known, mix)
        if "?" in mix and verdict == "ready":  # a dependency has not ended
            verdict = "upstream_failed" if known == "all_success" and ("f" in mix or "u" in mix) else "skipped"
        want[g, x] = own[g, x] if not mix else {"ready": own[g, x], "skipped": 6, "upstream_failed": 4}[verdict]
    frames = [spark.createDataFrame(nodes, "run_rowid string, task_idx string, trigger_rule string"), spark.createDataFrame(edges, "run_rowid string, src string, dst string"), spark.createDataFrame(states, "run_rowid string, task_idx string, state int")]
    got = state.propagate(*frames)
    assert {(r.run_rowid, r.task_idx): r.state for r in got.collect()} == want and got.count() == len(want)
    assert len(tables) == 1 or in_task < 100_000


@pytest.mark.parametrize("size", [64, 0])
def test_cycles(spark, monkeypatch, size):
    """Nodes between cycles are on none; parallel, nested and touching cycles."""
    monkeypatch.setattr(graph, "SMALL_GRAPH", size)
    rng = random.Random(5)
    edges = [(1, 0, 1), (1, 1, 0), (1, 1, 2), (1, 2, 3), (1, 3, 4), (1, 4, 3), (2, 7, 7), (2, 7, 8), (3, 0, 1), (4, 0, 1), (4, 1, 2), (4, 2, 0), (4, 1, 0), (4, 2, 5), (4, 5, 6), (4, 6, 5)]
    edges += [(g, rng.randrange(9), rng.randrange(9)) for g in range(10, 16) for _ in range(11)]
    reach = {(g, a, b) for g, a, b in edges}
    while new := {(g, a, d) for g, a, b in reach for h, c, d in edges if (g, b) == (h, c)} - reach:
        reach |= new
    got = [(r.run_rowid, r.node) for r in graph.cyclic_nodes(spark.createDataFrame(edges, "run_rowid long, src int, dst int")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, a) for g, a, b in reach if a == b}


@pytest.mark.parametrize("in_task", [0, 6, 40])
def test_cycles_of_contracted_graphs(spark, monkeypatch, in_task):
    """Large graphs, contracted until a task takes them: chains, loops and dense parts; nothing is left to a task, or not all."""
    monkeypatch.setattr(graph, "SMALL_GRAPH", 1)
    monkeypatch.setattr(graph, "TASK_GRAPH", in_task)
    rng = random.Random(5)
    edges = {(g, rng.randrange(n), rng.randrange(n)) for g, (n, m) in enumerate([(40, 40), (60, 55), (30, 60), (12, 60), (50, 52)]) for _ in range(m)}
    edges |= {(9, x, x + 1) for x in range(30)} | {(9, 20, 5), (9, 2, 2), (9, 30, 30)} | {(10, x, (x + 1) % 25) for x in range(25)}
    reach = set(edges)
    while more := {(g, a, d) for g, a, b in reach for h, c, d in edges if g == h and b == c} - reach:
        reach |= more
    got = [(r.run_rowid, r.node) for r in graph.cyclic_nodes(spark.createDataFrame(sorted(edges), "run_rowid long, src int, dst int")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, a) for g, a, b in reach if a == b}


def test_rounds_of_a_long_chain(spark, monkeypatch):
    """A path that leads nowhere, and a cycle, of 1,500 nodes each: rounds are as their logarithm."""
    monkeypatch.setattr(graph, "TASK_GRAPH", 100, raising=False)
    tables, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(1) or (stored(df) if len(tables) < 120 else pytest.fail("too many rounds")))
    edges = [(0, x, x + 1) for x in range(1500)] + [(0, 2000 + x, 2000 + (x + 1) % 1500) for x in range(1500)] + [(0, 2000, 0), (0, 1500, 4000)]
    got = graph.cyclic_nodes(spark.createDataFrame(edges, "run_rowid long, src int, dst int")).collect()
    assert sorted(r.node for r in got) == list(range(2000, 3500))


def test_edges_that_close_cycles(spark):
    nodes = spark.createDataFrame([(1, x) for x in range(5)], "run_rowid long, task_idx int")
    existing = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "run_rowid long, src int, dst int")
    new = spark.createDataFrame([(1, 3, 0), (1, 3, 1), (1, 0, 3), (1, 4, 0), (1, 2, 2), (1, 0, 9)], "run_rowid long, src int, dst int")
    out = {(r.src, r.dst): r.error for r in graph.refused_edges(nodes, new, existing=existing).collect()}
    assert out == {(3, 0): "CycleDetected", (3, 1): "CycleDetected", (2, 2): "InvalidArgument", (0, 9): "NotFound"}


@pytest.mark.parametrize("small", [64, 24])
def test_closing_edges_of_many_graphs(spark, monkeypatch, small):
    """Against plain reachability; small graphs take no rounds: the tables stored are as many for long as for short paths."""
    monkeypatch.setattr(graph, "SMALL_GRAPH", small)
    tables, stored = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: tables.append(1) or stored(df))
    rng = random.Random(8)
    edges = {(g, rng.randrange(2 + g), rng.randrange(2 + g)) for g in range(14) for _ in range(g + 2)} | {(20, x, x + 1) for x in range(20)}
    new = {(g, rng.randrange(4 + g), rng.randrange(4 + g)) for g in range(15) for _ in range(20)} | {(20, 20, 0), (20, 0, 20), (20, 19, 4)}
    reach = set(edges)
    while more := {(g, a, d) for g, a, b in reach for h, c, d in edges if g == h and b == c} - reach:
        reach |= more
    frame = lambda rows: spark.createDataFrame(sorted(rows), "run_rowid long, src int, dst int")
    got = [tuple(r) for r in graph.closing_edges(frame(edges), frame(new)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(g, a, b) for g, a, b in new if a == b or (g, b, a) in reach}
    assert len(tables) == 3 or small < 64


def test_repeated_changes(spark):
    """A key has one row after a merge or an update, whatever the changes repeat."""
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    changes = spark.createDataFrame([("a", 5, 1), ("a", 3, 2), ("z", 7, 1), ("z", 8, 0)], "k string, v int, version int")
    assert sorted(map(tuple, changelog.merge(table, changes.drop("version"), ["k"]).collect())) == [("a", 5), ("b", 2), ("z", 8)]
    assert sorted(map(tuple, changelog.merge(table, changes, ["k"], version="version").collect())) == [("a", 3), ("b", 2), ("z", 7)]
    assert sorted(map(tuple, changelog.update(table, changes, ["k"], version="version")[0].collect())) == [("a", 3), ("b", 2)]


def test_batches_are_inserted_whole_or_not(spark):
    table, rows = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(2, "y"), (3, "z")], "k int, v string")
    whole, refused = changelog.insert_all(table, rows, ["k"])
    assert whole.count() == 3 and refused.count() == 0
    for bad in (rows.unionByName(table), rows.unionByName(rows.limit(1)), rows.limit(0)):
        whole, refused = changelog.insert_all(table, bad, ["k"])
        assert [tuple(r) for r in whole.collect()] == [(1, "x")]
    assert changelog.cleared(table).count() == 0


def test_catalog(spark):
    dags = spark.createDataFrame([("d",)], "dag_id string")
    tasks = spark.createDataFrame([("d", "a", "x"), ("d", "b", "y")], "dag_id string, task_id string, command string")
    deps = spark.createDataFrame([("d", "b", "a")], "dag_id string, task_id string, dep string")
    new = spark.createDataFrame([("d", "a"), ("d", "c"), ("d", "e"), ("d", "f"), ("n", "a")], "dag_id string, task_id string")
    new_deps = spark.createDataFrame([("d", "c", "b"), ("d", "e", "zz"), ("d", "f", "f")], deps.schema)
    verdicts = catalog.add_tasks(dags, tasks, deps, new, new_deps)
    assert {(r.dag_id, r.task_id): r.error for r in verdicts.collect()} == {("d", "a"): "AlreadyExists", ("d", "c"): None, ("d", "e"): "NotFound", ("d", "f"): "InvalidArgument", ("n", "a"): "NotFound"}
    assert [r.task_id for r in catalog.accepted(new, verdicts).collect()] == ["c"]
    changed = catalog.update_tasks(tasks, deps, new.where("task_id in ('a', 'c')"), spark.createDataFrame([("d", "a", "b")], deps.schema))
    assert {(r.dag_id, r.task_id): r.error for r in changed.collect()} == {("d", "a"): "InvalidArgument", ("d", "c"): "NotFound", ("n", "a"): "NotFound"}
    gone = catalog.delete_tasks(dags, tasks, deps, spark.createDataFrame([("d", "a"), ("d", "b"), ("d", "q"), ("n", "a")], new.schema))
    assert {(r.dag_id, r.task_id): r.error for r in gone.collect()} == {("d", "a"): "InvalidArgument", ("d", "b"): None, ("d", "q"): "NotFound", ("n", "a"): "NotFound"}
    assert {r.task_id: (r.command, r.error) for r in catalog.get_tasks(tasks, new.where("dag_id = 'd'")).collect()}["a"] == ("x", None)


def test_more_templates(spark):
    """White space of all kinds is trimmed, unset dates and unknown names stay, intervals end with Z."""
    cases = [("{{\tds\n}}", "2024-01-02"), ("{{execution_date}}", "{{execution_date}}"), ("{{data_interval_start}}", "{{data_interval_start}}"), ("{{data_interval_end}}", "2024-01-02T03:04:05Z")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    out = df.select("i", text.resolve_template("t", text.date_values("at", end="at")).alias("x"))
    assert {r.i: r.x for r in out.collect()} == {i: w for i, (_, w) in enumerate(cases)}


def test_bytes_and_json(spark):
    df = spark.createDataFrame([("äöü", [("a\"b\\", ""), ("c", "l")])], "t string, d array<struct<task:string,label:string>>")
    row = df.select(text.truncated("t", 4).alias("four"), text.truncated("t", 3).alias("three"), text.truncated("t").alias("all"), values.dependency_json("d").alias("json")).first()
    assert (row.four, row.three, row.all) == ("äö", "ä�", "äöü")
    assert json.loads(row.json) == ["a\"b\\", {"task": "c", "label": "l"}]


@pytest.mark.parametrize("expression", ["@midnight", "+5 * * * *", "1_0 * * * *", "٥ * * * *", "*/+2 * * * *"])
def test_cron_takes_plain_digits(expression):
    assert cron.parse(expression) is None
