"""Every registered query of the control plane against its SQL."""

import datetime
import math

import duckdb
import pytest

from runloom import queries
from runloom.plans.control_plane import ControlPlane

#: Queries that join a table with a single row, an aggregate, without a condition; no other plan has a join of that kind.
ONE_ROW = {"o16b_insert_all_or_nothing", "o51_status", "o52_dashboard"}
TABLES = "region nation customer supplier part orders lineitem events".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, duck, name):
    df = queries.queries()[name](spark, data)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan or name in ONE_ROW
    got = sorted((tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    result = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted((tuple(norm(r[columns.index(c)]) for c in sorted(columns)) for r in result.fetchall()), key=repr)
    assert got == want


def test_cron_dedup_of_all_dags(spark, data):
    """Ticks of every DAG that has runs are checked, by an equality join."""
    df = queries.queries()["o39e_cron_dedup_all"](spark, data)
    assert "NestedLoop" not in df._jdf.queryExecution().simpleString()
    runs = {(r.dag_id, r.execution_date) for r in ControlPlane(spark, data).dag_runs.select("dag_id", "execution_date").collect()}
    ticks = {(d, t + datetime.timedelta(days=k)) for d, t in runs for k in range(8)}
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == ticks - runs
    assert {d for d, _ in got} == {d for d, _ in runs}


def test_all_runs_take_part(spark, data):
    """Run states, recovery, crashes and reachability are those of all runs."""
    c = ControlPlane(spark, data)
    found = {n: queries.queries()[n](spark, data) for n in ("o57e_run_states_all", "o57f_recover_all", "o57g_crash_all", "o62f_reachable_all")}
    runs = lambda df: {r[0] for r in df.select("run_rowid").distinct().collect()}
    unfinished = c.task_instances.join(c.dag_runs.where("state = 0"), "run_rowid", "left_semi")
    assert runs(found["o57e_run_states_all"]) == runs(c.task_instances)
    assert runs(found["o57f_recover_all"]) == runs(found["o57g_crash_all"]) == runs(unfinished)
    steps, want = {}, set()
    for k, a, b in c.edges.select("run_rowid", "src", "dst").collect():
        steps.setdefault((k, a), set()).add(b)
    for (k, a), ends in steps.items():
        for _ in range(3):
            want |= {(k, a, b) for b in ends}
            ends = {d for b in ends for d in steps.get((k, b), ())}
    got = [tuple(r) for r in found["o62f_reachable_all"].select("run_rowid", "src", "dst").collect()]
    assert len(got) == len(set(got)) and set(got) == want
