"""Registered queries over the control-plane views, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cron, enums, text, values
from .operators import catalog, changelog, graph, reads, schedule, state
from .plans.control_plane import ControlPlane, oracle
from .sources import container_logs, sensors
from .streaming import feeds

NOW = "2024-01-20 12:30:00"

_found: dict[str, tuple[Callable[[ControlPlane], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, also: str | None = None):
    """Registers a query; ``also`` is a second name that it has had."""

    def add(f: Callable[[ControlPlane], DataFrame]):
        for n in (name, also):
            if n:
                _found[n] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, folder, f=f: f(ControlPlane(spark, folder))) for name, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    # Braces in a text are written << and >> there, for {name} marks a table.
    return {name: oracle(sql).replace("<<", "{{").replace(">>", "}}") if name in DOUBLE else oracle(sql).replace("<<", "{").replace(">>", "}") for name, (_, sql) in _found.items() if sql}


#: Queries whose SQL has double braces.
DOUBLE = {"o70_template", "o70b_template_xcom", "o71_runtime_substitution"}


# Sources

@query("o04_snapshot_diff", """
    select case when o.path is null then n.path else o.path end as path, case when n.path is null then 'removed' else 'updated' end as change
    from (select dag_id as path, max_concurrent_runs as mtime from {dags} where description <> 'BUILDING') o
    full outer join (select dag_id as path, max_concurrent_runs + case when cron = '' then 1 else 0 end as mtime from {dags} where description <> 'MACHINERY') n on o.path = n.path
    where o.mtime is distinct from n.mtime""")
def _(c):
    before = c.dags.where("description <> 'BUILDING'").selectExpr("dag_id path", "max_concurrent_runs mtime")
    after = c.dags.where("description <> 'MACHINERY'").selectExpr("dag_id path", "max_concurrent_runs + if(cron = '', 1, 0) mtime")
    return changelog.snapshot_diff(before, after)


@query("o07_dags_with_tasks", "select d.dag_id, d.name, coalesce(list_sort(list(t.task_id) filter (where t.task_id is not null)), []) as tasks from {dags} d left join {dag_tasks} t on d.dag_id = t.dag_id group by d.dag_id, d.name")
def _(c):
    return reads.dags_with_tasks(c.dags, c.dag_tasks).select("dag_id", "name", "tasks")


@query("o08_incomplete_runs", "select run_rowid, dag_run_id from {dag_runs} where state = 0 and dag_run_id <> ''")
def _(c):
    return reads.incomplete_runs(c.dag_runs)


@query("o09_container_log_frames", "select id, cast(0 as int) as place, stream, message as text from {task_logs} union all select id, 1, 'stdout', level from {task_logs}")
def _(c):
    raw = F.concat(container_logs.frame(F.col("stream"), F.col("message")), container_logs.frame(F.lit("stdout"), F.col("level")))
    return container_logs.decoded(c.task_logs.select("id", raw.alias("raw")), "id")


_SENSORS = "select user_id as sensor_id, min(cast(ts as timestamp)) as started_at, 60 as poke_interval_s, 86400 as timeout_s, mod(user_id, 2) = 0 as soft_fail from {events} group by user_id"


@query("o10_sensor_first_satisfied", f"""
    with s as ({_SENSORS}),
    o as (select user_id as sensor_id, cast(ts as timestamp) as at_ from {{events}} where event_type = 'purchase'),
    p as (select s.sensor_id, s.soft_fail, s.timeout_s, date_diff('second', date_trunc('second', started_at), date_trunc('second', at_)) as late from s left join o on s.sensor_id = o.sensor_id),
    w as (select sensor_id, soft_fail, min(case when late >= 0 and greatest(0, ceil(late / 60.0)) * 60 <= timeout_s then greatest(0, ceil(late / 60.0)) * 60 end) as waited from p group by all)
    select sensor_id, cast(waited as bigint) as waited_s, cast(case when waited is not null then 0 when soft_fail then 100 else 1 end as int) as exit_code from w""")
def _(c):
    seen = c.events.selectExpr("user_id sensor_id", "cast(ts as timestamp) at", "event_type = 'purchase' ok")
    return sensors.first_satisfied(c.sql(_SENSORS), seen)


# Changelogs

@query("o11_upsert_run", """
    select run_rowid, case when trigger_type = 1 and state <> 0 then concat(dag_run_id, 'y') else dag_run_id end as dag_run_id, case when trigger_type = 1 and state <> 0 then 2 else state end as state from {dag_runs}
    union all select run_rowid + 10000000, concat(dag_run_id, 'x'), 1 from {dag_runs} where trigger_type = 1 and state <> 0""")
def _(c):
    table = c.dag_runs.select("run_rowid", "dag_run_id", "state")
    some = c.dag_runs.where("trigger_type = 1 and state <> 0")
    new = some.selectExpr("run_rowid + 10000000 as run_rowid", "concat(dag_run_id, 'x') as dag_run_id", "1 as state")
    known = some.selectExpr("run_rowid", "concat(dag_run_id, 'y') as dag_run_id", "2 as state")
    return changelog.merge(table, new.unionByName(known), ["run_rowid"])


@query("o12_update_run_state", "select run_rowid, cast(case when trigger_type = 0 and state = 0 then 2 else state end as int) as state from {dag_runs}")
def _(c):
    changes = c.dag_runs.where("trigger_type = 0 and state = 0").selectExpr("run_rowid", "2 as state")
    return changelog.update(c.dag_runs.select("run_rowid", "state"), changes, ["run_rowid"])[0]


@query("o12b_update_unmatched", "select run_rowid + 10000000 as run_rowid from {dag_runs} where state = 2")
def _(c):
    changes = c.dag_runs.where("state = 2").selectExpr("run_rowid + 10000000 as run_rowid", "1 as state")
    return changelog.update(c.dag_runs.select("run_rowid", "state"), changes, ["run_rowid"])[1].select("run_rowid")


@query("o13_insert_instance_duplicates", "select l_orderkey as run_rowid, l_linenumber as task_idx, count(*) as copies from {lineitem} group by all having count(*) > 1")
def _(c):
    return changelog.duplicate_keys(c.lineitem.selectExpr("l_orderkey as run_rowid", "l_linenumber as task_idx"), ["run_rowid", "task_idx"])


@query("o14_update_instance", "select run_rowid, task_idx, cast(case when state = 6 and attempt = 3 then 2 else state end as int) as state, attempt from {task_instances}")
def _(c):
    changes = c.task_instances.where("state = 6 and attempt = 3").selectExpr("run_rowid", "task_idx", "2 as state")
    return changelog.update(c.task_instances.select("run_rowid", "task_idx", "state", "attempt"), changes, ["run_rowid", "task_idx"])[0]


@query("o15_save_task", """
    select run_rowid, task_idx, cast(case when task_idx = 0 then 1 else state end as int) as state from {task_instances}
    union all select run_rowid, task_idx + 1000, 0 from {task_instances} where task_idx = 0""")
def _(c):
    table = c.task_instances.select("run_rowid", "task_idx", "state")
    first = table.where("task_idx = 0")
    changes = first.selectExpr("run_rowid", "task_idx", "1 as state").unionByName(first.selectExpr("run_rowid", "task_idx + 1000 as task_idx", "0 as state"))
    return changelog.merge(table, changes, ["run_rowid", "task_idx"])


@query("o16_insert_batch", "select run_rowid, dag_run_id from {dag_runs} where state = 1")
def _(c):
    table = c.dag_runs.where("state = 1 and trigger_type = 0").select("run_rowid", "dag_run_id")
    return changelog.insert(table, c.dag_runs.where("state = 1").select("run_rowid", "dag_run_id"), ["run_rowid"])[0]


@query("o16b_insert_all_or_nothing", "select 'refused' as batch, run_rowid from {dag_runs} where state = 1 and trigger_type = 0 union all select 'taken', run_rowid from {dag_runs} where state = 1")
def _(c):
    runs = c.dag_runs.where("state = 1").select("run_rowid", "trigger_type")
    table = runs.where("trigger_type = 0").drop("trigger_type")
    refused = changelog.insert_all(table, runs.drop("trigger_type"), ["run_rowid"])[0]
    taken = changelog.insert_all(table, runs.where("trigger_type = 1").drop("trigger_type"), ["run_rowid"])[0]
    return refused.withColumn("batch", F.lit("refused")).unionByName(taken.withColumn("batch", F.lit("taken")))


@query("o17_upsert_dag", "select dag_id, case when cron = '' then 'renamed' else name end as name, case when cron = '' then 1 else 1 end as created_at from {dags}")
def _(c):
    table = c.dags.selectExpr("dag_id", "name", "1 as created_at")
    changes = c.dags.where("cron = ''").selectExpr("dag_id", "'renamed' as name", "2 as created_at")
    return changelog.merge(table, changes, ["dag_id"], keep=("created_at",))


@query("o18_dependency_json", """
    select run_rowid, dst as task_idx, '[' || string_agg(case when dst - src = 1 then '"task_' || src || '"' else '{{"task":"task_' || src || '","label":"far"}}' end, ',' order by 'task_' || src) || ']' as deps
    from {edges} group by run_rowid, dst""".replace("{{", "<<").replace("}}", ">>"))
def _(c):
    label = F.when(F.col("dst") - F.col("src") == 1, "").otherwise("far")
    deps = F.array_sort(F.collect_list(F.struct(F.concat(F.lit("task_"), F.col("src").cast("string")).alias("task"), label.alias("label"))))
    return c.edges.groupBy("run_rowid", F.col("dst").alias("task_idx")).agg(deps.alias("d")).select("run_rowid", "task_idx", values.dependency_json("d").alias("deps"))


@query("o19_delete_dag", "select t.dag_id, t.task_id from {dag_tasks} t join {dags} d on t.dag_id = d.dag_id where d.cron <> ''")
def _(c):
    return changelog.delete_dag(c.dags, c.dag_tasks, c.dags.where("cron = ''").select("dag_id"))[1].select("dag_id", "task_id")


@query("o20_append_log", "select id, stream, level from {task_logs} union all select id + 100000000, 'stderr', 'ERROR' from {task_logs} where stream = 'stderr'")
def _(c):
    more = c.task_logs.where("stream = 'stderr'").selectExpr("id + 100000000 as id", "stream", "level")
    return c.task_logs.select("id", "stream", "level").unionByName(more)


@query("o21_upsert_xcom", "select dag_run_id, task_id, xkey, max_by(value, version) as value, max(version) as version from {xcom_changelog} group by dag_run_id, task_id, xkey")
def _(c):
    return changelog.current(c.xcom_changelog, ["dag_run_id", "task_id", "xkey"]).select("dag_run_id", "task_id", "xkey", "value", "version")


@query("o22_upsert_watermark", "select dag_id, max_by(execution_date, run_rowid) as last_scheduled_at, max(execution_date) as high_water from {dag_runs} where trigger_type = 1 group by dag_id")
def _(c):
    return c.dag_runs.where("trigger_type = 1").groupBy("dag_id").agg(F.max_by("execution_date", "run_rowid").alias("last_scheduled_at"), F.max("execution_date").alias("high_water"))


@query("o23_delete_run_xcoms", "select version from {xcom_changelog} where dag_run_id not in (select dag_id from {dag_runs} where state = 2)")
def _(c):
    gone = c.dag_runs.where("state = 2").selectExpr("dag_id as dag_run_id")
    return changelog.delete(c.xcom_changelog, gone, ["dag_run_id"]).select("version")


@query("o25_log_messages", """
    select id, '{{"type":"log","dag_run_id":"' || dag_run_id || '","task_id":"' || task_id || '","timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '","level":"' || level
           || '","stream":"' || stream || '","message":"' || replace(message, '"', '\\"') || '"}}' as message from {task_logs}""".replace("{{", "<<").replace("}}", ">>"))
def _(c):
    return feeds.messages(c.task_logs)


# Reads

@query("o27_run_state", "select dag_run_id, state from {dag_runs} where dag_run_id = 'dag_1_' || lpad(cast((select min(run_rowid) from {dag_runs} where dag_id = 'dag_1') as varchar), 8, '0')")
def _(c):
    first = c.dag_runs.where("dag_id = 'dag_1'").agg(F.min("dag_run_id").alias("dag_run_id"))
    return c.dag_runs.join(F.broadcast(first), "dag_run_id", "left_semi").select("dag_run_id", "state")


@query("o28_run_dag_id", "select dag_run_id, dag_id from {dag_runs} union all select 'plain' || run_rowid, '' from {dag_runs} where state = 2")
def _(c):
    ids = c.dag_runs.select("dag_run_id").unionByName(c.dag_runs.where("state = 2").selectExpr("concat('plain', run_rowid) as dag_run_id"))
    return ids.select("dag_run_id", reads.dag_id_of("dag_run_id").alias("dag_id"))


@query("o28b_run_rows", "select dag_run_id, regexp_extract(dag_run_id, '^(.*)_[^_]*$', 1) as dag_id, state, trigger_type, execution_date, finished_at from {dag_runs} where state = 2 union all select 'none_' || run_rowid, 'none', null, null, null, null from {dag_runs} where state = 2")
def _(c):
    asked = c.dag_runs.where("state = 2").select("dag_run_id")
    asked = asked.unionByName(c.dag_runs.where("state = 2").selectExpr("concat('none_', run_rowid) as dag_run_id"))
    return reads.run_rows(c.dag_runs, asked).select("dag_run_id", "dag_id", "state", "trigger_type", "execution_date", "finished_at")


@query("o29_run_instances", "select task_idx, state, attempt, exit_code, run_rowid from {task_instances} where run_rowid in (select run_rowid from {dag_runs} where dag_id = 'dag_7')")
def _(c):
    runs = reads.runs_of_dag(c.dag_runs, "dag_7").select("run_rowid")
    return c.task_instances.join(runs, "run_rowid", "left_semi").select("task_idx", "state", "attempt", "exit_code", "run_rowid")


@query("o30_dag_tasks", "select d.dag_id, d.name, t.task_id, t.command from {dags} d left join {dag_tasks} t on d.dag_id = t.dag_id where d.dag_id in ('dag_1', 'dag_2', 'dag_3')")
def _(c):
    return c.dags.where(F.col("dag_id").isin("dag_1", "dag_2", "dag_3")).join(c.dag_tasks, "dag_id", "left").select("dag_id", "name", "task_id", "command")


@query("o31_task_logs", "select id, dag_run_id, task_id, attempt, ts, level, stream, message from {task_logs} where task_id = 'error' and attempt = 2")
def _(c):
    return reads.logs(c.task_logs, task_id="error", attempt=2)



@query("o32_get_xcom", "select version, value from {xcom_changelog} where dag_run_id = 'dag_3' and task_id = 'click' and xkey = 'props'")
def _(c):
    return reads.parseable(c.xcom_changelog.where("dag_run_id = 'dag_3' and task_id = 'click' and xkey = 'props'")).select("version", "value")


@query("o33_task_xcoms", "select version, task_id from {xcom_changelog} where mod(version, 10) <> 0")
def _(c):
    broken = c.xcom_changelog.withColumn("value", F.when(F.col("version") % 10 == 0, F.lit("{bad")).otherwise(F.col("value")))
    return reads.parseable(broken).select("version", "task_id")


@query("o34_run_exists", "select distinct dag_id, cast(date_trunc('month', execution_date) as timestamp) as execution_date from {dag_runs} r where exists (select 1 from {dag_runs} x where x.dag_id = r.dag_id and x.execution_date = date_trunc('month', r.execution_date))")
def _(c):
    ticks = c.dag_runs.select("dag_id", F.date_trunc("month", "execution_date").alias("execution_date")).distinct()
    return reads.run_exists(ticks, c.dag_runs)


@query("o35_watermarks", "select d.dag_id, max(r.execution_date) filter (where r.trigger_type = 1) as last_scheduled_at from {dags} d left join {dag_runs} r on d.dag_id = r.dag_id group by d.dag_id")
def _(c):
    return reads.with_watermark(c.dags, c.dag_runs)


# Joins

@query("o36_instances_with_runs", "select t.run_rowid, task_idx, dag_id, execution_date, t.state from {task_instances} t join {dag_runs} r on t.run_rowid = r.run_rowid")
def _(c):
    return c.task_instances.join(c.dag_runs.select("run_rowid", "dag_id", "execution_date"), "run_rowid").select("run_rowid", "task_idx", "dag_id", "execution_date", "state")


@query("o37_run_tasks", """
    select i.run_rowid, i.task_idx, coalesce(n.task_id, 'task_' || i.task_idx) as task_id, case i.state when 2 then 'success' when 3 then 'failed' else 'skipped' end as state, i.attempt, i.exit_code, i.started_at
    from {task_instances} i left join (select * from {nodes} where task_idx < 3) n on i.run_rowid = n.run_rowid and i.task_idx = n.task_idx""")
def _(c):
    return reads.run_tasks(c.task_instances, c.nodes.where("task_idx < 3"))


@query("o38_xcom_view", "with x as (select dag_run_id, task_id, max_by(value, version) as value from {xcom_changelog} group by all) select dag_run_id, task_id, cast(1 as int) as n_values, value from x")
def _(c):
    view = reads.xcom_view(changelog.current(c.xcom_changelog, ["dag_run_id", "task_id", "xkey"]))
    return view.select("dag_run_id", "task_id", F.size("values").alias("n_values"), F.col("values")["props"].alias("value"))


@query("o39_xcom_pull", """
    with x as (select dag_run_id, task_id, max_by(value, version) as value from {xcom_changelog} group by all)
    select d.dag_id as dag_run_id, 'PROPS' as env_var, x.value, case when x.value is null then 'NotFound' end as error from {dags} d left join x on x.dag_run_id = d.dag_id and x.task_id = 'purchase'""")
def _(c):
    pulls = c.dags.select(F.col("dag_id").alias("dag_run_id"), F.lit("purchase").alias("source_task"), F.lit("props").alias("xkey"), F.lit("PROPS").alias("env_var"))
    return reads.xcom_pull(pulls, changelog.current(c.xcom_changelog, ["dag_run_id", "task_id", "xkey"]), strict=True).select("dag_run_id", "env_var", "value", "error")


@query("o39b_cron_dedup", """
    with t as (select distinct dag_id, unnest(generate_series(execution_date, execution_date + interval '7' day, interval '1' day)) as execution_date from {dag_runs})
    select t.dag_id, t.execution_date from t where not exists (select 1 from {dag_runs} r where r.dag_id = t.dag_id and r.execution_date = t.execution_date)""", also="o39e_cron_dedup_all")
def _(c):
    # Ticks of every DAG: the day of each of its runs and the seven days after it.
    return reads.without_existing_runs(schedule.days_from(c.dag_runs.select("dag_id", "execution_date"), 7), c.dag_runs)


@query("o39c_unknown_dependencies", "select e.run_rowid, e.src + 2 as src, e.dst from {edges} e left join {nodes} n on n.run_rowid = e.run_rowid and n.task_idx = e.src + 2 where n.task_idx is null")
def _(c):
    return reads.unknown_dependencies(c.edges.withColumn("src", F.col("src") + 2), c.nodes).select("run_rowid", "src", "dst")


@query("o39d_task_configs", "select t.dag_id, t.task_id, t.command, d.max_concurrent_runs from {dag_tasks} t join {dags} d on t.dag_id = d.dag_id")
def _(c):
    return c.dag_tasks.join(c.dags, "dag_id").select("dag_id", "task_id", "command", "max_concurrent_runs")


# Aggregates

@query("o47_last_execution", "select dag_id, max(execution_date) as last_execution_date from {dag_runs} group by dag_id")
def _(c):
    return reads.last_execution(c.dag_runs)


_COUNTS = """
    select e.run_rowid, e.dst as task_idx, count(*) filter (where s.state = 2) as n_success, count(*) filter (where s.state = 3) as n_failed, count(*) filter (where s.state in (4, 6)) as n_skipped,
           count(*) filter (where s.state = 4) as n_upstream, count(*) as n_total
    from {edges} e join {task_instances} s on s.run_rowid = e.run_rowid and s.task_idx = e.src group by e.run_rowid, e.dst"""


@query("o48_dependency_counts", _COUNTS)
def _(c):
    c.keep()
    return state.dependency_counts(c.edges, c.task_instances)


_RULE = """case trigger_rule when 'all_success' then s = t when 'all_failed' then f = t when 'all_done' then s + f + k = t when 'one_success' then s >= 1 when 'one_failed' then f >= 1
    when 'none_failed' then f = 0 when 'none_skipped' then k = 0 when 'all_done_min_one_success' then s >= 1 when 'all_skipped' then k = t when 'one_done' then s + f + k >= 1
    when 'none_failed_min_one_success' then f = 0 and s >= 1 else true end"""


@query("o40_trigger_rule_outcomes", f"""
    with c as ({_COUNTS}),
    j as (select n.run_rowid, n.task_idx, n.trigger_rule, coalesce(n_success, 0) as s, coalesce(n_failed, 0) as f, coalesce(n_skipped, 0) as k, coalesce(n_total, 0) as t, coalesce(n_upstream, 0) as u
          from {{nodes}} n left join c on c.run_rowid = n.run_rowid and c.task_idx = n.task_idx)
    select run_rowid, task_idx, trigger_rule, s as n_success, f as n_failed, k as n_skipped, t as n_total,
           case when t = 0 or ({_RULE}) and s + f + k = t then 'ready' when trigger_rule = 'all_success' and f + u > 0 then 'upstream_failed' else 'skipped' end as outcome from j""")
def _(c):
    c.keep()
    return state.trigger_outcomes(c.nodes, c.edges, c.task_instances)


for _rule in enums.TRIGGER_RULES:
    @query(f"o40_rule_{_rule}", f"""
        with c as ({_COUNTS})
        select n.run_rowid, n.task_idx, case when t is null then true else s + f + k = t and ({_RULE.replace("trigger_rule", f"'{_rule}'")}) end as runs
        from {{nodes}} n left join (select run_rowid, task_idx, n_success as s, n_failed as f, n_skipped as k, n_total as t from c) x on x.run_rowid = n.run_rowid and x.task_idx = n.task_idx""")
    def _(c, rule=_rule):
        c.keep()
        counted = state.with_counts(c.nodes.select("run_rowid", "task_idx"), c.edges, c.task_instances)
        return counted.select("run_rowid", "task_idx", state.triggers(F.lit(rule)).alias("runs"))


@query("o42_propagation", f"""
    with recursive w as (select i.run_rowid, i.task_idx, i.state as own, n.trigger_rule from {{task_instances}} i join {{nodes}} n on n.run_rowid = i.run_rowid and n.task_idx = i.task_idx),
    r as (select run_rowid, task_idx, own as state, cast(null as int) as before from w where task_idx = 0
          union all
          select run_rowid, task_idx, case when ok then own when trigger_rule = 'all_success' and f + u > 0 then 4 else 6 end, before
          from (select *, ({_RULE}) as ok
                from (select w.*, r.state as before, case when r.before is null then 1 else 2 end as t,
                             cast(r.state = 2 as int) + coalesce(cast(r.before = 2 as int), 0) as s, cast(r.state = 3 as int) + coalesce(cast(r.before = 3 as int), 0) as f,
                             cast(r.state in (4, 6) as int) + coalesce(cast(r.before in (4, 6) as int), 0) as k, cast(r.state = 4 as int) + coalesce(cast(r.before = 4 as int), 0) as u
                      from r join w on w.run_rowid = r.run_rowid and w.task_idx = r.task_idx + 1) a) b)
    select run_rowid, task_idx, state from r""")
def _(c):
    c.keep()
    return state.propagate(c.nodes, c.edges, c.task_instances)


@query("o43_branching", """
    select distinct e.run_rowid, e.dst as task_idx from {edges} e join {nodes} n on n.run_rowid = e.run_rowid and n.task_idx = e.src and n.is_branch
    join {task_instances} i on i.run_rowid = e.run_rowid and i.task_idx = e.src and i.state = 2 where e.dst <> e.src + 1 and mod(e.run_rowid, 3) <> 0""")
def _(c):
    value = F.when(F.col("run_rowid") % 3 == 0, F.lit("[]")).otherwise(F.concat(F.lit('["task_'), (F.col("task_idx") + 1).cast("string"), F.lit('", 7]')))
    return state.branch_skips(c.edges, c.nodes, c.task_instances.withColumn("value", value))


@query("o44_retry", "select run_rowid, task_idx, case when attempt < 2 then 'pending' else 'failed' end as after from {task_instances} where state = 3")
def _(c):
    return c.task_instances.where("state = 3").select("run_rowid", "task_idx", state.after_failure("attempt", F.lit(2)).alias("after"))


@query("o44b_retry_not_before", "select run_rowid, task_idx, started_at + interval '60' second as not_before from {task_instances} where state = 3")
def _(c):
    return c.task_instances.where("state = 3").select("run_rowid", "task_idx", state.not_before("started_at", 60).alias("not_before"))


@query("o44c_final_attempt", "select l_orderkey as run_rowid, l_linenumber as task_idx, cast(max(1 + mod(l_partkey, 3)) as int) as attempts from {lineitem} where 1 + mod(l_partkey, 3) <= 2 group by all")
def _(c):
    attempts = c.lineitem.selectExpr("l_orderkey as run_rowid", "l_linenumber as task_idx", "cast(1 + mod(l_partkey, 3) as int) as attempt", "l_returnflag as state")
    return state.final_attempt(attempts, 2).select("run_rowid", "task_idx", "attempts")


@query("o45_exit_codes", "select run_rowid, task_idx, case exit_code when 0 then 'success' when 100 then 'skipped' when 101 then 'failed' else 'retry' end as outcome from (select run_rowid, task_idx, case when attempt = 3 and exit_code = 1 then 101 else exit_code end as exit_code from {task_instances})")
def _(c):
    code = F.when((F.col("attempt") == 3) & (F.col("exit_code") == 1), 101).otherwise(F.col("exit_code"))
    return c.task_instances.withColumn("exit_code", code).select("run_rowid", "task_idx", state.exit_outcome().alias("outcome"))


@query("o46_previous_state", """
    with j as (select i.run_rowid, i.task_idx, i.state, r.dag_id, r.dag_run_id, r.execution_date from {task_instances} i join {dag_runs} r on r.run_rowid = i.run_rowid)
    select a.run_rowid, a.task_idx, a.dag_id, a.dag_run_id, a.state, arg_max(b.state, struct_pack(e := b.execution_date, i := b.dag_run_id)) as previous_state
    from j a left join j b on a.dag_id = b.dag_id and a.task_idx = b.task_idx and b.execution_date <= a.execution_date and b.dag_run_id <> a.dag_run_id group by all""")
def _(c):
    return reads.previous_state(c.task_instances, c.dag_runs)


@query("o46b_depends_on_past", """
    with j as (select i.run_rowid, i.task_idx, i.state, r.dag_id, r.dag_run_id, r.execution_date from {task_instances} i join {dag_runs} r on r.run_rowid = i.run_rowid),
    p as (select a.run_rowid, a.task_idx, arg_max(b.state, struct_pack(e := b.execution_date, i := b.dag_run_id)) as s
          from j a left join j b on a.dag_id = b.dag_id and a.task_idx = b.task_idx and b.execution_date <= a.execution_date and b.dag_run_id <> a.dag_run_id group by all)
    select run_rowid, task_idx, case when s is null or s in (2, 6) then 'run' else 'skip' end as gate from p""")
def _(c):
    return reads.past_gate(reads.previous_state(c.task_instances, c.dag_runs)).select("run_rowid", "task_idx", "gate")


@query("o46c_run_numbers", "select dag_id, dag_run_id, cast(row_number() over (partition by dag_id order by scheduled_at, dag_run_id) as int) as run_number from {dag_runs}")
def _(c):
    return reads.run_numbers(c.dag_runs)


@query("o46d_following_run", "select dag_id, execution_date, lead(execution_date) over (partition by dag_id order by execution_date) as next_time from {dag_runs}")
def _(c):
    return schedule.following_ticks(c.dag_runs.select("dag_id", "execution_date"))


@query("o50_task_counts", "select dag_id, count(*) as n_tasks from {dag_tasks} group by dag_id")
def _(c):
    return c.dag_tasks.groupBy("dag_id").agg(F.count("*").alias("n_tasks"))


@query("o51_status", "select (select count(*) from {dags}) as dag_count, coalesce(bool_or(state = 0), false) as active_runs from {dag_runs}")
def _(c):
    return reads.status(c.dags, c.dag_runs)


@query("o52_dashboard", "select (select count(*) from {dags}) as dag_count, (select count(*) from {dag_tasks}) as task_count, (select count(*) from {dag_runs} where state = 0) as active_runs")
def _(c):
    return reads.dashboard(c.dags, c.dag_tasks, c.dag_runs)


_DEFS = "select dag_id, case when description = 'BUILDING' then '' else name end as name from {dags}"
_BAD_TASKS = """select dag_id, case when mod(task_idx, 5) = 4 then 'task_0' else task_id end as task_id, case when mod(task_idx, 4) = 3 then '' else command end as command from {dag_tasks}"""
_BAD_EDGES = """select dag_id, task_id, case when mod(task_idx, 3) = 0 then task_id else 'task_' || (task_idx + 3) end as dep from {dag_tasks}"""
_ERRORS = f"""
    with d as ({_DEFS}), t as ({_BAD_TASKS}), e as ({_BAD_EDGES}), k as (select * from d where name <> '' and dag_id in (select dag_id from t))
    select dag_id, 'empty name' as error, '' as detail from d where name = '' union all
    select dag_id, 'no tasks', '' from d where name <> '' and dag_id not in (select dag_id from t) union all
    select dag_id, 'duplicate id', task_id from t where dag_id in (select dag_id from k) group by dag_id, task_id having count(*) > 1 union all
    select dag_id, 'empty command', task_id from t where dag_id in (select dag_id from k) and command = '' union all
    select dag_id, 'self dependency', task_id from e where dag_id in (select dag_id from k) and task_id = dep union all
    select dag_id, 'unknown dependency', dep from e where dag_id in (select dag_id from k) and not exists (select 1 from t where t.dag_id = e.dag_id and t.task_id = e.dep)"""


def _errors(c):
    return graph.definition_errors(c.sql(_DEFS), c.sql(_BAD_TASKS), c.sql(_BAD_EDGES))


@query("o58_definition_errors", _ERRORS)
def _(c):
    return _errors(c)


@query("o58b_definition_verdicts", f"select d.dag_id, count(x.error) as n_errors, case when count(x.error) = 0 then 'valid' else 'invalid' end as verdict from {{dags}} d left join ({_ERRORS}) x on x.dag_id = d.dag_id group by d.dag_id")
def _(c):
    return graph.definition_verdicts(c.dags, _errors(c))


@query("o53_validation_summary", f"select count(distinct x.dag_id) as invalid, count(distinct d.dag_id) - count(distinct x.dag_id) as valid, count(distinct d.dag_id) as total from {{dags}} d left join ({_ERRORS}) x on x.dag_id = d.dag_id")
def _(c):
    marked = c.dags.select("dag_id").join(_errors(c).select("dag_id", F.lit(1).alias("bad")).distinct(), "dag_id", "left")
    return marked.agg(F.count("bad").alias("invalid"), F.count_if(F.col("bad").isNull()).alias("valid"), F.count("*").alias("total"))


_LIVE = "select run_rowid, task_idx, case when mod(run_rowid + task_idx, 7) = 0 then 1 else state end as state from {task_instances} where mod(run_rowid, 11) <> 0"


@query("o54_recovery_summary", f"with i as ({_LIVE}), x as (select r.run_rowid, count(i.run_rowid) as n, count(*) filter (where i.state = 1) as retry from {{dag_runs}} r left join i on i.run_rowid = r.run_rowid where r.state = 0 group by 1) select count(*) filter (where n > 0) as recovered, count(*) filter (where n = 0) as failed, cast(coalesce(sum(retry) filter (where n > 0), 0) as bigint) as tasks_to_retry from x")
def _(c):
    return state.recovery_summary(c.dag_runs, c.sql(_LIVE))


@query("o55_tasks_per_run", "select run_rowid, list_sort(list(task_id)) as tasks from {nodes} group by run_rowid")
def _(c):
    return c.nodes.groupBy("run_rowid").agg(F.sort_array(F.collect_list("task_id")).alias("tasks"))


# Top-k

_HISTORY = "select dag_run_id, dag_id, state, trigger_type, execution_date, scheduled_at, started_at, finished_at from {dag_runs}"


@query("o56_run_history", _HISTORY + " order by scheduled_at desc, dag_run_id limit 50")
def _(c):
    return reads.history(c.dag_runs)


@query("o56b_logs_by_time", "select id, ts, row_number() over (order by ts, id) as place from {task_logs}", also="o56g_all_logs_by_time")
def _(c):
    return reads.numbered(c.task_logs.select("id", "ts"), "ts", "id")


@query("o56c_last_log_lines", "select id, ts, message from {task_logs} order by ts desc, id desc limit 1000")
def _(c):
    return c.task_logs.select("id", "ts", "message").orderBy(F.desc("ts"), F.desc("id")).limit(1000)


@query("o56d_first_dags", "select dag_id, name from {dags} order by dag_id limit 6")
def _(c):
    return c.dags.select("dag_id", "name").orderBy("dag_id").limit(6)


@query("o56e_due_queue", f"select dag_id, max(scheduled_at) as last_scheduled_at from {{dag_runs}} where scheduled_at <= timestamp '1996-01-01 00:00:00' group by dag_id")
def _(c):
    return schedule.due(c.dag_runs.selectExpr("dag_id", "scheduled_at as next_time"), "1996-01-01 00:00:00")


@query("o56f_dispatch", "select run_rowid, task_idx from {nodes} where task_idx = 0 order by run_rowid, task_idx limit greatest(0, 5000 - (select count(*) from {task_instances} where attempt = 3 and state = 3 and task_idx = 0))")
def _(c):
    running = c.task_instances.where("attempt = 3 and state = 3 and task_idx = 0")
    return reads.dispatch(graph.roots(c.nodes, c.edges), running, 5000)


@query("o115_dispatch_per_run", "with b as (select run_rowid, count(*) as n from {task_instances} where state = 3 group by run_rowid), p as (select run_rowid, task_idx, row_number() over (partition by run_rowid order by task_idx) as place from {nodes}) select p.run_rowid, p.task_idx from p left join b on b.run_rowid = p.run_rowid where place <= 4 - coalesce(b.n, 0)")
def _(c):
    return reads.dispatch(c.nodes, c.task_instances.where("state = 3"), 4, per_dag=True)


# Run states

#: The changed states of _LIVE, of all runs.
_STATES = "select run_rowid, task_idx, case when mod(run_rowid + task_idx, 7) = 0 then 1 else state end as state from {task_instances}"


@query("o57_run_states", f"with i as ({_STATES}) select run_rowid, count(*) as n, count(*) filter (where state = 3) as failed, case when count(*) filter (where state in (0, 1, 5)) > 0 then 'running' when count(*) filter (where state = 3) > 0 then 'failed' else 'success' end as run_state from i group by run_rowid", also="o57e_run_states_all")
def _(c):
    return state.run_states(c.sql(_STATES))


@query("o57b_runnable_dags", "select dag_id from {dags} where dag_id in (select dag_id from {dag_tasks})")
def _(c):
    return state.runnable_dags(c.dags, c.dag_tasks)


@query("o57c_recover", f"with i as ({_STATES}) select i.run_rowid, task_idx, cast(case when i.state = 1 then 0 else i.state end as int) as state, case when i.state = 1 then 'Recovered after crash' end as note from i join {{dag_runs}} r on r.run_rowid = i.run_rowid and r.state = 0", also="o57f_recover_all")
def _(c):
    return state.recover(c.dag_runs, c.sql(_STATES))


@query("o57d_crash", f"with i as ({_STATES}) select i.run_rowid, task_idx, cast(case when i.state = 1 then 3 else i.state end as int) as state, case when i.state = 1 then 'Scheduler crashed during execution' end as error_message from i join {{dag_runs}} r on r.run_rowid = i.run_rowid and r.state = 0", also="o57g_crash_all")
def _(c):
    return state.crash(c.dag_runs, c.sql(_STATES))


# Graphs

#: A graph with cycles: every part leads to one other.
_LINKS = "select mod(p_size, 5) as k, p_partkey as src, 1 + mod(p_partkey * 7 + 3, (select count(*) from {part})) as dst from {part}"


@query("o59_refused_edges", "select run_rowid, src, dst, case when dst >= n then 'NotFound' else 'InvalidArgument' end as error from (select e.run_rowid, e.src, e.dst + 1 as dst, m.n from {edges} e join (select run_rowid, count(*) as n from {nodes} group by 1) m on m.run_rowid = e.run_rowid where e.dst - e.src = 2 union all select t.run_rowid, task_idx, task_idx, 1000000 from {task_instances} t where task_idx = 0) where dst >= n or src = dst")
def _(c):
    proposed = c.edges.where("dst - src = 2").selectExpr("run_rowid", "src", "dst + 1 as dst").unionByName(c.task_instances.where("task_idx = 0").selectExpr("run_rowid", "task_idx as src", "task_idx as dst"))
    return graph.refused_edges(c.nodes, proposed)


@query("o59b_cycle_refused", """
    select run_rowid, dst as src, src as dst, 'CycleDetected' as error from {edges} where dst - src = 2
    union all select e.run_rowid, e.src, e.dst + 1, 'NotFound' from {edges} e join (select run_rowid, count(*) as n from {nodes} group by 1) m on m.run_rowid = e.run_rowid where e.dst - e.src = 2 and e.dst + 1 >= n""")
def _(c):
    far = c.keep().edges.where("dst - src = 2")
    return graph.refused_edges(c.nodes, far.selectExpr("run_rowid", "dst as src", "src as dst").unionByName(far.selectExpr("run_rowid", "src", "dst + 1 as dst")), existing=c.edges)


@query("o60_cyclic_nodes", f"""
    with recursive l as ({_LINKS.replace("mod(p_size, 5) as k, ", "")}),
    r as (select src, dst from l union select r.src, l.dst from r join l on l.src = r.dst)
    select cast(0 as int) as graph, src as node from r where src = dst""")
def _(c):
    return graph.cyclic_nodes(c.sql(_LINKS).withColumn("graph", F.lit(0)), "graph")


#: Small graphs with nodes that lie between cycles but on none.
_BETWEEN = """select p_partkey as k, 1 as src, 2 as dst from {part} union all select p_partkey, 2, 3 from {part} union all select p_partkey, 0, 1 from {part} where mod(p_partkey, 2) = 0
    union all select p_partkey, 1, 0 from {part} where mod(p_partkey, 2) = 0 union all select p_partkey, 3, 4 from {part} where mod(p_partkey, 3) = 0
    union all select p_partkey, 4, 3 from {part} where mod(p_partkey, 3) = 0 union all select p_partkey, 5, 5 from {part} where mod(p_partkey, 5) = 0"""


@query("o60b_cyclic_nodes_of_many", f"""
    with recursive l as ({_BETWEEN}), r as (select k, src, dst from l union select r.k, r.src, l.dst from r join l on l.k = r.k and l.src = r.dst)
    select k, src as node from r where src = dst""")
def _(c):
    return graph.cyclic_nodes(c.sql(_BETWEEN), "k")


@query("o61_topological_levels", """
    with recursive w as (select run_rowid, src, dst from {edges}),
    r as (select run_rowid, task_idx as node, 0 as layer from {nodes} where task_idx = 0 union select r.run_rowid, w.dst, r.layer + 1 from r join w on w.run_rowid = r.run_rowid and w.src = r.node),
    l as (select run_rowid, node as task_idx, max(layer) as layer from r group by all)
    select run_rowid, task_idx, cast(row_number() over (partition by run_rowid order by layer, task_idx) - 1 as int) as position from l""")
def _(c):
    c.keep()
    return graph.topological_order(c.nodes, c.edges)


@query("o62_layers", """
    with recursive w as (select run_rowid, src, dst from {edges}),
    r as (select run_rowid, task_idx as node, 0 as layer from {nodes} where task_idx = 0 union select r.run_rowid, w.dst, r.layer + 1 from r join w on w.run_rowid = r.run_rowid and w.src = r.node)
    select run_rowid, node as task_idx, cast(max(layer) as int) as layer from r group by all""")
def _(c):
    c.keep()
    return graph.layers(c.nodes, c.edges)


@query("o62b_neighbours", "select run_rowid, node, list_sort(list(d) filter (where d is not null)) as deps_, list_sort(list(x) filter (where x is not null)) as dependents_ from (select run_rowid, dst as node, src as d, null as x from {edges} union all select run_rowid, src, null, dst from {edges}) group by all".replace("as deps_", "as deps").replace("list_sort(list(d) filter (where d is not null))", "coalesce(list_sort(list(d) filter (where d is not null)), [])").replace("list_sort(list(x) filter (where x is not null))", "coalesce(list_sort(list(x) filter (where x is not null)), [])").replace("as dependents_", "as dependents"))
def _(c):
    return graph.neighbours(c.edges)


@query("o62c_roots", "select run_rowid, task_idx from {nodes} where task_idx = 0")
def _(c):
    return graph.roots(c.nodes, c.edges)


@query("o62d_undeletable", "select distinct run_rowid, src as task_idx from {edges}")
def _(c):
    return graph.undeletable(c.nodes, c.edges)


@query("o62e_reachable", """
    with recursive w as (select run_rowid, src, dst from {edges}),
    r as (select run_rowid, src, dst, 1 as d from w union select r.run_rowid, r.src, w.dst, r.d + 1 from r join w on w.run_rowid = r.run_rowid and w.src = r.dst where r.d < 3)
    select distinct run_rowid, src, dst from r""", also="o62f_reachable_all")
def _(c):
    return graph.reachable(c.edges, 3)


# The catalog of definitions: a chain of tasks in each DAG

_CHAIN = "select dag_id, task_id, concat('task_', cast(task_idx - 1 as varchar(10))) as dep from {dag_tasks} where task_idx > 0"
_HAS = "select d.dag_id, max(case when t.task_id = 'task_0' then 1 else 0 end) as has0, max(case when t.task_id = 'task_1' then 1 else 0 end) as has1 from {dags} d left join {dag_tasks} t on t.dag_id = d.dag_id group by d.dag_id"


@query("o62g_catalog_add_tasks", f"""
    with h as ({_HAS})
    select dag_id, 'task_0' as task_id, case when has0 = 1 then 'AlreadyExists' end as error from h union all select dag_id, 'extra', case when has0 = 0 then 'NotFound' end from h
    union all select dag_id, 'loop', 'InvalidArgument' from h union all select concat('no_', dag_id), 'task_0', 'NotFound' from h""")
def _(c):
    ids = c.dags.select("dag_id")
    row = lambda task, dag="dag_id": ids.selectExpr(f"{dag} as dag_id", f"'{task}' as task_id")
    new = row("task_0").unionByName(row("extra")).unionByName(row("loop")).unionByName(row("task_0", "concat('no_', dag_id)"))
    deps = row("extra").withColumn("dep", F.lit("task_0")).unionByName(row("loop").withColumn("dep", F.lit("loop")))
    return catalog.add_tasks(c.dags, c.dag_tasks, c.sql(_CHAIN), new, deps)


@query("o62h_catalog_update_delete", f"""
    with h as ({_HAS})
    select 'update' as op, dag_id, 'task_0' as task_id, case when has0 = 0 then 'NotFound' when has1 = 1 then 'InvalidArgument' end as error from h
    union all select 'delete', dag_id, 'task_0', case when has1 = 1 then 'InvalidArgument' when has0 = 0 then 'NotFound' end from h
    union all select 'delete', concat('no_', dag_id), 'task_0', 'NotFound' from h""")
def _(c):
    first = c.dags.selectExpr("dag_id", "'task_0' as task_id")
    changed = catalog.update_tasks(c.dag_tasks, c.sql(_CHAIN), first, first.withColumn("dep", F.lit("task_1")))
    gone = catalog.delete_tasks(c.dags, c.dag_tasks, c.sql(_CHAIN), first.unionByName(c.dags.selectExpr("concat('no_', dag_id) as dag_id", "'task_0' as task_id")))
    return changed.withColumn("op", F.lit("update")).unionByName(gone.withColumn("op", F.lit("delete")))


@query("o62i_catalog_dags", "select dag_id, 'create' as op, case when cron <> '' then 'AlreadyExists' end as error from {dags} union all select dag_id, 'delete', case when cron = '' then 'NotFound' end from {dags}")
def _(c):
    there = c.dags.where("cron <> ''")
    return catalog.create_dags(there, c.dags).withColumn("op", F.lit("create")).unionByName(catalog.delete_dags(there, c.dags).withColumn("op", F.lit("delete")))


# Schedules: '@daily' fires at 0:00, '0 2 * * *' at 2:00

_TICKS = "select s.dag_id, cast(d.d + case when s.cron = '@daily' then interval '0' hour else interval '2' hour end as timestamp) as execution_date from {schedules} s, (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-31', interval '1' day)) as d) d"


@query("o64_ticks_between", f"select * from ({_TICKS}) where execution_date < timestamp '2024-01-31 00:00:00'")
def _(c):
    return schedule.ticks_between(c.schedules)


@query("o63_next_after", f"select dag_id, cast(date_trunc('day', r) + case when cron = '@daily' then interval '24' hour when hour(r) < 2 then interval '2' hour else interval '26' hour end as timestamp) as next_time from (select s.dag_id, s.cron, max(r.scheduled_at) as r from {{schedules}} s join {{dag_runs}} r on r.dag_id = s.dag_id group by all)")
def _(c):
    last = c.dag_runs.groupBy("dag_id").agg(F.max("scheduled_at").alias("at"))
    return schedule.next_after(c.schedules.join(last, "dag_id"), "at").select("dag_id", "next_time")


_MARKS = "select dag_id, timestamp '2024-01-10 02:00:00' as last_scheduled_at from {dags} where mod(max_concurrent_runs, 4) = 0"
_DONE = "select dag_id, timestamp '2024-01-15 00:00:00' as execution_date from {dags} where description = 'BUILDING'"


@query("o65_catch_up", f"""
    select t.dag_id, t.execution_date from ({_TICKS}) t join {{schedules}} s on s.dag_id = t.dag_id left join ({_MARKS}) m on m.dag_id = t.dag_id left join ({_DONE}) x on x.dag_id = t.dag_id and x.execution_date = t.execution_date
    where s.catchup and t.execution_date > coalesce(m.last_scheduled_at, s.start_date) and t.execution_date <= timestamp '{NOW}' and x.dag_id is null""")
def _(c):
    return schedule.catch_up(c.schedules, c.sql(_MARKS), c.sql(_DONE), NOW)


@query("o66_next_schedule", "select dag_id, timestamp '2024-01-21 00:00:00' + case when cron = '@daily' then interval '0' hour else interval '2' hour end as next_time from {schedules}")
def _(c):
    return schedule.next_schedule(c.schedules, c.sql(_MARKS), NOW)


@query("o67_tick", "select dag_id, max(execution_date) as last_scheduled_at from {dag_runs} where execution_date <= timestamp '1995-06-30 00:00:00' group by dag_id")
def _(c):
    return schedule.due(c.dag_runs.selectExpr("dag_id", "execution_date as next_time"), "1995-06-30 00:00:00")


@query("o69_day_rule", "select distinct cast(execution_date as date) as day, day(execution_date) in (1, 15) or dayofweek(execution_date) = 1 as fits from {dag_runs}")
def _(c):
    days = c.dag_runs.select(F.to_date("execution_date").alias("day"), F.lit("0 0 1,15 * mon").alias("cron")).distinct()
    return days.withColumn("p", cron.parsed("cron")).select("day", cron.day_fits(F.col("p"), F.col("day")).alias("fits"))


# Scalars

@query("o70_template", "select dag_run_id, 'run ' || strftime(execution_date, '%Y-%m-%d') || ' ' || strftime(execution_date, '%Y%m%dT%H%M%S') || ' {{ds}} {{nope}} {{' as text from {dag_runs}".replace("{{", "<<").replace("}}", ">>"))
def _(c):
    template = F.lit(r"run {{ ds }} {{ts_nodash}} \{{ds}} {{nope}} {{")
    return c.dag_runs.select("dag_run_id", text.resolve_template(template, text.date_values("execution_date")).alias("text"))


@query("o70b_template_xcom", "select version, 'k=' || coalesce(json_extract_string(value, '$.k'), '<<xcom.t.props.k>>') as text from {xcom_changelog}")
def _(c):
    xcoms = F.create_map(F.lit("t.props.k"), F.get_json_object("value", "$.k"))
    return c.xcom_changelog.select("version", text.resolve_template(F.lit("k={{xcom.t.props.k}}"), {}, xcoms).alias("text"))


@query("o71_runtime_substitution", "select dag_run_id, 'echo ' || dag_id || ' ' || dag_run_id || ' << dag_id >>' as text from {dag_runs}")
def _(c):
    return c.dag_runs.select("dag_run_id", text.replace_all(F.lit("echo {{dag_id}} {{dag_run_id}} {{ dag_id }}"), {"dag_id": F.col("dag_id"), "dag_run_id": F.col("dag_run_id")}).alias("text"))


@query("o72_date_variables", "select dag_run_id, strftime(execution_date, '%Y-%m-%d') || '/' || strftime(execution_date, '%Y%m%d') as text from {dag_runs}")
def _(c):
    return c.dag_runs.select("dag_run_id", text.replace_all(F.lit("{{ds}}/{{ds_nodash}}"), text.date_values("execution_date")).alias("text"))


@query("o73_shell_prefix", "select dag_id, 'A=''' || replace(name || '''s', '''', '''\\''''') || ''' B=''' || description || ''' ' as prefix from {dags}")
def _(c):
    env = F.create_map(F.lit("B"), F.col("description"), F.lit("A"), F.concat("name", F.lit("'s")))
    return c.dags.select("dag_id", text.shell_prefix(env).alias("prefix"))


@query("o74_preview", "select id, case when length(m) > 80 then substr(m, 1, 80) || '...' else m end as preview from (select id, repeat(message, cast(1 + mod(id, 9) as int)) as m from {task_logs})")
def _(c):
    return c.task_logs.select("id", text.preview(F.expr("repeat(message, cast(1 + mod(id, 9) as int))")).alias("preview"))


@query("o75_split", "select p_partkey, list_filter(list_transform(string_split(p_name, ' '), lambda x: trim(x)), lambda x: x <> '') as words, try_cast(p_size as int) as size from {part}")
def _(c):
    return c.part.select("p_partkey", text.words_of("p_name", " ").alias("words"), F.col("p_size").cast("string").try_cast("int").alias("size"))


@query("o76_log_levels", "select id, case when stream = 'stderr' then 'ERROR' when message like '%[WARN]%' then 'WARN' else 'INFO' end as level from (select id, stream, case when mod(id, 5) = 0 then '[WARN] ' else '' end || message as message from {task_logs})")
def _(c):
    message = F.concat(F.when(F.col("id") % 5 == 0, "[WARN] ").otherwise(""), "message")
    return c.task_logs.select("id", text.log_level("stream", message).alias("level"))


@query("o77_search", "select id from {task_logs} where lower(message) like '%purch%' or lower(level) like '%purch%'")
def _(c):
    return reads.search(c.task_logs, "PURCH", ["message", "level"]).select("id")


@query("o78_ids", "select dag_run_id, dag_id || '_' || lpad(cast(run_rowid as varchar), 8, '0') as made, 'dag' as prefix from {dag_runs}")
def _(c):
    return c.dag_runs.select("dag_run_id", text.run_id("dag_id", F.lpad(F.col("run_rowid").cast("string"), 8, "0")).alias("made"), F.substring_index("dag_run_id", "_", 1).alias("prefix"))


@query("o79_encoding", "select p_partkey, url_encode(p_name || ' *~/é') as encoded, regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_]*$') as env_key, regexp_matches(p_brand, '^[A-Za-z0-9][A-Za-z0-9_.-]*$') as container from {part}")
def _(c):
    encoded = text.percent_encoded(F.concat("p_name", F.lit(" *~/é")))
    return c.part.select("p_partkey", encoded.alias("encoded"), text.valid_env_key("p_brand").alias("env_key"), text.valid_container_id("p_brand").alias("container"))


@query("o80_urls", "select id, 'h' || attempt || '.example' as host, cast(8000 + attempt as int) as port, '/' || task_id as path from {task_logs}")
def _(c):
    url = F.concat(F.lit("http://h"), F.col("attempt").cast("string"), F.lit(".example:"), (8000 + F.col("attempt")).cast("string"), F.lit("/"), F.col("task_id"))
    return c.task_logs.withColumn("u", text.url_parts(url)).select("id", "u.host", "u.port", "u.path")


@query("o81_dates", "select dag_run_id, strftime(scheduled_at, '%Y-%m-%d') as ds, strftime(scheduled_at, '%Y-%m-%dT%H:%M:%S') as ts, coalesce(strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ'), '') as finished from {dag_runs}")
def _(c):
    return c.dag_runs.select("dag_run_id", text.ds("scheduled_at").alias("ds"), text.ts("scheduled_at").alias("ts"), text.iso("finished_at").alias("finished"))


@query("o83_millis", "select run_rowid, epoch_ms(scheduled_at) as ms, case when state = 0 then null else scheduled_at end as back from {dag_runs}")
def _(c):
    ms = F.unix_millis("scheduled_at")
    return c.dag_runs.select("run_rowid", ms.alias("ms"), text.from_millis(F.when(F.col("state") == 0, F.lit(0)).otherwise(ms)).alias("back"))


@query("o84_parse_day", "select dag_run_id, case when state = 2 then null else cast(date_trunc('day', execution_date) as timestamp) end as day from {dag_runs}")
def _(c):
    day = F.when(F.col("state") == 2, F.lit("soon")).otherwise(F.date_format("execution_date", "yyyy-MM-dd"))
    return c.dag_runs.select("dag_run_id", text.day_or_null(day).alias("day"))


@query("o85_durations", "select dag_run_id, case when s is null or s < 0 then '-' when s >= 3600 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' when s >= 60 then (s // 60) || 'm ' || (s % 60) || 's' else s || 's' end as duration from (select dag_run_id, date_diff('second', started_at, finished_at) as s from {dag_runs})")
def _(c):
    seconds = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return c.dag_runs.select("dag_run_id", text.duration_text(seconds).alias("duration"))


@query("o86_days_in_month", "select distinct cast(date_trunc('month', execution_date) as date) as month, cast(day(last_day(execution_date)) as int) as days from {dag_runs}")
def _(c):
    return c.dag_runs.select(F.trunc("execution_date", "month").alias("month"), F.day(F.last_day("execution_date")).alias("days")).distinct()


_RESULTS = """select version as id, cast(mod(version, 3) as int) as exit_code, concat('starting', chr(10), case when mod(version, 4) = 0 then 'no json' else value end, chr(10), 'took ', cast(mod(version, 50) as varchar(10)), 's') as stdout, 'warn: x' as stderr from {xcom_changelog}"""


@query("o87_xcom_extract", f"select id, json_extract_string(string_split(stdout, chr(10))[2], '$.k') as k from ({_RESULTS}) where string_split(stdout, chr(10))[2] <> 'no json' and json_extract(string_split(stdout, chr(10))[2], '$.k') is not null")
def _(c):
    found = values.extracted(c.sql(_RESULTS), "k", "json", path="k")
    return values.all_or_nothing(found, ["id"]).select("id", values.text_form(F.col("value")).alias("k"))


@query("o88_json_in_output", f"select id, case when string_split(stdout, chr(10))[2] = 'no json' then stdout else string_split(stdout, chr(10))[2] end as found from ({_RESULTS})")
def _(c):
    return c.sql(_RESULTS).select("id", values.json_in_output("stdout").alias("found"))


@query("o89_regex_group", f"select id, regexp_extract(stdout, 'took (\\d+)s', 1) as seconds from ({_RESULTS})")
def _(c):
    return c.sql(_RESULTS).select("id", values.regex_group("stdout", r"took (\d+)s", 1).alias("seconds"))


@query("o90_json_path", "select version, json_extract_string(value, '$.k') as k, json_extract(value, '$.none') is not null as other from {xcom_changelog}")
def _(c):
    v = F.try_parse_json("value")
    return c.xcom_changelog.select("version", values.text_form(values.json_path(v, ".k")).alias("k"), values.json_path(v, "none").isNotNull().alias("other"))


@query("o91_text_form", "select l_orderkey, l_linenumber, l_partkey, printf('%.6f', cast(l_quantity + 0.5 as double)) as number from {lineitem}")
def _(c):
    v = F.parse_json(F.concat(F.lit('{"n":'), (F.col("l_quantity") + 0.5).cast("string"), F.lit("}")))
    return c.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", values.text_form(values.json_path(v, "n")).alias("number"))


@query("o92_dependency_list", "select run_rowid, task_idx, 'task_' || greatest(task_idx - 1, 0) as task, case when task_idx > 2 then 'far' else '' end as label from {nodes}")
def _(c):
    name = F.concat(F.lit("task_"), F.greatest(F.col("task_idx") - 1, F.lit(0)).cast("string"))
    deps = F.when(F.col("task_idx") > 2, F.concat(F.lit('[{"task":"'), name, F.lit('","label":"far"}]'))).otherwise(F.concat(F.lit('["'), name, F.lit('"]')))
    return c.nodes.withColumn("deps", deps).withColumn("d", values.dependency_list("deps")).select("run_rowid", "task_idx", F.col("d")[0]["task"].alias("task"), F.col("d")[0]["label"].alias("label"))


@query("o93_typed_values", "select version, try_cast(json_extract_string(value, '$.k') as bigint) as whole, cast(try_cast(json_extract_string(value, '$.k') as bigint) as double) as number from {xcom_changelog}")
def _(c):
    v = F.try_parse_json("value")
    return c.xcom_changelog.select("version", F.try_variant_get(v, "$.k", "bigint").alias("whole"), F.try_variant_get(v, "$.k", "double").alias("number"))


@query("o95_exit_status", "select id, cast(case when mod(id, 3) = 0 then mod(id, 200) when mod(id, 3) = 1 then 137 else -1 end as int) as code from {task_logs}")
def _(c):
    status = F.when(F.col("id") % 3 == 0, (F.col("id") % 200) * 256).when(F.col("id") % 3 == 1, 9).otherwise(127).cast("int")
    return c.task_logs.select("id", text.exit_status(status).cast("int").alias("code"))


@query("o96_backoff", "select id, cast(least(30000, 1000 * pow(2, attempt)) as int) as wait_ms from (select id, mod(id, 8) as attempt from {task_logs})")
def _(c):
    return c.task_logs.select("id", text.backoff_ms(F.col("id") % 8).alias("wait_ms"))


@query("o97_enum_names", "select run_rowid, case state when 1 then 'success' when 2 then 'failed' else 'running' end as state, case trigger_type when 1 then 'schedule' else 'manual' end as trigger, cast(case trigger_type when 1 then 1 else 0 end as int) as code from {dag_runs}")
def _(c):
    name = enums.trigger_type_name("trigger_type")
    return c.dag_runs.select("run_rowid", enums.run_state_name("state").alias("state"), name.alias("trigger"), enums.code_of(name, enums.TRIGGER_TYPES).alias("code"))


@query("o98_default_args", "select run_rowid, task_idx, cast(case when attempt = 3 then 5 else attempt end as int) as max_retries from {task_instances}")
def _(c):
    return c.task_instances.select("run_rowid", "task_idx", text.with_default("attempt", 3, F.lit(5)).cast("int").alias("max_retries"))


# API and command line

@query("a03_dags", "select d.dag_id, d.name, d.description, d.cron, d.max_concurrent_runs, count(t.task_id) as n_tasks from {dags} d left join {dag_tasks} t on t.dag_id = d.dag_id group by all")
def _(c):
    listed = reads.dags_with_tasks(c.dags, c.dag_tasks)
    return listed.select("dag_id", "name", "description", "cron", "max_concurrent_runs", F.size("tasks").cast("bigint").alias("n_tasks"))


@query("a06_task", "select dag_id, task_id, command, case when task_idx = 0 then [] when task_idx = 1 then ['task_0'] else list_sort(['task_' || (task_idx - 2), 'task_' || (task_idx - 1)]) end as dependencies from {dag_tasks}")
def _(c):
    last = c.dag_runs.groupBy("dag_id").agg(F.max("run_rowid").alias("run_rowid"))
    deps = graph.neighbours(c.edges).join(last, "run_rowid").select("dag_id", F.col("node").alias("task_idx"), "deps")
    names = F.sort_array(F.transform(F.coalesce("deps", F.array().cast("array<int>")), lambda d: F.concat(F.lit("task_"), d.cast("string"))))
    return c.dag_tasks.join(deps, ["dag_id", "task_idx"], "left").select("dag_id", "task_id", "command", names.alias("dependencies"))


@query("a10_dag_history", "select dag_run_id, state, started_at, finished_at from {dag_runs} where dag_id = 'dag_10' order by scheduled_at desc, dag_run_id limit 50")
def _(c):
    return reads.history(c.dag_runs, 50, "dag_10").select("dag_run_id", "state", "started_at", "finished_at")


@query("c02_list", "select d.dag_id, substr(d.name, 1, 28) as name, case when cron = '' then '-' else cron end as cron, count(t.task_id) as tasks from {dags} d left join {dag_tasks} t on t.dag_id = d.dag_id group by all")
def _(c):
    return reads.cli_list(c.dags, c.dag_tasks)


@query("c03_status", "select dag_run_id, case state when 1 then 'success' when 2 then 'failed' else 'running' end as state, date_diff('second', started_at, finished_at) as duration_s from (select * from {dag_runs} order by scheduled_at desc, dag_run_id limit 20)")
def _(c):
    return reads.cli_status(c.dag_runs)


@query("o110_high_water_marks", "select dag_id, max(execution_date) as last_scheduled_at from {dag_runs} group by dag_id")
def _(c):
    return feeds.high_water_marks(c.dag_runs)
