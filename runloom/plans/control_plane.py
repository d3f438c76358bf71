"""The control-plane tables, derived from the stored star-schema tables.

One SQL text serves Spark and the oracle; braces mark the tables it reads.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .storage import dealt, parts, stored

BASE = "region nation customer supplier part orders lineitem events".split()

VIEWS = {
    "dags": """
        select concat('dag_', cast(c_custkey as varchar(20))) as dag_id, c_name as name, c_mktsegment as description,
               case when mod(c_custkey, 3) = 0 then '@daily' when mod(c_custkey, 3) = 1 then '0 2 * * *' else '' end as cron,
               cast(1 + mod(c_custkey, 4) as int) as max_concurrent_runs
        from {customer}""",
    "dag_runs": """
        select o_orderkey as run_rowid, concat('dag_', cast(o_custkey as varchar(20))) as dag_id,
               concat('dag_', cast(o_custkey as varchar(20)), '_', lpad(cast(o_orderkey as varchar(20)), 8, '0')) as dag_run_id,
               case o_orderstatus when 'O' then 0 when 'F' then 1 else 2 end as state,
               case when o_orderpriority in ('1-URGENT', '2-HIGH') then 0 else 1 end as trigger_type,
               cast(o_orderdate as timestamp) as execution_date,
               cast(o_orderdate + mod(o_orderkey, 60) * interval '1' minute as timestamp) as scheduled_at,
               cast(o_orderdate + mod(o_orderkey, 60) * interval '1' minute as timestamp) as started_at,
               case when o_orderstatus = 'O' then null
                    else cast(o_orderdate + (3600 + mod(o_orderkey, 7200)) * interval '1' second as timestamp) end as finished_at
        from {orders}""",
    "task_instances": """
        select l_orderkey as run_rowid,
               cast(row_number() over (partition by l_orderkey
                    order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) - 1 as int) as task_idx,
               case l_returnflag when 'A' then 2 when 'N' then 3 else 6 end as state,
               cast(1 + mod(l_partkey, 3) as int) as attempt,
               case l_returnflag when 'A' then 0 when 'N' then 1 else 100 end as exit_code,
               cast(l_shipdate as timestamp) as started_at
        from {lineitem}""",
    "edges": """
        select a.run_rowid, a.task_idx as src, b.task_idx as dst
        from {task_instances} a join {task_instances} b on a.run_rowid = b.run_rowid
        where b.task_idx - a.task_idx in (1, 2)""",
    "nodes": """
        select run_rowid, task_idx, concat('task_', cast(task_idx as varchar(10))) as task_id,
               case mod(run_rowid + task_idx, 12)
                    when 0 then 'all_success' when 1 then 'all_failed' when 2 then 'all_done' when 3 then 'one_success'
                    when 4 then 'one_failed' when 5 then 'none_failed' when 6 then 'none_skipped' when 7 then 'all_done_min_one_success'
                    when 8 then 'all_skipped' when 9 then 'one_done' when 10 then 'none_failed_min_one_success' else 'always' end as trigger_rule,
               mod(run_rowid + task_idx, 5) = 0 as is_branch
        from {task_instances}""",
    "schedules": """
        select dag_id, cron, timestamp '2024-01-01 00:00:00' as start_date, timestamp '2024-01-31 00:00:00' as end_date,
               mod(max_concurrent_runs, 2) = 0 as catchup
        from {dags} where cron <> ''""",
    "task_logs": """
        select event_id as id, concat('dag_', cast(user_id as varchar(20)), '_', lpad(cast(mod(event_id, 97) as varchar(20)), 8, '0')) as dag_run_id,
               event_type as task_id, cast(1 + mod(event_id, 3) as int) as attempt, cast(ts as timestamp) as ts,
               case when event_type = 'error' then 'ERROR' else 'INFO' end as level,
               case when event_type = 'error' then 'stderr' else 'stdout' end as stream,
               concat(event_type, ' ', props) as message
        from {events}""",
    "xcom_changelog": """
        select event_id as version, concat('dag_', cast(user_id as varchar(20))) as dag_run_id, event_type as task_id,
               'props' as xkey, props as value, cast(ts as timestamp) as created_at
        from {events}""",
    "dag_tasks": """
        select concat('dag_', cast(o.o_custkey as varchar(20))) as dag_id, n.task_idx, n.task_id, n.trigger_rule, n.is_branch,
               concat('run ', n.task_id) as command
        from {nodes} n join {orders} o on n.run_rowid = o.o_orderkey
        join (select o_custkey as k, max(o_orderkey) as m from {orders} group by o_custkey) x on x.k = o.o_custkey and x.m = o.o_orderkey""",
}

#: Shorter ways to the same rows, for Spark: the tasks of a run are numbered without gaps, so one window gives its edges.
SPARK_VIEWS = {
    "edges": """
        select run_rowid, src, src + d as dst
        from (select run_rowid, task_idx as src, lead(1, 1) over w as a, lead(2, 2) over w as b from {task_instances} window w as (partition by run_rowid order by task_idx))
        lateral view explode(array_compact(array(a, b))) as d""",
}

_NAME = re.compile(r"\{(\w+)\}")


def needed(sql: str) -> list[str]:
    """The views that a text reads, directly or not, in the order of VIEWS."""
    found, todo = set(), set(_NAME.findall(sql))
    while todo:
        name = todo.pop()
        if name in VIEWS and name not in found:
            found.add(name)
            todo |= set(_NAME.findall(VIEWS[name]))
    return [v for v in VIEWS if v in found]


def oracle(sql: str) -> str:
    """The text for an engine that has the base tables as views: the control-plane views as common table expressions."""
    plain = lambda s: _NAME.sub(r"\1", s)
    views = ", ".join(f"{v} as ({plain(VIEWS[v])})" for v in needed(sql))
    body = plain(sql).strip()
    if not views:
        return body
    if body.lower().startswith("with recursive "):
        return f"with recursive {views}, {body[len('with recursive ') :]}"
    return f"with {views}, {body[5:]}" if body.lower().startswith("with ") else f"with {views} {body}"


class ControlPlane:
    """The views of one data set as DataFrames: ``ControlPlane(spark, folder).dag_runs``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        elif name == "task_instances":
            df = self.sql(VIEWS[name], lineitem=dealt(self.lineitem, parts(self.lineitem), "l_orderkey"))
        elif name in VIEWS:
            df = self.sql(SPARK_VIEWS.get(name, VIEWS[name]))
        else:
            raise AttributeError(name)
        self.__dict__[name] = df
        return df

    def keep(self, name: str = "task_instances") -> ControlPlane:
        """Stores a view that a query reads several times, so that it is derived once."""
        kept = self.__dict__[name] = stored(getattr(self, name))
        if name == "task_instances":
            self.__dict__["edges"] = self.sql(SPARK_VIEWS["edges"], task_instances=dealt(kept.select("run_rowid", "task_idx"), parts(kept), "run_rowid"))
        return self

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """``frames`` stand for tables of their names."""
        return self.spark.sql(text, **{n: frames[n] if n in frames else getattr(self, n) for n in set(_NAME.findall(text))})
