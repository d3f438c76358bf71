"""Schedules to ticks: ranges, catch-up with de-duplication, next times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cron as C


def with_cron(schedules: DataFrame) -> DataFrame:
    """Adds the parsed expression; each different expression is parsed once and those that are none are dropped."""
    known = schedules.select("cron").distinct().withColumn("parsed", C.parsed("cron")).where("parsed.minute is not null")
    return schedules.join(known, "cron")


def ticks_between(schedules: DataFrame, start: str = "start_date", end: str = "end_date", limit: int | None = 1000) -> DataFrame:
    """(dag_id, execution_date): all ticks from ``start`` (floored to a minute) to before ``end``, at most the first ``limit``.

    The days in range are listed and filtered, then multiplied with the minutes of a day that fire: no minute that
    doesn't fire is looked at. With a limit no more days than it needs are multiplied, in order, within a schedule's row;
    ticks are ranked in a window only for a ``dag_id`` that has several schedules.
    """
    parsed, minutes = F.col("parsed"), C.minutes_of_day(F.col("parsed"))
    slim = schedules.select("dag_id", "cron", F.date_trunc("minute", start).alias("_from"), F.col(end).alias("_to"), F.to_date(start).alias("_first"), F.to_date(end).alias("_last"))
    if limit is None:
        rows = with_cron(slim).select("dag_id", "parsed", "_from", "_to", F.explode(F.sequence("_first", "_last")).alias("day"))
        rows = rows.where(C.day_fits(parsed, F.col("day"))).select("dag_id", "_from", "_to", "day", F.explode(minutes).alias("minute"))
        return rows.withColumn("execution_date", C.tick(F.col("day"), F.col("minute"))).where("execution_date >= _from and execution_date < _to").select("dag_id", "execution_date")
    rows = with_cron(slim.withColumn("_several", F.count("*").over(Window.partitionBy("dag_id")) > 1))
    rows = rows.select("dag_id", "_several", "_from", "_to", minutes.alias("_minutes"), F.filter(F.sequence("_first", "_last"), lambda d: C.day_fits(parsed, d)).alias("_days"))
    # Of the first day some minutes may be before the start; all others count.
    enough = F.slice("_days", F.lit(1), F.floor(F.lit(limit) / F.size("_minutes")).cast("int") + 2)
    ticks = F.flatten(F.transform(enough, lambda d: F.transform("_minutes", lambda m: C.tick(d, m))))
    ticks = F.slice(F.filter(ticks, lambda t: (t >= F.col("_from")) & (t < F.col("_to"))), 1, limit)
    rows = rows.select("dag_id", "_several", F.explode(ticks).alias("execution_date"))
    place = F.row_number().over(Window.partitionBy("dag_id").orderBy("execution_date"))
    ranked = rows.where("_several").withColumn("_n", place).where(F.col("_n") <= limit)
    return rows.where("not _several").select("dag_id", "execution_date").unionByName(ranked.select("dag_id", "execution_date"))


def days_from(ticks: DataFrame, days: int) -> DataFrame:
    """(dag_id, execution_date): each tick and those at its time on the ``days`` days after it, each once."""
    following = F.sequence("execution_date", F.col("execution_date") + F.expr(f"interval {int(days)} days"), F.expr("interval 1 day"))
    return ticks.select("dag_id", F.explode(following).alias("execution_date")).distinct()


def next_after(schedules: DataFrame, at: str, years: int = 5) -> DataFrame:
    """Adds next_time, the first tick after a time column, null if there is none within ``years``.

    Each row is searched by itself, day by day up to the first that fits: no table of days, and no rows dealt by expression.
    """
    today = F.to_date(at)
    found = C.next_ticks("cron", F.unix_date(today), F.hour(at) * 60 + F.minute(at), F.unix_date(F.add_months(today, 12 * years)))
    rows = schedules.where(C.valid("cron")).withColumn("_next", found)
    next_time = C.tick(F.date_from_unix_date("_next.day"), F.col("_next.minute"))
    return rows.withColumn("next_time", next_time).drop("_next")


def catch_up(schedules: DataFrame, watermarks: DataFrame, runs: DataFrame, now) -> DataFrame:
    """Missed ticks of the schedules that catch up: after the watermark (else the start, else now), up to now and the end, without those that have a run."""
    known = schedules.where("catchup").join(watermarks, "dag_id", "left")
    base = F.coalesce("last_scheduled_at", "start_date", F.lit(now).cast("timestamp"))
    last = F.least(F.lit(now).cast("timestamp"), F.coalesce("end_date", F.lit(now).cast("timestamp")))
    bounded = known.select("dag_id", "cron", base.alias("_base"), (last + F.expr("interval 1 second")).alias("_end")).where("_base < _end")
    ticks = ticks_between(bounded, "_base", "_end", None).join(bounded.select("dag_id", "_base"), "dag_id").where("execution_date > _base").drop("_base")
    return ticks.join(runs.select("dag_id", "execution_date"), ["dag_id", "execution_date"], "left_anti")


def next_schedule(schedules: DataFrame, watermarks: DataFrame, now) -> DataFrame:
    """Next time of each schedule after its watermark (else its start) and now; none past its end."""
    known = schedules.join(watermarks, "dag_id", "left")
    base = F.greatest(F.coalesce("last_scheduled_at", "start_date"), F.lit(now).cast("timestamp"))
    found = next_after(known.withColumn("_base", base), "_base")
    return found.where("next_time is not null and (end_date is null or next_time <= end_date)").select("dag_id", "next_time")


def due(queue: DataFrame, now) -> DataFrame:
    """Entries (dag_id, next_time) that are due, and the watermark that each leaves: missed ticks fire once."""
    return queue.where(F.col("next_time") <= F.lit(now).cast("timestamp")).groupBy("dag_id").agg(F.max("next_time").alias("last_scheduled_at"))


def following_ticks(ticks: DataFrame) -> DataFrame:
    """Each tick with the one after it."""
    order = Window.partitionBy("dag_id").orderBy("execution_date")
    return ticks.withColumn("next_time", F.lead("execution_date").over(order))
