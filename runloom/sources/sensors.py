"""Sensors over observations: when a condition first held, within a timeout of polls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_satisfied(sensors: DataFrame, observations: DataFrame) -> DataFrame:
    """State of each sensor.

    sensors: sensor_id, started_at, poke_interval_s, timeout_s, soft_fail. observations: sensor_id, at, ok. A sensor sees an
    observation at its next poll; if that is within the timeout it succeeds (exit 0), else it is skipped (100) or fails (1).
    """
    ok = observations.where("ok").select("sensor_id", "at")
    joined = sensors.join(ok, "sensor_id", "left")
    late = F.unix_timestamp("at") - F.unix_timestamp("started_at")
    poll = F.greatest(F.lit(0), F.ceil(late / F.col("poke_interval_s"))) * F.col("poke_interval_s")
    first = joined.groupBy("sensor_id", "timeout_s", "soft_fail").agg(F.min(F.when((late >= 0) & (poll <= F.col("timeout_s")), poll)).alias("waited_s"))
    code = F.when(F.col("waited_s").isNotNull(), 0).when(F.col("soft_fail"), 100).otherwise(1)
    return first.select("sensor_id", F.col("waited_s").cast("bigint").alias("waited_s"), code.alias("exit_code"))
