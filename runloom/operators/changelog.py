"""Mutable tables as append-only changelogs: upserts, checked updates and inserts, deletes.

A table is a log of row versions. The current row of a key is the one with the largest version, found by one aggregation
with ``max_by`` (combined before the shuffle, so a key with very many versions is no bottleneck).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Latest version of each key; columns stay. Versions are unique in a key."""
    rest = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return latest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in log.columns])


def one_each(changes: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """One change for each key: the one with the largest ``version``, or without it the largest row by its columns in order."""
    columns = [c for c in changes.columns if c not in keys]
    row = F.struct(*columns) if columns else F.struct(F.lit(1))
    chosen = F.max(row) if version is None else F.max(F.struct(F.col(version).alias("_v"), row.alias("_r")))["_r"]
    return changes.groupBy(*keys).agg(chosen.alias("_new"))


def merge(table: DataFrame, changes: DataFrame, keys: list[str], keep: tuple[str, ...] = (), version: str | None = None) -> DataFrame:
    """Rows of ``changes`` replace those of equal keys, others are added; columns in ``keep`` stay as they were.

    Of several changes of one key ``one_each`` applies one, so that a key has one row afterwards.
    """
    rest = [c for c in table.columns if c not in keys]
    new = one_each(changes.select(*keys, *rest, *[c for c in (version,) if c and c not in table.columns]), keys, version)
    old = table.select(*keys, F.struct(*rest).alias("_old"))
    both = old.join(new, keys, "full_outer")
    value = lambda c: F.coalesce(f"_old.{c}", f"_new.{c}") if c in keep else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(*[F.col(c) if c in keys else value(c).alias(c) for c in table.columns])


def update(table: DataFrame, changes: DataFrame, keys: list[str], version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table with the changes applied, changes whose key is not there: an error for the caller).

    Of several changes of one key ``one_each`` applies one.
    """
    columns = [c for c in changes.columns if c not in keys and c in table.columns]
    joined = table.join(one_each(changes, keys, version), keys, "left")
    applied = joined.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns])
    return applied, changes.join(table.select(*keys), keys, "left_anti")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that an insert would have twice, with their count."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def insert(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the new rows, rows refused because their key exists)."""
    taken = table.select(*keys)
    return table.unionByName(rows.join(taken, keys, "left_anti")), rows.join(taken, keys, "left_semi")


def insert_all(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with all of the new rows or, if any is refused, with none; keys refused: they exist, or come twice).

    Whether the batch is whole is one number, joined to every new row.
    """
    refused = rows.join(table.select(*keys), keys, "left_semi").select(*keys).unionByName(duplicate_keys(rows, keys).select(*keys)).distinct()
    whole = refused.agg((F.count("*") == 0).alias("_whole"))
    return table.unionByName(rows.crossJoin(F.broadcast(whole)).where("_whole").select(*rows.columns)), refused


def delete(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def cleared(table: DataFrame) -> DataFrame:
    """The table without rows."""
    return table.limit(0)


def delete_dag(dags: DataFrame, tasks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions and their tasks without the given dag_ids; runs stay."""
    return delete(dags, gone, ["dag_id"]), delete(tasks, gone, ["dag_id"])


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) between two (path, mtime) snapshots: updated if new or of another mtime, removed if gone."""
    both = before.select("path", F.col("mtime").alias("_old")).join(after.select("path", F.col("mtime").alias("_new")), "path", "full_outer")
    change = F.when(F.col("_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return both.select("path", change.alias("change")).where("change is not null")
