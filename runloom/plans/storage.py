"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``; where that is unset, a temporary folder, but only in local mode.

    On a cluster each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """Writes a table and reads it back: cuts the plan of a loop, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of rows, unpacked, that one task sorts or aggregates; partitions to which Spark writes a shuffle without holding
#: a task's rows in memory (``spark.shuffle.sort.bypassMergeThreshold``): beyond these each takes up to 16 times the bytes first.
PART, UNSORTED = 8 << 20, 200


def share(rows: int, df: DataFrame) -> int:
    """Number of partitions in which a task's share of a table of so many rows doesn't grow with it."""
    return _partitions(df, rows * df._jdf.schema().defaultSize())


def _partitions(df: DataFrame, size: int) -> int:
    n = min(-(-size // PART), max(UNSORTED, -(-size // (16 * PART))), 20_000)
    return max(df.sparkSession.sparkContext.defaultParallelism, n)


def parts(df: DataFrame) -> int | None:
    """``share`` of a table: of one that is read from files by its rows, which their footers tell, for files pack more
    rows into a byte the larger they are; of another by its size; None where Spark doesn't know that."""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.getClass().getSimpleName() == "LogicalRelation":
        return share(df.count(), df)
    size = int(str(plan.stats().sizeInBytes()))
    return None if size > 1 << 50 else _partitions(df, size)


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """Rows dealt by keys to ``n`` partitions, which a join, window or aggregation by these keys takes as they are."""
    return df if n is None else df.repartition(n, *keys)
