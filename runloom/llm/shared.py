"""What several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is made and the setting is made for the session, but only in local mode: on a
    cluster each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Spark's setting to remove a query's shuffle files at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, *by: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: the plan is cut, and lost executors lose nothing.

    The shuffle files that led to the table are given up once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _tables.paths[id(table)] = (table, path)
    return table


class _Tables(threading.local):
    """Where the tables that this thread has stored are, until they are removed."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[DataFrame, str]] = {}


_tables = _Tables()


def tidied(make: Callable[[], DataFrame]) -> DataFrame:
    """Stores the table that ``make`` returns and removes those that ``make`` stored on the way."""
    before = set(_tables.paths)
    table = stored(make())
    removed(*[t for k, (t, _) in _tables.paths.items() if k not in before and t is not table])
    return table


def removed(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more: what was made of them has been stored itself."""
    for table in tables:
        _, path = _tables.paths.pop(id(table))
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


class Sent:
    """A value broadcast as bytes that carry their classes along, so executors need no copy of this package."""

    def __init__(self, spark: SparkSession, value) -> None:
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.kept = None

    def once(self):
        """The value; nothing is kept."""
        return cloudpickle.loads(self.sent.value)

    @property
    def value(self):
        """The value, kept for the rest of the task."""
        if self.kept is None:
            self.kept = self.once()
        return self.kept


def spread(df: DataFrame, per_partition: int = 2) -> int:
    """Buckets for work that is dealt out by hash: some for each input partition, so that their size stays the same."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, per_partition * df.rdd.getNumPartitions())


def remainder_of_id(column: str, divisor: int) -> Column:
    """crc32 of an id's text modulo ``divisor``; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(divisor)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
