"""Checks made before any action, and tables cut off from their lineage."""

from __future__ import annotations

import contextlib
import datetime
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "input") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def as_date(value: str | datetime.date) -> Column:
    """An explicit as-of date; nothing here reads the clock."""
    return F.lit(str(value)).cast("date")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, deleted when the driver ends. Where the setting is absent a local master gets a local folder; a cluster's executors could not read that, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinweave-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while, then as they were."""
    held = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows that one task of dealt() groups and sorts, on average.
DEALT_ROWS = 1 << 17


def dealt(spark: SparkSession, rows: int):
    """Shuffles of what runs inside go to as many tasks as so many rows need, or the session's number if that is more, and are not put together again: a task's memory doesn't grow with the input."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // DEALT_ROWS))
    return settings(spark, {"spark.sql.shuffle.partitions": str(tasks), "spark.sql.adaptive.coalescePartitions.enabled": "false"})


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df written below spark.checkpoint.dir and read again: iterations start from a short plan. Its shuffle files go when it is written."""
    spark = df.sparkSession
    path = scratch(spark, "step")
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinweave_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by cut() that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._kinweave_path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
