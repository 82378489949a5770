"""Helpers shared by the training-data operators: tables, scratch space, joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A run of anything but ASCII white space, as a Java, RE2 and Python pattern.
WORD = r"[^\x20\x09-\x0D]+"

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset and all runs
    in one process (a test), a temporary folder stands in; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return _OWN[app]


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/paperloom/{what}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Deletes what ``stored`` wrote in this block when it ends, but for ``lasting`` tables.

    Those belong to the block around it, or stay for the caller where there is none.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            remove(spark, path)


def stored(df: DataFrame, what: str, lasting: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage with files every executor sees, so a lost executor costs
    only the tasks it ran.  The files' sizes are the statistics by which Spark
    then decides whether a side of a join is small enough to broadcast.
    """
    spark = df.sparkSession
    path = fresh_path(spark, what)
    blocks = _SCRATCH[:-1] if lasting else _SCRATCH
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path in whichever file system it is in."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stored(*frames: DataFrame) -> None:
    """Deletes the files behind frames from ``stored`` that nothing reads any more."""
    for df in frames:
        for parent in {os.path.dirname(f) for f in df.inputFiles()}:
            if "/paperloom/" in parent:
                remove(df.sparkSession, parent)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def running(df: DataFrame, order: list, sums: dict) -> DataFrame:
    """``df`` with running sums in a total order: for each name and column of ``sums`` the sum
    over the rows up to this one.

    Sorted by ranges: each task sums its own rows, and the totals of the tasks before it (a
    row for each task) are added, so no task sees all rows.
    """
    n = max(2, shuffle_partitions(df.sparkSession))
    placed = stored(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "running")
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    based = totals.select("_part", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = placed.join(F.broadcast(based), "_part")  # as many rows as there are tasks
    return joined.withColumns({k: F.col(f"_b_{k}") + F.sum(c).over(inside) for k, c in sums.items()}).drop("_part", *[f"_b_{k}" for k in sums])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
