"""Appended logs and keyed caches that a stream writes: a batch that comes again changes nothing.

Every micro-batch has a folder of its own by its number, and writing it replaces just that
folder, so a batch that a restarted stream runs again leaves what it left before.  A log is
the rows of all batches; a cache is the last value of each key by batch and position, a
maximum that combines before its shuffle.  Folding old batches into one (``compacted``)
writes a new folder, so readers of the old one aren't disturbed.

Defined cases: an empty batch writes nothing; of equal keys in a batch the greatest position
counts; a null key is a key; a null value removes the key from the cache.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table

#: Rows of a batch at most; numbers of a log's rows are batch x this + place.
BATCH_ROWS = 1 << 32


def write_batch(rows: DataFrame, batch: int, path: str) -> None:
    """Writes a batch in its own folder of ``path``, in place of what an earlier run of it wrote."""
    marked = rows.withColumn("batch", F.lit(batch).cast("long"))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_batches(rows: DataFrame, number: str, path: str) -> None:
    """Writes all batches of ``rows``, numbered by the column ``number``, in one job, each as ``write_batch`` would.

    A batch is one task's, so it is one file.
    """
    marked = rows.withColumn(number, F.col(number).cast("long")).withColumnRenamed(number, "batch")
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked.repartition(n, "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def append(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """Starts a query that writes the batches of ``stream`` to ``path``."""
    return stream.writeStream.foreachBatch(lambda rows, batch: write_batch(rows, batch, path)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def entries(spark: SparkSession, path: str, order: list[str]) -> DataFrame:
    """The rows of a log with an ascending id: by batch, and in it by ``order``."""
    rows = spark.read.parquet(path)
    place = F.row_number().over(W.partitionBy("batch").orderBy(*order))  # a batch is what one trigger took
    return rows.withColumn("id", F.col("batch") * BATCH_ROWS + place)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a cache whose batches have key, value and pos."""
    rows = spark.read.parquet(path)
    return rows.groupBy("key").agg(F.max_by(F.struct("value"), F.struct("batch", "pos"))["value"].alias("value")).filter("value IS NOT NULL")


def compacted(spark: SparkSession, path: str, to: str) -> None:
    """Writes a cache's last values to the new folder ``to``, as its newest batch."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "pos", "batch"), F.struct("batch", "pos")).alias("x")).select("key", "x.*").filter("value IS NOT NULL")
    last.repartition("batch").write.mode("errorifexists").partitionBy("batch").parquet(to)


def _batches(spark: SparkSession, sf_dir: str, what: str) -> tuple[DataFrame, str]:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").alias("key"), F.when(F.col("event_id") % 9 != 0, F.concat_ws(":", "event_type", "props")).alias("value"), F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 4_000).alias("n")), shared_folder(spark, what)


def _replayed(spark: SparkSession, sf_dir: str, what: str) -> str:
    """Events in batches of 4,000, the second one written twice and the first from another plan."""
    rows, path = _batches(spark, sf_dir, what)
    write_batches(rows, "n", path)
    # The least two numbers: what a restarted stream may run again.
    for n in [r.n for r in rows.select("n").distinct().orderBy("n").limit(2).collect()][::-1]:
        write_batch(rows.filter(F.col("n") == n).drop("n").repartition(3 + n % 2), n, path)
    return path


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events after replays: each once, numbered by batch."""
    rows = entries(spark, _replayed(spark, sf_dir, "log"), ["pos"])
    return rows.select("event_id", "id", "batch")


def event_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of every user after replays, from a compacted cache."""
    path = _replayed(spark, sf_dir, "cache")
    to = shared_folder(spark, "compacted")
    compacted(spark, path, to)
    return latest(spark, to)


QUERIES = {f.__name__: f for f in (event_log, event_cache)}
ORACLES = {
    "event_log": f"SELECT event_id, event_id // 4000 * {BATCH_ROWS} + row_number() OVER (PARTITION BY event_id // 4000 ORDER BY event_id) AS id, event_id // 4000 AS batch FROM events",
    "event_cache": "SELECT key, value FROM (SELECT user_id AS key, CASE WHEN event_id % 9 <> 0 THEN concat_ws(':', event_type, props) END AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE value IS NOT NULL",
}
