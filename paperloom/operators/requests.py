"""Request logs: gaps, paced schedules, failure runs, caches with a time to live, stale runs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table

# Pacing, cache and staleness limits.
MIN_GAP_MS = 3200
CACHE_HOURS = 24
STALE_MINUTES = 30
COOLDOWN_MINUTES, LONG_COOLDOWN_MINUTES = 10, 30


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ms"), "value")


def request_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds since the same user's previous request, -1 for none."""
    w = W.partitionBy("user_id").orderBy("ms", "event_id")
    return _log(spark, sf_dir).select("event_id", F.coalesce(F.col("ms") - F.lag("ms").over(w), F.lit(-1)).cast("long").alias("gap_ms"))


def request_schedule(spark: SparkSession, sf_dir: str, gap: int = MIN_GAP_MS) -> DataFrame:
    """When each request of a single lane starts: at its arrival, or ``gap`` after the one before.

    start(i) = max(arrive(i), start(i-1) + gap) is gap * i + the running maximum of
    arrive - gap * i, so no loop is needed.
    """
    w = W.partitionBy("user_id").orderBy("ms", "event_id")
    i = F.row_number().over(w)
    rows = _log(spark, sf_dir).withColumn("i", i)
    start = F.col("i") * gap + F.max(F.col("ms") - F.col("i") * gap).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.select("event_id", start.cast("long").alias("start_ms"), (start - F.col("ms")).cast("long").alias("wait_ms"))


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures (values under 10) up to each request, and the cooldown they open."""
    w = W.partitionBy("user_id").orderBy("ms", "event_id")
    bad = F.coalesce(F.col("value") < 10, F.lit(False))
    rows = _log(spark, sf_dir).withColumns({"bad": bad, "run": F.sum((~bad).cast("long")).over(w)})
    n = F.sum(F.col("bad").cast("long")).over(W.partitionBy("user_id", "run").orderBy("ms", "event_id"))
    counted = rows.withColumn("failures", n)
    minutes = F.when(~F.col("bad"), 0).when(F.col("failures") >= 2, LONG_COOLDOWN_MINUTES).otherwise(COOLDOWN_MINUTES)
    return counted.select("event_id", F.when(F.col("bad"), F.col("failures")).otherwise(0).cast("long").alias("failures"), minutes.cast("long").alias("cooldown_minutes"))


def cached(requests: DataFrame, keys: list[str], ttl_ms: int = CACHE_HOURS * 3600 * 1000) -> DataFrame:
    """``requests`` (keys, ms, event_id) with fetched_ms and hit: found in the cache.

    Only a miss fetches and writes an entry, so each key is a chain of misses: the next is
    the first request over ``ttl_ms`` after the last.  Tasks stream their keys in order and
    hold the last fetch of one key.  A request without a time fetches and leaves nothing.
    """
    names = requests.columns

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fetched = None, None
        for batch in batches:
            out = []
            for *k, ms in zip(*(batch.column(c).to_pylist() for c in [*keys, "ms"]), strict=True):
                if ms is None:
                    out.append((None, False))
                elif k != key or ms - fetched > ttl_ms:
                    key, fetched = k, ms
                    out.append((ms, False))
                else:
                    out.append((fetched, True))
            extra = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*names, "fetched_ms", "hit"])

    ordered = requests.repartition(*keys).sortWithinPartitions(*keys, "ms", "event_id")
    return ordered.mapInArrow(chain, requests.schema.add("fetched_ms", "long").add("hit", "boolean"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each request finds its key (user and type) cached: fetched at most 24 hours before."""
    return cached(_log(spark, sf_dir).drop("value"), ["user_id", "event_type"]).select("event_id", "fetched_ms", "hit")


def run_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by user by the last event: purchases complete them, errors fail them, others run; a
    running one is interrupted if older than 30 minutes before the log's end."""
    last = _log(spark, sf_dir).groupBy("user_id").agg(F.max(F.struct("ms", "event_id", "event_type")).alias("e"), F.count("*").alias("n"))
    end = _log(spark, sf_dir).agg(F.max("ms").alias("now"))
    stale = (F.col("now") - F.col("e.ms")) > STALE_MINUTES * 60 * 1000
    return last.crossJoin(end).select("user_id", F.col("e.event_type").alias("event_type"), F.when(F.col("e.event_type") == "purchase", "completed").when(F.col("e.event_type") == "error", "failed").when(stale, "interrupted").otherwise("running").alias("status"), "n")


def recent_log(spark: SparkSession, sf_dir: str, n: int = 20) -> DataFrame:
    """The last ``n`` entries, newest first: a report of fixed length."""
    return _log(spark, sf_dir).orderBy(F.desc("event_id")).limit(n).select("event_id", "user_id", "event_type")


def user_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 20 entries of every user."""
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))
    return _log(spark, sf_dir).withColumn("r", rank).filter("r <= 20").select("event_id", F.col("r").cast("long").alias("r"))


def cache_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored value of every (user, type): the latest write wins."""
    return _log(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max(F.struct("ms", "event_id", "value")).alias("e")).select("user_id", "event_type", F.col("e.event_id").alias("event_id"), F.round("e.value", 4).alias("value"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant JSON: number of keys, null where the text isn't an object."""
    return table(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


_L = "l AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000 AS ms, value FROM events)"
_W = "(PARTITION BY user_id ORDER BY ms, event_id)"
QUERIES = {f.__name__: f for f in (request_gaps, request_schedule, failure_runs, cache_hits, run_states, recent_log, user_ring, cache_upsert, event_props)}
ORACLES = {
    "request_gaps": f"WITH {_L} SELECT event_id, coalesce(ms - lag(ms) OVER {_W}, -1)::BIGINT AS gap_ms FROM l",
    "request_schedule": f"WITH {_L}, i AS (SELECT *, row_number() OVER {_W} AS i FROM l), s AS (SELECT event_id, ms, i * 3200 + max(ms - i * 3200) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS st FROM i) SELECT event_id, st::BIGINT AS start_ms, (st - ms)::BIGINT AS wait_ms FROM s",
    "failure_runs": f"WITH {_L}, b AS (SELECT *, coalesce(value < 10, false) AS bad FROM l), r AS (SELECT *, sum((NOT bad)::INT) OVER {_W} AS run FROM b), n AS (SELECT *, sum(bad::INT) OVER (PARTITION BY user_id, run ORDER BY ms, event_id) AS f FROM r) SELECT event_id, (CASE WHEN bad THEN f ELSE 0 END)::BIGINT AS failures, (CASE WHEN NOT bad THEN 0 WHEN f >= 2 THEN 30 ELSE 10 END)::BIGINT AS cooldown_minutes FROM n",
    "cache_hits": f"WITH RECURSIVE {_L}, f AS (SELECT user_id, event_type, min(ms) AS ms FROM l GROUP BY ALL UNION ALL SELECT f.user_id, f.event_type, (SELECT min(l.ms) FROM l WHERE l.user_id = f.user_id AND l.event_type = f.event_type AND l.ms > f.ms + 86400000) AS ms FROM f WHERE f.ms IS NOT NULL), g AS (SELECT l.*, (SELECT max(f.ms) FROM f WHERE f.user_id = l.user_id AND f.event_type = l.event_type AND f.ms <= l.ms) AS fetched_ms FROM l) SELECT event_id, fetched_ms::BIGINT AS fetched_ms, event_id <> min(event_id) OVER (PARTITION BY user_id, event_type, fetched_ms, fetched_ms = ms) OR ms <> fetched_ms AS hit FROM g",
    "run_states": f"WITH {_L}, e AS (SELECT user_id, max({{'ms': ms, 'id': event_id, 't': event_type}}) AS e, count(*) AS n FROM l GROUP BY 1) SELECT user_id, e.t AS event_type, CASE WHEN e.t = 'purchase' THEN 'completed' WHEN e.t = 'error' THEN 'failed' WHEN (SELECT max(ms) FROM l) - e.ms > 1800000 THEN 'interrupted' ELSE 'running' END AS status, n FROM e",
    "recent_log": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 20",
    "user_ring": "SELECT event_id, r::BIGINT AS r FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 20",
    "cache_upsert": f"WITH {_L}, e AS (SELECT user_id, event_type, max({{'ms': ms, 'id': event_id, 'v': value}}) AS e FROM l GROUP BY ALL) SELECT user_id, event_type, e.id AS event_id, round(e.v, 4) AS value FROM e",
    "event_props": "SELECT event_id, len(json_keys(props))::BIGINT AS n_keys FROM events",
}
