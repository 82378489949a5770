"""A stream of requests with state by lane: paced starts, a cache with a time to live, a breaker.

``requests``: lane, cache_key, request_id, ms (event time) and failed.  A lane's state is a
value (when its last request started, how many failed in a row, until when it is held back)
and a map from keys to when they were fetched, which lives in the state store: a row reads
and writes the one entry of its key.  A timer in event time follows the oldest entry of a
lane; when the watermark has passed what it may still serve, the entry goes, and with the
last one the lane.  So the state is bounded by the lanes and keys of one time to live before
the watermark.  Within a micro-batch the requests of a lane go by (ms, request_id).

The state store must be RocksDB (``STORE``), which maps and timers need.

Defined cases: a hit starts at once and fetches nothing; while a lane is held back, misses
are refused and leave its state alone; a null ``failed`` is a success; a null key is a key;
requests without a time, those of 1970's first moment or before, and those that come later
than ``late`` behind the newest aren't answered; others that come after the state has moved on are answered with the state they
find, except that a fetch never makes an entry older.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.requests import CACHE_HOURS, COOLDOWN_MINUTES, LONG_COOLDOWN_MINUTES, MIN_GAP_MS

OUT = "lane long, request_id long, ms long, start_ms long, hit boolean, refused boolean, failures int"
#: The setting of the state store and its value.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_ROW = Row(*[c.split()[0] for c in OUT.split(", ")])
#: Stands for a null key.
_NULL = "\0"


class Lanes(StatefulProcessor):
    """Answers the requests of a lane (``OUT``)."""

    def __init__(self, gap_ms: int, ttl_ms: int, cooldown_ms: int, long_cooldown_ms: int):
        self.gap_ms, self.ttl_ms, self.cooldown_ms, self.long_cooldown_ms = gap_ms, ttl_ms, cooldown_ms, long_cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lane = handle.getValueState("lane", "started long, failures int, open_until long, timer long")
        self.fetched = handle.getMapState("fetched", "cache_key string", "ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        started, failures, open_until, timer = self.lane.get() or (None, 0, 0, None)
        for ms, request_id, cache_key, failed in sorted((r.ms, r.request_id, _NULL if r.cache_key is None else r.cache_key, bool(r.failed)) for r in rows):
            found = self.fetched.getValue((cache_key,))
            at = found[0] if found else None
            if at is not None and ms - at <= self.ttl_ms:
                yield _ROW(key[0], request_id, ms, ms, True, False, failures)
            elif ms < open_until:
                yield _ROW(key[0], request_id, ms, None, False, True, failures)
            else:
                started = ms if started is None else max(ms, started + self.gap_ms)
                failures = failures + 1 if failed else 0
                if failures:
                    open_until = started + (self.long_cooldown_ms if failures > 1 else self.cooldown_ms)
                else:
                    self.fetched.updateValue((cache_key,), (ms if at is None else max(at, ms),))
                yield _ROW(key[0], request_id, ms, started, False, False, failures)
            if timer is None:  # one timer a lane; when it fires, the next follows the oldest entry that is left
                timer = ms + self.ttl_ms
                self.handle.registerTimer(timer)
        self.lane.update((started, failures, open_until, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        old, kept = [], None
        for (cache_key,), (ms,) in self.fetched.iterator():
            if ms + self.ttl_ms < now:
                old.append(cache_key)
            else:
                kept = ms if kept is None else min(kept, ms)
        for cache_key in old:
            self.fetched.removeKey((cache_key,))
        started, failures, open_until, _ = self.lane.get() or (None, 0, 0, None)
        # What still paces or holds back the lane keeps it, as an entry does.
        last = max(open_until, started + self.gap_ms if started is not None else 0)
        if kept is None and last <= now:
            self.lane.clear()
        else:
            timer = max(now + 1, kept + self.ttl_ms if kept is not None else last)
            self.handle.registerTimer(timer)
            self.lane.update((started, failures, open_until, timer))
        yield from ()

    def close(self) -> None:
        pass


def answered(requests: DataFrame, gap_ms: int = MIN_GAP_MS, ttl_ms: int = CACHE_HOURS * 3600 * 1000, cooldown_ms: int = COOLDOWN_MINUTES * 60_000, long_cooldown_ms: int = LONG_COOLDOWN_MINUTES * 60_000, late: str = "1 hour") -> DataFrame:
    """How each request of the stream is answered (``OUT``)."""
    if requests.sparkSession.conf.get(STORE[0]) != STORE[1]:
        raise ValueError(f"set {STORE[0]} to {STORE[1]}")
    timed = requests.filter("ms IS NOT NULL").select("lane", "cache_key", "request_id", "ms", "failed", F.timestamp_millis("ms").alias("at")).withWatermark("at", late)
    return timed.groupBy("lane").transformWithState(Lanes(gap_ms, ttl_ms, cooldown_ms, long_cooldown_ms), OUT, "Append", "EventTime")
