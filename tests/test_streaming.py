"""The streaming twin against a plain run over the same requests, and what stays in its state."""

import random

import pytest

from paperloom.streaming.requests import STORE, answered

#: Times are after 1970: the watermark begins there.
BASE = 10_000_000
SCHEMA = "lane long, cache_key string, request_id long, ms long, failed boolean"
ROWS = [
    [(1, "a", 1, 0, False), (1, "b", 2, 1000, False), (2, "a", 3, 10, True), (1, "a", 4, 5000, None)],
    [(1, "c", 5, 5100, False), (2, "b", 6, 20_000, False), (2, "b", 7, 700_000, False), (1, "a", 8, 90_000_000, False)],
]
WANT = {
    1: (0, False, False, 0), 2: (3200, False, False, 0), 4: (5000, True, False, 0), 5: (6400, False, False, 0), 8: (90_000_000, False, False, 0),
    3: (10, False, False, 1), 6: (None, False, True, 1), 7: (700_000, False, False, 0),
}


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE[0])
    spark.conf.set(*STORE)
    yield spark
    spark.conf.set(STORE[0], before)


def run(spark, folder, batches, name, **options):
    """Answers by request, and the rows of the state after each batch."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    query = answered(stream, **options).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {r.request_id: (r.start_ms, r.hit, r.refused, r.failures) for r in spark.table(name).collect()}
    return got, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_answers_over_two_batches(store, tmp_path):
    later = [[(*r[:3], BASE + r[3], r[4]) for r in rows] for rows in ROWS]
    want = {k: (None if at is None else BASE + at, *rest) for k, (at, *rest) in WANT.items()}
    assert run(store, tmp_path, later, "answers")[0] == want


def test_the_state_store_is_checked(spark):
    with pytest.raises(ValueError, match="stateStore"):
        answered(spark.createDataFrame([], SCHEMA))


def plain(batches, gap, ttl, cooldown, long_cooldown):
    lanes, out = {}, {}
    for rows in batches:
        for lane, key, request, ms, failed in sorted(rows, key=lambda r: (r[3], r[2])):
            s = lanes.setdefault(lane, {"started": None, "failures": 0, "open": 0, "fetched": {}})
            at = s["fetched"].get(key)
            if at is not None and ms - at <= ttl:
                out[request] = (ms, True, False, s["failures"])
            elif ms < s["open"]:
                out[request] = (None, False, True, s["failures"])
            else:
                s["started"] = ms if s["started"] is None else max(ms, s["started"] + gap)
                s["failures"] = s["failures"] + 1 if failed else 0
                if s["failures"]:
                    s["open"] = s["started"] + (long_cooldown if s["failures"] > 1 else cooldown)
                else:
                    s["fetched"][key] = max(ms, at or 0)
                out[request] = (s["started"], False, False, s["failures"])
    return out


def test_state_is_bounded_and_answers_are_those_of_a_plain_run(store, tmp_path):
    """New lanes and keys come all the time; what no request can use any more goes."""
    rng = random.Random(8)
    batches, request = [], 0
    for b in range(6):
        rows = []
        for _ in range(300):
            request += 1
            rows.append((b * 40 + rng.randrange(40), rng.choice(["a", "b", "c", None, f"k{b}"]), request, BASE + b * 1_000_000 + rng.randrange(900_000), rng.random() < 0.1))
        batches.append(rows)
    times = {"gap_ms": 2_000, "ttl_ms": 200_000, "cooldown_ms": 20_000, "long_cooldown_ms": 60_000}
    got, state = run(store, tmp_path, batches, "many", late="1 second", **times)
    assert got == plain(batches, *times.values())
    assert max(state) < 1.6 * state[0] and state[-1] < state[0], state
