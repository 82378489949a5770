"""Logs and caches written by streams: replayed batches change nothing."""

from paperloom.streaming import logs

SCHEMA = "key string, value string, pos long"


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first = spark.createDataFrame([("a", "1", 1), ("b", "1", 2), (None, "0", 3), ("c", "1", 4)], SCHEMA)
    second = spark.createDataFrame([("a", "2", 1), ("c", None, 2), ("a", "3", 5)], SCHEMA)
    for rows, batch in ((first, 0), (second, 1), (first.repartition(3), 0), (second, 1)):
        logs.write_batch(rows, batch, path)
    ids = [(r.id, r.key, r.value) for r in logs.entries(spark, path, ["pos"]).orderBy("id").collect()]
    assert ids == [(1, "a", "1"), (2, "b", "1"), (3, None, "0"), (4, "c", "1"), (logs.BATCH_ROWS + 1, "a", "2"), (logs.BATCH_ROWS + 2, "c", None), (logs.BATCH_ROWS + 3, "a", "3")]
    want = {(None, "0"), ("a", "3"), ("b", "1")}
    assert {tuple(r) for r in logs.latest(spark, path).collect()} == want
    logs.compacted(spark, path, f"file://{tmp_path}/small")
    assert {tuple(r) for r in logs.latest(spark, f"file://{tmp_path}/small").collect()} == want
    logs.write_batch(spark.createDataFrame([("b", "9", 0)], SCHEMA), 2, f"file://{tmp_path}/small")
    assert {tuple(r) for r in logs.latest(spark, f"file://{tmp_path}/small").collect()} == {(None, "0"), ("a", "3"), ("b", "9")}
    logs.write_batch(first.limit(0), 7, path)
    assert spark.read.parquet(path).count() == 7


def test_a_stream_that_loses_its_checkpoint_writes_the_same(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"k{i}", str(i), i), ("all", str(i), 10 + i)], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    for run in range(2):  # the second run starts from the beginning, with the same batches
        logs.append(stream(), out, f"file://{tmp_path}/checkpoint-{run}").awaitTermination(120)
    assert spark.read.parquet(out).count() == 6
    assert {r.key for r in logs.latest(spark, out).collect()} == {"k0", "k1", "k2", "all"}


def test_many_batches_are_written_by_one_job(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.range(400).selectExpr("concat('k', id % 7) AS key", "cast(id AS string) AS value", "id AS pos", "id div 10 AS n")
    logs.write_batches(rows.repartition(5), "n", path)
    files = [f for f in (tmp_path / "log").rglob("*.parquet")]
    assert len(files) == 40 == len({f.parent for f in files})  # a batch is one file, whatever the tasks were
    before = {tuple(r) for r in logs.entries(spark, path, ["pos"]).collect()}
    assert len(before) == 400
    logs.write_batch(rows.filter("n = 3").drop("n").repartition(3), 3, path)
    logs.write_batches(rows.filter("n IN (0, 39)"), "n", path)
    assert {tuple(r) for r in logs.entries(spark, path, ["pos"]).collect()} == before
    logs.compacted(spark, path, f"file://{tmp_path}/small")
    last = {(f"k{k}", str(max(i for i in range(400) if i % 7 == k))) for k in range(7)}
    assert {tuple(r) for r in logs.latest(spark, f"file://{tmp_path}/small").collect()} == last
    assert len(list((tmp_path / "small").rglob("*.parquet"))) == 1
