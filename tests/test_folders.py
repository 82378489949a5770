"""Named files: written, read with errors, newest by suffix, records, projects."""

import os
import time
from datetime import datetime

from paperloom.sources import folders


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_files_are_written_and_read_with_errors(spark, tmp_path):
    root = f"file://{tmp_path}/in"
    assert folders.files(spark, root).count() == 0
    folders.write_files(spark.createDataFrame([("a/x.md", "one"), ("a/b/y.JSON", "{}"), ("é.txt", None)], "path string, value string"), root)
    (tmp_path / "in/a/bad.md").write_bytes(b"\xff\xfe")
    (tmp_path / "in/a/large.md").write_text("x" * 100)
    (tmp_path / "in/a/.hidden.md").write_text("no")
    found = folders.files(spark, root, largest=50, partitionBytes=4)
    got = {r.path: r for r in found.collect()}
    assert {k: r.value for k, r in got.items()} == {"a/x.md": "one", "a/b/y.JSON": "{}", "é.txt": "", "a/bad.md": None, "a/large.md": None}
    assert got["a/bad.md"].error.startswith("UnicodeDecodeError") and "100 bytes" in got["a/large.md"].error and got["a/x.md"].error is None
    assert found.rdd.getNumPartitions() > 2
    assert rows(folders.files(spark, root, ".json"), "path") == {("a/b/y.JSON",)}
    folders.write_files(spark.createDataFrame([("a/x.md", "two")], "path string, value string"), root)
    assert rows(folders.files(spark, root, "x.md"), "value") == {("two",)}
    assert not [f for _, _, names in os.walk(tmp_path) for f in names if "x.md." in f]


def test_a_file_that_goes_after_the_listing_is_an_error(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for n in "xy":
        (tmp_path / f"a/{n}.md").write_text(n)
    reader = folders.FilesReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    (tmp_path / "a/x.md").unlink()
    got = [r for p in parts for r in reader.read(p)]
    assert [(r[0], r[3]) for r in got] == [("a/x.md", None), ("a/y.md", "y")] and got[0][4].startswith("FileNotFoundError")


def test_times_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("x")
    now = time.time()
    os.utime(tmp_path / "a/x.md", (now, now))
    (r,) = folders.files(spark, f"file://{tmp_path}").selectExpr("unix_millis(modified) AS ms").collect()
    assert abs(r.ms - now * 1000) < 2


FOUND = "path string, modified timestamp, length long, value string, error string"
DAY = [datetime(2024, 1, i) for i in range(1, 9)]


def test_newest_and_expected(spark):
    found = spark.createDataFrame([("p/a-dual.pdf", DAY[0], 1, "", None), ("p/B-DUAL.PDF", DAY[2], 1, "", None), ("p/c-dual.pdf", DAY[2], 1, "", None), ("p/z-mono.pdf", DAY[5], 1, "", None), ("q/a-dual.pdf", None, 1, "", None)], FOUND)
    assert rows(folders.newest(found, "-dual.pdf"), "folder", "path") == {("p", "p/c-dual.pdf"), ("q", "q/a-dual.pdf")}
    expected = spark.createDataFrame([("p", "p/a-dual.pdf"), ("q", "q/none.pdf"), ("r", "r/none.pdf")], "folder string, path string")
    assert rows(folders.resolved(found, expected, "-dual.pdf"), "folder", "path") == {("p", "p/a-dual.pdf"), ("q", "q/a-dual.pdf"), ("r", None)}


def test_job_records_and_reuse(spark):
    good = '{"translatedPdfPath": "%s", "translationSourceHash": "h", "translatedPdfMode": "%s", "translatedProvider": "%s", "translatedModel": 3}'
    texts = {"a": good % ("a/x-dual.pdf", "other", "kimi"), "b": good % ("b/x.pdf", "mono", "me"), "c": good % ("c/gone.pdf", "dual", "kimi"), "d": "{", "e": "[]", "f": '{"translatedPdfPath": "x"}', "g": None, "h": good % ("h/y.pdf", "dual", "openai")}
    found = spark.createDataFrame([(f"{k}/job.json", None, 1, t, "OSError: gone" if t is None else None) for k, t in texts.items()] + [(p, None, 1, "", None) for p in ("a/x-dual.pdf", "b/x.pdf", "h/y.pdf", "h/deep/job.json")], FOUND)
    jobs = folders.job_records(found)
    got = {r.folder: r for r in jobs.collect()}
    assert {k: r.error for k, r in got.items()} == {"a": None, "b": None, "c": None, "d": "not JSON", "e": "not a record", "f": "incomplete record", "g": "OSError: gone", "h": None}
    assert (got["a"].translatedPdfName, got["a"].translatedPdfMode, got["a"].translatedProvider, got["a"].translatedModel) == ("x-dual.pdf", "dual", "kimi", "")
    assert (got["b"].translatedPdfMode, got["b"].translatedProvider) == ("mono", "custom")
    wanted = spark.createDataFrame([(x, "h", m) for x in "abcz" for m in ("dual", "mono")] + [("z", "other", "dual")], "folder string, hash string, mode string")
    used = {(r.folder, r.from_folder, r.path) for r in folders.reusable(jobs, wanted, found).collect()}
    assert used == {("a", "a", "a/x-dual.pdf"), ("a", "b", "b/x.pdf"), ("b", "a", "a/x-dual.pdf"), ("b", "b", "b/x.pdf"), ("c", "a", "a/x-dual.pdf"), ("c", "b", "b/x.pdf"), ("z", "a", "a/x-dual.pdf"), ("z", "b", "b/x.pdf"), ("z", None, None)}
    alone = folders.reusable(jobs, spark.createDataFrame([("h", "h", "dual")], "folder string, hash string, mode string"), found)
    assert rows(alone, "from_folder") == {("h",)}


def test_projects_keep_what_can_be_read(spark):
    found = spark.createDataFrame([("a.pdf", None, 1, "A", None), ("b.json", None, 1, None, "ValueError: bad")], FOUND)
    asked = spark.createDataFrame([(1, "a.pdf", "b.json", "c.json", None, " "), (2, None, None, None, None, None)], "project int, " + ", ".join(f"{k} string" for k in folders.KINDS))
    got = {r.project: (r.loaded, r.errors) for r in folders.projects(asked, found).collect()}
    assert got == {1: ({"pdf": "A"}, ["translation: ValueError: bad, b.json", "aiCache: no file c.json"]), 2: ({}, [])}
