"""Folders of named files: a data source that reads and writes them, and what is found in them.

``named_files`` is a Spark data source.  Reading lists the files of a folder once and deals
them to tasks by size, each file with its time, length and text; a file that can't be read
(gone since the listing, too large, not UTF-8) is a row with an error and costs the others
nothing.  Writing puts each row's value into the file it names, under a name of its own
first and then in place, so a task that runs twice leaves one whole file.

The operators take its rows (path, modified, length, value, error), or any table like it:
newest outputs by suffix, records of job.json files, results that can be used again, and
projects of several files, where each file that is missing or bad is told by an error.

Defined cases: a folder that doesn't exist has no files; the error of an empty text is
null; of files with equal times the one of the greatest path is the newest; a null or
blank path in a project asks for nothing and is no error.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import text as T
from .tables import shared_folder, table

FILES = "path string, modified timestamp, length long, value string, error string"
#: Bytes of a partition of files, and of the largest file that is read whole.
PARTITION_BYTES, LARGEST = 64 << 20, 256 << 20
#: The suffixes of outputs by mode, the providers that a record may name, and the kinds of a project's files.
SUFFIX = {"dual": "-dual.pdf", "mono": "-mono.pdf"}
PROVIDERS = ("openai", "deepseek", "kimi", "custom")
KINDS = ("pdf", "translation", "aiCache", "translatedPdf", "translatedMonoPdf")


def _store(path: str):
    """The file system of a folder, and the folder's path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    files: list


class NamedFiles(DataSource):
    """Options: path; suffix (of names to read, any case); partitionBytes; largest."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema: StructType) -> DataSourceReader:
        return FilesReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options)


class FilesReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.suffix = options["path"], options.get("suffix", "").lower()
        self.most, self.largest = int(options.get("partitionBytes", PARTITION_BYTES)), int(options.get("largest", LARGEST))

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
        files = sorted((f.path, f.mtime_ns or 0, f.size or 0) for f in found if f.is_file and f.path.lower().endswith(self.suffix) and not f.base_name.startswith((".", "_")))
        ranges, size = [Range([])], 0
        for path, mtime, length in files:
            if ranges[-1].files and size + length > self.most:
                ranges.append(Range([]))
                size = 0
            ranges[-1].files.append((path[len(root.rstrip("/")) + 1 :], mtime, length))
            size += length
        return ranges

    def read(self, partition: Range) -> Iterator[tuple]:
        from datetime import UTC, datetime

        store, root = _store(self.path)
        for path, mtime, length in partition.files:
            value = error = None
            try:
                if length > self.largest:
                    raise ValueError(f"{length} bytes are more than {self.largest}")
                with store.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
                    value = f.read().decode("utf-8")
            except (OSError, ValueError) as e:  # a bad file is a row, the others are still read
                error = f"{type(e).__name__}: {e}"
            yield path, datetime.fromtimestamp(mtime / 1e9, UTC).replace(tzinfo=None) if mtime else None, length, value, error


class FilesWriter(DataSourceWriter):
    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        store, root = _store(self.path)
        for row in iterator:
            to = f"{root.rstrip('/')}/{row['path']}"
            folder, name = os.path.split(to)
            store.create_dir(folder, recursive=True)
            own = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write((row["value"] or "").encode("utf-8"))
            store.move(own, to)
        return WriterCommitMessage()


def files(spark: SparkSession, path: str, suffix: str = "", **options) -> DataFrame:
    """Rows of ``FILES``, paths relative to ``path``."""
    spark.dataSource.register(NamedFiles)
    return spark.read.format("named_files").options(path=path, suffix=suffix, **{k: str(v) for k, v in options.items()}).load()


def write_files(rows: DataFrame, path: str) -> None:
    """Rows (path, value) as files of ``path``; of rows with one path any may win, so give each once."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("path", "value").write.format("named_files").option("path", path).mode("append").save()


def folder_of(path: Column) -> Column:
    """The first folder of a relative path, '' for none."""
    return F.regexp_extract(path, r"^([^/]+)/", 1)


def newest(found: DataFrame, suffix: str) -> DataFrame:
    """(folder, path, modified) of the newest file of every folder whose name ends so, in any case."""
    named = found.filter(F.endswith(F.lower("path"), F.lit(suffix))).select(folder_of(F.col("path")).alias("folder"), "path", "modified")
    return named.groupBy("folder").agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified"))


def resolved(found: DataFrame, expected: DataFrame, suffix: str) -> DataFrame:
    """(folder, path) of outputs: the expected path where it is there, else the newest with the suffix, else null.

    ``expected``: folder and path.
    """
    there = expected.join(found.select("path").distinct().withColumn("_there", F.lit(True)), "path", "left")
    best = newest(found, suffix).select("folder", F.col("path").alias("_newest"))
    return there.join(best, "folder", "left").select("folder", F.when(F.col("_there"), F.col("path")).otherwise(F.col("_newest")).alias("path"))


def job_records(found: DataFrame) -> DataFrame:
    """Records of ``<folder>/job.json`` files: folder, its fields by default, and an error where there is no valid record.

    Valid is a JSON object with translatedPdfPath and translationSourceHash.
    """
    jobs = found.filter(F.col("path").rlike(r"^[^/]+/job\.json$"))
    v = jobs.withColumn("v", F.try_parse_json("value"))
    # Only texts count as texts: a number in their place is as good as nothing.
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")) == "STRING", F.try_variant_get("v", f"$.{k}", "string"))
    filled = lambda k: T.nonempty(text(k))
    name = lambda k: F.coalesce(filled(f"{k}Name"), T.base_name(F.replace(filled(f"{k}Path"), F.lit("\\"), F.lit("/"))))
    rows = v.select(
        folder_of(F.col("path")).alias("folder"), filled("translatedPdfPath").alias("translatedPdfPath"), name("translatedPdf").alias("translatedPdfName"), text("translatedMonoPdfPath").alias("translatedMonoPdfPath"), name("translatedMonoPdf").alias("translatedMonoPdfName"),
        F.when(text("translatedPdfMode") == "mono", "mono").otherwise("dual").alias("translatedPdfMode"), filled("translationSourceHash").alias("translationSourceHash"), filled("translatedAt").alias("translatedAt"),
        F.when(text("translatedProvider").isin(*PROVIDERS), text("translatedProvider")).otherwise("custom").alias("translatedProvider"), F.coalesce(text("translatedModel"), F.lit("")).alias("translatedModel"),
        F.coalesce("error", F.when(F.col("v").isNull(), "not JSON").when(~F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), "not a record")).alias("error"),
    )
    return rows.withColumn("error", F.coalesce("error", F.when(F.col("translatedPdfPath").isNull() | F.col("translationSourceHash").isNull(), "incomplete record")))


def reusable(jobs: DataFrame, wanted: DataFrame, found: DataFrame) -> DataFrame:
    """(folder, from_folder, path): for each of ``wanted`` (folder, hash, mode), its own cached result, else another folder's.

    A result counts if its record is valid, of the same hash and mode, and its file is there
    (paths relative to the same root).  Of other folders the first by name counts.  A hash
    that many folders share is first brought down to its two first folders, so that each
    finds one that isn't itself.
    """
    there = jobs.filter("error IS NULL").join(found.select(F.col("path").alias("translatedPdfPath")).distinct(), "translatedPdfPath", "left_semi")
    valid = there.select(F.col("folder").alias("from_folder"), F.col("translationSourceHash").alias("hash"), F.col("translatedPdfMode").alias("mode"), F.col("translatedPdfPath").alias("path"))
    own = valid.withColumnRenamed("from_folder", "folder").withColumnRenamed("path", "own_path")
    first = valid.groupBy("hash", "mode").agg(F.min(F.struct("from_folder", "path")).alias("a"))
    second = valid.join(first, ["hash", "mode"]).filter(F.col("from_folder") != F.col("a.from_folder")).groupBy("hash", "mode").agg(F.min(F.struct("from_folder", "path")).alias("b"))
    options = first.join(second, ["hash", "mode"], "left")
    mine = wanted.join(own, ["folder", "hash", "mode"], "left").join(options, ["hash", "mode"], "left")
    other = F.when(F.col("a.from_folder") != F.col("folder"), F.col("a")).otherwise(F.col("b"))
    return mine.select("folder", F.when(F.col("own_path").isNotNull(), F.col("folder")).otherwise(other["from_folder"]).alias("from_folder"), F.coalesce("own_path", other["path"]).alias("path"))


def projects(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Projects of several files: (project, loaded, errors).

    ``requests``: project and a path for each of ``KINDS``.  ``loaded`` maps kinds to texts;
    ``errors`` tells, in the order of kinds, what could not be read, and the rest is still there.
    """
    asked = requests.select("project", F.posexplode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in KINDS])).alias("ord", "x")).select("project", "ord", "x.*")
    met = asked.filter(F.trim(F.coalesce("path", F.lit(""))) != "").join(found.select("path", "value", "error", F.lit(True).alias("there")), "path", "left")
    error = F.when(F.col("there").isNull(), F.concat("kind", F.lit(": no file "), "path")).when(F.col("error").isNotNull(), F.concat("kind", F.lit(": "), "error", F.lit(", "), "path"))
    told = met.select("project", "ord", "kind", "value", error.alias("error"))
    good = F.collect_list(F.when(F.col("error").isNull(), F.struct("ord", "kind", "value")))
    bad = F.collect_list(F.when(F.col("error").isNotNull(), F.struct("ord", "error")))
    held = told.groupBy("project").agg(good.alias("g"), bad.alias("b"))  # at most a row for each kind
    loaded = F.map_from_entries(F.transform(F.array_sort("g"), lambda x: F.struct(x["kind"], x["value"])))
    every = requests.select("project").join(held, "project", "left")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return every.select("project", F.coalesce(loaded, empty).alias("loaded"), F.coalesce(F.transform(F.array_sort("b"), lambda x: x["error"]), F.array().cast("array<string>")).alias("errors"))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of suppliers, one folder each: two generations of outputs, a job.json of many kinds, and texts."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("folder"), "s_name", F.col("s_nationkey").alias("nation"))
    root = shared_folder(spark, "papers")
    at = lambda name: F.concat("folder", F.lit("/"), name)
    one = F.lit("paper")
    mode = F.when(F.col("k") % 4 == 1, "mono").otherwise("dual")
    output = at(F.concat(F.lit("paper-"), mode, F.lit(".pdf")))
    job = F.to_json(F.struct(output.alias("translatedPdfPath"), F.concat(F.lit("hash-"), F.col("nation").cast("string")).alias("translationSourceHash"), mode.alias("translatedPdfMode"), F.when(F.col("k") % 2 == 0, "kimi").otherwise("someone").alias("translatedProvider")))
    text = F.when(F.col("k") % 7 == 3, "{broken").when(F.col("k") % 7 == 5, "[1, 2]").when(F.col("k") % 7 == 6, '{"translatedPdfPath": 5}').otherwise(job)
    first = [(at(F.concat(one, F.lit("-dual.pdf"))), F.lit("old")), (at(F.concat(one, F.lit("-mono.pdf"))), F.lit("old")), (at(F.lit("job.json")), text), (at(F.lit("paper.json")), F.col("s_name"))]
    write_files(s.select(F.explode(F.array(*[F.struct(p.alias("path"), v.alias("value")) for p, v in first])).alias("x")).select("x.*"), root)
    write_files(s.filter("k % 3 = 0").select(at(F.lit("again-DUAL.PDF")).alias("path"), F.lit("new").alias("value")), root)
    return files(spark, root)


def newest_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest dual and mono outputs in the folders of suppliers."""
    found = _written(spark, sf_dir)
    both = [newest(found, suffix).select("folder", F.lit(mode).alias("mode"), "path") for mode, suffix in SUFFIX.items()]
    return both[0].unionByName(both[1])


def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of job.json files, or why there is none, and the result that each folder can use."""
    found = _written(spark, sf_dir)
    jobs = job_records(found)
    s = table(spark, sf_dir, "supplier")
    wanted = s.select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("folder"), F.concat(F.lit("hash-"), F.col("s_nationkey").cast("string")).alias("hash"), F.lit("dual").alias("mode"))
    return jobs.select("folder", "translatedPdfName", "translatedPdfMode", "translatedProvider", "error").join(reusable(jobs, wanted, found), "folder")


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects of suppliers: how many files were loaded, and the errors of the others."""
    found = _written(spark, sf_dir)
    s = table(spark, sf_dir, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("project"), F.col("s_suppkey").alias("k"))
    at = lambda name: F.concat("project", F.lit(f"/{name}"))
    asked = s.select("project", at("paper-dual.pdf").alias("pdf"), F.when(F.col("k") % 2 == 0, at("paper.json")).otherwise(at("none.json")).alias("translation"), F.when(F.col("k") % 5 == 0, "").otherwise(at("job.json")).alias("aiCache"), F.lit(None).cast("string").alias("translatedPdf"), at("again-DUAL.PDF").alias("translatedMonoPdf"))
    rows = projects(asked, found)
    return rows.select("project", F.array_join(F.array_sort(F.map_keys("loaded")), ",").alias("kinds"), F.element_at("loaded", "translation").alias("translation"), F.array_join("errors", "; ").alias("errors"))


_S = "s AS (SELECT s_suppkey AS k, lpad(s_suppkey::VARCHAR, 8, '0') AS folder, s_name, s_nationkey AS nation, CASE WHEN s_suppkey % 4 = 1 THEN 'mono' ELSE 'dual' END AS mode FROM supplier)"
QUERIES = {f.__name__: f for f in (newest_outputs, job_files, project_files)}
ORACLES = {
    "newest_outputs": f"WITH {_S} SELECT folder, 'dual' AS mode, folder || CASE WHEN k % 3 = 0 THEN '/again-DUAL.PDF' ELSE '/paper-dual.pdf' END AS path FROM s UNION ALL SELECT folder, 'mono', folder || '/paper-mono.pdf' FROM s",
    "job_files": f"""WITH {_S}, j AS (SELECT *, CASE k % 7 WHEN 3 THEN 'not JSON' WHEN 5 THEN 'not a record' WHEN 6 THEN 'incomplete record' END AS error FROM s),
        g AS (SELECT * FROM j WHERE error IS NULL AND mode = 'dual')
        SELECT *, from_folder || '/paper-dual.pdf' AS path FROM (SELECT j.folder, CASE WHEN error IS NULL THEN 'paper-' || mode || '.pdf' END AS translatedPdfName, CASE WHEN error IS NULL THEN mode ELSE 'dual' END AS translatedPdfMode, CASE WHEN error IS NULL AND k % 2 = 0 THEN 'kimi' ELSE 'custom' END AS translatedProvider, error,
               coalesce((SELECT g.folder FROM g WHERE g.k = j.k), (SELECT min(g.folder) FROM g WHERE g.nation = j.nation AND g.k <> j.k)) AS from_folder FROM j)""",
    "project_files": f"WITH {_S} SELECT folder AS project, array_to_string(list_sort(list_filter(['pdf', CASE WHEN k % 2 = 0 THEN 'translation' END, CASE WHEN k % 5 <> 0 THEN 'aiCache' END, CASE WHEN k % 3 = 0 THEN 'translatedMonoPdf' END], lambda x: x IS NOT NULL)), ',') AS kinds, CASE WHEN k % 2 = 0 THEN s_name END AS translation, array_to_string(list_filter([CASE WHEN k % 2 = 1 THEN 'translation: no file ' || folder || '/none.json' END, CASE WHEN k % 3 <> 0 THEN 'translatedMonoPdf: no file ' || folder || '/again-DUAL.PDF' END], lambda x: x IS NOT NULL), '; ') AS errors FROM s",
}
