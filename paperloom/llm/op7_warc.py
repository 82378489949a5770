"""WARC archives, written and read as a chunked record table.

Writing: every record is streamed into gzip members of an archive file in the shared
folder.  Of records with equal payloads of at least ``REVISIT_BYTES`` bytes, the one
with the largest page_id is the response, the others are revisit records that name it.

Reading: an archive is a stream of chunks; a payload of any size becomes rows
(record, chunk_no, bytes) that carry the SHA-1 of the payload so far, so neither side
holds a whole record beyond what the row it came from holds already, and the last
chunk's digest is the record's.

Defined cases: null html is an empty payload, a response; null url is an empty URI;
equal page_ids with equal payloads have the same record type; a null page_id is less than
any other, so such a row revisits the largest page_id of its payload, and is a response
where no row of the payload has an id; an empty table gives no archives.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, shuffle_partitions, stored, table

REVISIT_BYTES = 1000
CHUNK = 1 << 20
ARCHIVE_BYTES = 256 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds digest (hex SHA-1), payload_bytes, record_type and refers_to to page_id, url, html.

    Groups of equal payloads are reduced by (digest, length) with a combine before the
    shuffle; only groups of two or more come back, as one narrow row each.  Spark
    broadcasts them if their stored files are small, else joins by shuffle and splits
    a hot digest.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    sized = pages.select("page_id", "url", html.alias("html")).withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha1("html")})
    large = sized.filter(F.col("payload_bytes") >= least)
    groups = large.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = stored(groups.select(F.col("payload_digest").alias("_d"), F.col("payload_bytes").alias("_b"), "_first"), "warc-groups")
    same = (F.col("payload_digest") == F.col("_d")) & (F.col("payload_bytes") == F.col("_b"))
    revisit = F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id"))
    return sized.join(groups, same, "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to")
    )


class ArchiveWriter:
    """One archive; each record is a gzip member of its own."""

    def __init__(self, folder: str, name: str):
        self.path, self.out = files.create(folder, name)
        self.bytes = self.records = 0

    def _put(self, gz, data: bytes) -> None:
        self.bytes += self.out.write(gz.compress(data)) or 0

    def add(self, page_id, url, payload: bytes, size: int, digest: str, kind: str, refers_to) -> None:
        body = kind == "response"
        head = [
            "WARC/1.1",
            f"WARC-Type: {kind}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {(url or '').translate({10: '%0A', 13: '%0D'})}",
            f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {size}",
        ]
        if not body:
            head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        head += ["Content-Type: text/html", f"Content-Length: {size if body else 0}", "", ""]
        gz = zlib.compressobj(4, zlib.DEFLATED, 31)
        self._put(gz, "\r\n".join(head).encode())
        if body:
            view = memoryview(payload)
            for i in range(0, size, CHUNK):
                self._put(gz, view[i : i + CHUNK])
        self._put(gz, b"\r\n\r\n")
        self.bytes += self.out.write(gz.flush()) or 0
        self.records += 1


def write_archives(records: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the rows of ``record_types`` to archives; one row (path, records) per file, stored."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, number, open_ = TaskContext.get().partitionId(), 0, None

        def close(a: ArchiveWriter) -> pa.RecordBatch:
            a.out.close()
            return pa.RecordBatch.from_pydict({"path": [a.path], "records": [a.records]}, schema=schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, size, digest, kind, refers_to = (c[i] for c in columns)
                if open_ is None:
                    open_ = ArchiveWriter(folder, f"{rank:06d}-{number:04d}.warc.gz")
                    number += 1
                open_.add(page_id.as_py(), url.as_py(), html.as_buffer(), size.as_py(), digest.as_py(), kind.as_py(), refers_to.as_py())
                if open_.bytes >= most:
                    yield close(open_)
                    open_ = None
        if open_ is not None:
            yield close(open_)

    return stored(records.mapInArrow(write, "path string, records long"), "warc-files")


class _Inflated:
    """The bytes of a file of gzip members, by lines and by blocks of bounded size."""

    def __init__(self, raw):
        self.raw, self.data, self.gz, self.ended = raw, b"", zlib.decompressobj(31), False
        self.rest = b""

    def _fill(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.raw.read(CHUNK // 16)
                if not self.rest:
                    got = b"" if self.gz.eof else self.gz.flush()  # output held back by the size limit
                    self.data += got
                    return bool(got)
            if self.gz.eof:
                self.gz = zlib.decompressobj(31)
            got = self.gz.decompress(self.rest, CHUNK)
            self.rest = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if got:
                self.data += got
                return True

    def line(self) -> bytes:
        while (i := self.data.find(b"\r\n")) < 0:
            if not self._fill():
                return b""
        out, self.data = self.data[:i], self.data[i + 2 :]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n:
            if not self._fill():
                raise ValueError("the archive ends inside a record")
        out, self.data = self.data[:n], self.data[n:]
        return out

    def more(self) -> bool:
        return bool(self.data) or self._fill()


def chunks_of(path: str, chunk: int = CHUNK) -> Iterator[dict]:
    """Rows of the chunked record table of one archive, in its order."""
    with files.stream(path) as raw:
        text = _Inflated(raw)
        while text.more():
            if text.line() != b"WARC/1.1":
                raise ValueError(f"{path}: no record where one should begin")
            head = {}
            while line := text.line():
                name, _, value = line.decode().partition(": ")
                head[name] = value
            left, number, digest = int(head["Content-Length"]), 0, hashlib.sha1()
            while True:
                data = text.take(min(left, chunk))
                left -= len(data)
                digest.update(data)
                yield {"head": head, "chunk_no": number, "data": data, "digest": digest.hexdigest(), "last": not left}
                number += 1
                if not left:
                    break
            text.take(4)


SCHEMA = "page_id long, url string, record_type string, refers_to long, chunk_no int, chunk_bytes long, digest_so_far string, last boolean, announced_digest string, announced_bytes long"


def read_archives(manifest: DataFrame, with_data: bool = True, chunk: int = CHUNK) -> DataFrame:
    """The chunked record table of the archives; ``with_data`` adds each chunk's bytes."""

    def number(urn: str | None) -> int | None:
        digits = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["data"] * with_data
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in SCHEMA.split(", ")] + [("data", pa.binary())] * with_data)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for c in chunks_of(path, chunk):
                    h = c["head"]
                    rows.append(
                        (number(h["WARC-Record-ID"]), h["WARC-Target-URI"], h["WARC-Type"], number(h.get("WARC-Refers-To")), c["chunk_no"], len(c["data"]), c["digest"], c["last"], h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"]))
                        + ((c["data"],) if with_data else ())
                    )
                    size += len(c["data"]) if with_data else 0
                    if len(rows) >= 5000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    spread = max(2, shuffle_partitions(manifest.sparkSession))
    return manifest.select("path").repartition(spread).mapInArrow(read, SCHEMA + ", data binary" * with_data)


def records_of(chunks: DataFrame) -> DataFrame:
    """One row per record, from its last chunk: all of a record's chunks are in one archive.

    A response's digest is what the bytes read gave; a response whose bytes differ
    from the announced digest or length is an error, not a row.
    """
    ended = chunks.filter("last")
    response = F.col("record_type") == "response"
    wrong = response & (F.col("digest_so_far") != F.col("announced_digest"))
    digest = F.when(wrong, F.raise_error(F.lit("payload digest differs"))).when(response, F.col("digest_so_far")).otherwise(F.col("announced_digest"))
    return ended.select("page_id", F.col("announced_bytes").alias("payload_bytes"), digest.cast("string").alias("payload_digest"), "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = record_types(table(spark, sf_dir, "pages"))
    return records_of(read_archives(write_archives(records, fresh_path(spark, "warc")), with_data=False))


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, payload_bytes, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT p.page_id, p.payload_bytes::BIGINT AS payload_bytes, p.payload_digest,
       CASE WHEN g.first IS NOT NULL AND g.first IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.first IS DISTINCT FROM p.page_id THEN g.first END AS refers_to
FROM p LEFT JOIN g USING (payload_digest, payload_bytes)
"""

QUERIES = {"op7_warc": op7_warc}
ORACLES = {"op7_warc": ORACLE}
