"""Cross-tokenizer alignment by a postings cogroup.

Every text is encoded by two tokenizers, A (byte-level) and B (pieces with byte fallback),
whose tokens cover the same bytes.  Offsets where tokens of both end cut the text into
groups; an A and a B token are linked where their bytes overlap.  A pair of ids counts as
often as it is linked in the whole corpus, and a document's links are rated by these counts.

Encoding gives two kinds of rows, stored once: a summary for each document, and postings,
which are a slice's pairs of ids with the document and their multiplicity in it, sorted by
B id.  Pairs are summed slice by slice and then by Spark.  Postings are shuffled by ranges
of B ids and sorted, the sums of the range's pairs ahead of its postings; a task holds those
sums (as many as there are pairs of ids in a range, whatever the corpus), takes the maximum
for each B id, and lets the postings stream past.  What it emits is summed by document.
A range with more than its share of postings is dealt to several tasks, each of which gets
the range's sums, so that a B id may hold any part of all links.

Long texts are encoded and aligned in parts, cut where a single space stands between
other signs: neither tokenizer has tokens across such a place (pieces have their space in
front, and this is checked when the vocabulary is read).

Defined cases: null and empty texts and those whose tokens of either side don't give the
bytes of space + text (texts with U+2581) have no tokens, zeros and an empty hash; special
tokens' strings are plain text; null and repeated doc_ids and repeated rows are documents
of their own; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table, text_or_empty
from .words import slices

#: Ranges of B ids; entries of a row of postings; rows of postings of a task at most.
RANGES, ENTRIES, PER_TASK = 64, 1024, 4096
SLICE_BYTES, PART_CHARS = 1 << 21, 1 << 18
#: Bits of an A id and of a row in its slice.
ID_BITS, ROW_BITS = 20, 20
_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class TokenBytes:
    """The bytes of every id, in one array."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.flat[at + np.arange(len(at))]


class ByteBpe:
    """A byte-level BPE file of the tokenizers library, encoded by tiktoken: its ids are the ranks of its merges."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model["added_tokens"]}
        # Bytes that print stand for themselves, the others for 256 and on, in order.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = model["model"]["vocab"]
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["model"]["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
            raise ValueError(f"ids of {path} are not in the order of its merges")
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = {i: t for t, i in ranks.items()}
        self.tokens = TokenBytes([by_id.get(i, b"") for i in range(max(vocab.values()) + 1)])

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts that begin with a space."""
        return [self.encoding.encode_to_numpy(p, disallowed_special=()) for p in parts]


class PieceBpe:
    """A sentencepiece model, which puts a space in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError(f"{path} has pieces with a space inside")
        self.tokens = TokenBytes([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encode(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode([p[1:] for p in parts], num_threads=1)]


@cache
def _sides(a_path: str, b_path: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(a_path), PieceBpe(b_path)


@cache
def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of 0..n-1, right-aligned before a place for a sign, and which places are used."""
    width = len(str(max(n - 1, 1)))
    numbers = np.arange(n)
    power = 10 ** np.arange(width - 1, -1, -1)
    chars = np.zeros((n, width + 1), np.uint8)
    chars[:, :width] = numbers[:, None] // power % 10 + ord("0")
    used = np.ones((n, width + 1), bool)
    used[:, : width - 1] = numbers[:, None] >= power[:-1]
    return chars, used


def parts_of(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """space + text in parts of about ``part_chars``, each beginning with a space."""
    text, parts, at = " " + text, [], 0
    while len(text) - at > part_chars and (cut := _CUT.search(text, at + part_chars)):
        parts.append(text[at : cut.start()])
        at = cut.start()
    return [*parts, text[at:]]


def _fits(side: TokenBytes, ids: list[np.ndarray], data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which parts the tokens give back byte by byte."""
    size = np.diff(ends, prepend=0)
    good = np.array([int(side.size[x].sum()) for x in ids], np.int64) == size
    if good.all():
        wrong = np.flatnonzero(side.joined(np.concatenate(ids).astype(np.int64)) != data)
        good[np.searchsorted(ends, wrong, side="right")] = False
        return good
    for i in np.flatnonzero(good):
        good[i] = np.array_equal(side.joined(ids[i].astype(np.int64)), data[ends[i] - size[i] : ends[i]])
    return good


class Slice:
    """What the documents of one slice have: counts, hashes of their groups, and postings."""

    def __init__(self, rows: int):
        self.sums = {k: np.zeros(rows, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
        self.hashes: dict[int, object] = {}
        self.postings: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, row: np.ndarray, a: list[np.ndarray], b: list[np.ndarray], a_side: TokenBytes, b_side: TokenBytes, ends: np.ndarray) -> None:
        """Parts of texts that both sides cover: their rows, ids and where they end."""
        n = len(next(iter(self.sums.values())))
        ids_a, ids_b = np.concatenate(a).astype(np.int64), np.concatenate(b).astype(np.int64)
        end_a, end_b = np.cumsum(a_side.size[ids_a]), np.cumsum(b_side.size[ids_b])
        self.sums["n_a"] += np.bincount(row, [len(x) for x in a], n).astype(np.int64)
        self.sums["n_b"] += np.bincount(row, [len(x) for x in b], n).astype(np.int64)
        # Between two neighbouring ends of either side lies the overlap of just one A and one B token.
        bounds = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, bounds), np.searchsorted(end_b, bounds)
        of = row[np.searchsorted(ends, bounds)]
        self.sums["n_links"] += np.bincount(of, minlength=n)
        pair = (ids_b[at_b] << ID_BITS | ids_a[at_a]) << ROW_BITS | of
        self.postings.append(np.unique(pair, return_counts=True))

        last_a, last_b = end_b[np.searchsorted(end_b, end_a)] == end_a, end_a[np.searchsorted(end_a, end_b)] == end_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        count_a, count_b = np.bincount(group_a), np.bincount(group_b)
        group_row = row[np.searchsorted(ends, end_a[last_a])]
        self.sums["n_groups"] += np.bincount(group_row, minlength=n)
        start = np.cumsum(count_a + count_b) - count_a - count_b
        place_a = start[group_a] + np.arange(len(ids_a)) - (np.cumsum(count_a) - count_a)[group_a]
        place_b = (start + count_a)[group_b] + np.arange(len(ids_b)) - (np.cumsum(count_b) - count_b)[group_b]
        chars, used = _digits(max(len(a_side.size), len(b_side.size)))
        ids, sign = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
        ids[place_a], ids[place_b] = ids_a, ids_b
        sign[place_a], sign[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        written, keep = chars[ids], used[ids]
        written[:, -1] = sign
        upto = np.cumsum(keep.sum(axis=1))[start + count_a + count_b - 1]
        flat = written[keep]
        # A part's text of groups, without its last sign.
        part = np.searchsorted(ends, end_a[last_a])
        last = np.flatnonzero(np.append(part[1:] != part[:-1], True))
        begin = 0
        for i, end in zip(part[last], upto[last], strict=True):
            known = self.hashes.get(int(row[i]))
            if known is None:
                known = self.hashes[int(row[i])] = hashlib.sha256()
            else:
                known.update(b";")
            known.update(flat[begin : end - 1])
            begin = end

    def rows(self, key: int, doc_id: pa.Array, entries: int) -> Iterator[pa.RecordBatch]:
        n = len(doc_id)
        summary = {"key": pa.array(key + np.arange(n)), "doc_id": doc_id} | {k: pa.array(v) for k, v in self.sums.items()}
        summary["groups_sha256"] = pa.array([self.hashes[i].hexdigest() if i in self.hashes else "" for i in range(n)])
        yield _row_batch(n, summary)
        if not self.postings:
            return
        entry, times = self.postings[0]
        if len(self.postings) > 1:  # one text may be in several parts
            entry, inverse = np.unique(np.concatenate([e for e, _ in self.postings]), return_inverse=True)
            times = np.bincount(inverse, np.concatenate([t for _, t in self.postings])).astype(np.int64)
        where = range_of(entry >> (ID_BITS + ROW_BITS))
        order = np.argsort(where, kind="stable")
        where, entry, times = where[order], entry[order], times[order]
        bounds = np.searchsorted(where, np.arange(RANGES + 1))
        out = {k: [] for k in ("range", "key", "b", "a", "row", "times")}
        for r in range(RANGES):
            for i in range(int(bounds[r]), int(bounds[r + 1]), entries):
                e = entry[i : min(i + entries, int(bounds[r + 1]))]
                cells = (r, key, packed(e >> (ID_BITS + ROW_BITS)), packed(e >> ROW_BITS & (1 << ID_BITS) - 1), packed(e & (1 << ROW_BITS) - 1), packed(times[i : i + len(e)]))
                for k, v in zip(out, cells, strict=True):
                    out[k].append(v)
        yield _row_batch(len(out["key"]), {k: pa.array(v, _KINDS[k]) for k, v in out.items()})


_KINDS = {"key": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "range": pa.int32(), "b": pa.binary(), "a": pa.binary(), "row": pa.binary(), "times": pa.binary()}
_SCHEMA = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, range int, b binary, a binary, row binary, times binary"


def _row_batch(n: int, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in _KINDS.items()], list(_KINDS))


def range_of(b: np.ndarray) -> np.ndarray:
    return (b * 40503 >> 6) % RANGES


def packed(values: np.ndarray) -> bytes:
    """Integers from 0 on in as few bytes each as they need, after a byte that says how many."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(f"<u{kind.itemsize}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def encoded(docs: DataFrame, a_path: str, b_path: str, slice_bytes: int = SLICE_BYTES, part_chars: int = PART_CHARS, entries: int = ENTRIES) -> DataFrame:
    """Summaries (range is null) and postings of all rows of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = _sides(a_path, b_path)
        # Rows are known by task, slice and place: the table is stored once, so they stay.
        number = 0
        for batch in batches:
            for part in slices(batch, "text", slice_bytes):
                key = (TaskContext.get().partitionId() << 20 | number) << ROW_BITS
                number += 1
                yield from _encoded_slice(part, key, a_side, b_side, part_chars, entries)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, _SCHEMA)


def _encoded_slice(part: pa.RecordBatch, key: int, a_side: ByteBpe, b_side: PieceBpe, part_chars: int, entries: int) -> Iterator[pa.RecordBatch]:
    found = Slice(part.num_rows)
    runs, row, parts, size = [], [], [], 0

    def take() -> None:
        ends = np.cumsum([len(p.encode()) for p in parts])
        data = np.frombuffer("".join(parts).encode(), np.uint8)
        a, b = a_side.encode(parts), b_side.encode(parts)
        good = _fits(a_side.tokens, a, data, ends) & _fits(b_side.tokens, b, data, ends)
        runs.append((np.array(row), a, b, np.diff(ends, prepend=0), good))

    for i, text in enumerate(part.column("text").to_pylist()):
        for p in parts_of(text, part_chars) if text else []:
            row.append(i)
            parts.append(p)
            size += len(p)
            if size >= 4 * part_chars:
                take()
                row, parts, size = [], [], 0
    if parts:
        take()
    bad = {int(r) for rows, _, _, _, good in runs for r in rows[~good]}
    for rows, a, b, sizes, _ in runs:
        keep = [k for k, r in enumerate(rows) if int(r) not in bad]
        if keep:
            found.add(rows[keep], [a[k] for k in keep], [b[k] for k in keep], a_side.tokens, b_side.tokens, np.cumsum(sizes[keep]))
    yield from found.rows(key, part.column("doc_id"), entries)


def _entries(batch: pa.RecordBatch, rows_at_once: int = 256) -> Iterator[tuple[np.ndarray, ...]]:
    """(row of the batch, pair, document's key, times) of postings, some rows at once."""
    columns = {k: batch.column(k) for k in ("key", "b", "a", "row", "times")}
    for i in range(0, batch.num_rows, rows_at_once):
        part = {k: c.slice(i, rows_at_once).to_pylist() for k, c in columns.items()}
        b, a, row, times = ([unpacked(x) for x in part[k]] for k in ("b", "a", "row", "times"))
        n = [len(x) for x in b]
        yield np.repeat(np.arange(i, i + len(n)), n), np.concatenate(b) << ID_BITS | np.concatenate(a), np.repeat(np.array(part["key"], np.int64), n) + np.concatenate(row), np.concatenate(times)


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, and the sums of 64-bit values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(first) else v for v in values]


def pair_counts(postings: DataFrame) -> DataFrame:
    """(range, pair, n): how often a pair is linked in the corpus; pair is B id, then A id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, pair, _, times in _entries(batch):
                pair, n = _sum_by(pair, times)
                yield pa.RecordBatch.from_arrays([pa.array(range_of(pair >> ID_BITS).astype(np.int32)), pa.array(pair), pa.array(n)], ["range", "pair", "n"])

    return postings.select("key", "b", "a", "row", "times").mapInArrow(run, "range int, pair long, n long").groupBy("range", "pair").agg(F.sum("n").alias("n"))


def contributions(postings: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, n_best, count_sum) of parts of documents: postings met with their range's pairs.

    Both are shuffled by range and share and sorted, pairs first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, pairs, n, best = None, [], None, None, None
        for batch in batches:
            where = np.stack([batch.column(c).to_numpy() for c in ("range", "share", "kind")])
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
            for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(low, high - low)
                place, kind = tuple(where[:2, low]), where[2, low]
                if place != now:
                    now, gathered, pairs = place, [], None
                if kind == 0:
                    gathered.append((part.column("pair").to_numpy(), part.column("n").to_numpy()))
                    continue
                if pairs is None:
                    pairs, n = (np.concatenate(x) for x in zip(*gathered, strict=True))
                    first = np.flatnonzero(np.append(True, (pairs[1:] ^ pairs[:-1]) >> ID_BITS != 0))
                    best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n)))
                    gathered = []
                for _, pair, key, times in _entries(part):
                    at = np.searchsorted(pairs, pair)
                    key, m, s = _sum_by(key, times * best[at], times * n[at])
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m), pa.array(s)], ["key", "n_best", "count_sum"])

    # As many shares of each range as its postings need: no more than the others' mean, or PER_TASK.
    sizes = stored(postings.groupBy("range").agg(F.count("*").alias("rows")), "align-ranges")
    target = sizes.agg(F.greatest(F.lit(1), F.least(F.lit(PER_TASK), F.ceil(F.sum("rows") / RANGES))).alias("_target"))
    shares = stored(sizes.crossJoin(F.broadcast(target)).select(F.col("range").alias("_r"), F.ceil(F.col("rows") / F.col("_target")).cast("int").alias("_shares")), "align-shares")
    shares = F.broadcast(shares)  # a row for each range
    none = F.lit(None)
    left = counts.join(shares, F.col("range") == F.col("_r")).select("range", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("share"), F.lit(0).alias("kind"), "pair", "n", none.cast("long").alias("key"), *[none.cast("binary").alias(c) for c in ("b", "a", "row", "times")])
    right = postings.join(shares, F.col("range") == F.col("_r")).select("range", F.pmod(F.xxhash64("key", "b"), F.col("_shares")).cast("int").alias("share"), F.lit(1).alias("kind"), none.cast("long").alias("pair"), none.cast("long").alias("n"), "key", "b", "a", "row", "times")
    partitions = max(2, shuffle_partitions(postings.sparkSession))
    dealt = left.unionByName(right).repartition(partitions, "range", "share").sortWithinPartitions("range", "share", "kind", "pair", "key")
    return dealt.mapInArrow(run, "key long, n_best long, count_sum long")


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, **sizes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs``.

    ``sizes``: slice_bytes, part_chars and entries; they don't change the result.
    """
    both = stored(encoded(docs, a_path or byte_bpe_path(), b_path or piece_bpe_path(), **sizes), "align-encoded")
    postings = both.filter("range IS NOT NULL").select("range", "key", "b", "a", "row", "times")
    counts = stored(pair_counts(postings), "align-counts")
    rated = contributions(postings, counts).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    summary = both.filter("range IS NULL").select("key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = F.lit(0).cast("long")
    return summary.join(rated, "key", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))


QUERIES = {"op12_alignment": op12_alignment}
#: Tokenizers are beyond SQL; tests hold the query against a plain version.
ORACLES: dict[str, str] = {}
