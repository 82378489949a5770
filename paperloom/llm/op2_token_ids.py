"""Token-ID output: id arrays in shard files with Elias-Fano document boundaries.

Documents are dealt by ranges of doc_id, sorted, encoded and written as shards; each
file holds a concatenated array of 16- or 32-bit ids and, instead of a table of 64-bit
offsets, the document ends as an Elias-Fano sequence: about 2 + log2(ids / documents)
bits a document, with sampled positions of its set bits so that any document's offset
is found by one jump and a scan of a few words (``EliasFano.select``).

File layout (little-endian): magic ``PLTK``, u8 version, u8 bytes per id, u16 zero,
u64 documents, u64 ids, i64 rank of the range, i64 number of the shard in its range,
u64 length of the doc_id block; the doc_id block (zlib: i64 each, then a bit each that is
set for null); Elias-Fano block (see ``EliasFano.to_bytes``) after its u64 length; the ids.

Defined cases: null text is empty and has only the end id; null doc_ids come first;
equal doc_ids are ordered by a hash of their texts, then by their place in the input, so
any number of them spreads over tasks; a text longer than a shard is a shard of its
own; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, shuffle_partitions, stored, table, text_or_empty
from .words import U, hashes_of_bytes, slices

MAGIC, VERSION, HEAD = b"PLTK", 2, struct.Struct("<4sBBHQQqqQ")
END_ID = 1
SHARD_IDS = 4_000_000
SAMPLE = 256


class EliasFano:
    """A non-decreasing sequence of integers under ``universe`` in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        values = values.astype(np.uint64)
        low_bits = max(0, int(universe // n).bit_length() - 1) if n else 0
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(at[-1]) + 1 if n else 0) + 7 & ~7, np.uint8)
        bits[at] = 1
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, low_bits, np.packbits(low, bitorder="little"), np.packbits(bits, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def select(self, i: int) -> int:
        """The i-th value, from the nearest sampled set bit on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = (byte << 3) + (word & -word).bit_length() - 1
        start = i * self.low_bits
        raw = int.from_bytes(self.low[start >> 3 : (start + self.low_bits + 7) >> 3].tobytes(), "little")
        return (position - i) << self.low_bits | raw >> (start & 7) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return ((at - np.arange(self.n)) << self.low_bits) + (low << np.arange(self.low_bits)).sum(axis=1)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQQ", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<QBQQQ", raw)
        at = struct.calcsize("<QBQQQ")
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), np.frombuffer(raw, "<u4", c, at + a + b))


#: The split that the fast path takes apart itself: the file's pre-tokenizer must have this pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Kinds of bytes: white space, letters, digits, other signs, and what the fast path leaves to the tokenizer.
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[[0x20, *range(0x09, 0x0E)]] = BLANK
KIND[0x21:0x7F] = SIGN
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = LETTER
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[0xC3] = LETTER  # with a byte of 0x80-0xBF: the letters from U+00C0 to U+00FF
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 0x20


class PieceStore:
    """Ids of pre-tokens by their 64-bit hash, in arrays of fixed size.

    Two of ten million pre-tokens share a hash with a probability under 1e-5.  At ``most``
    entries those that weren't looked up since the last time go.
    """

    PROBES = 8

    def __init__(self, most: int, kind: str):
        self.most, self.bits = most, max(8, (2 * most - 1).bit_length())
        self.kind = kind
        self.reset()

    def reset(self) -> None:
        size = (1 << self.bits) + self.PROBES
        self.keys, self.entry = np.zeros(size, U), np.full(size, -1, np.int32)
        self.n, self.used = 0, np.zeros(self.most, bool)
        self.start, self.size = np.zeros(self.most, np.int32), np.zeros(self.most, np.int32)
        self.ids = np.zeros(0, self.kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, -1 for none."""
        slot = (keys >> U(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.entry[slot], -1)
        left = np.flatnonzero((out < 0) & (self.entry[slot] >= 0))
        for probe in range(1, self.PROBES):
            if not len(left):
                break
            at = slot[left] + probe
            here = self.keys[at] == keys[left]
            out[left[here]] = self.entry[at[here]]
            left = left[~here & (self.entry[at] >= 0)]
        self.used[out[out >= 0]] = True
        return out

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds distinct keys that aren't there; what finds no slot or no room is left out."""
        if self.n + len(keys) > self.most:
            self.forget()
        keep = slice(0, self.most - self.n)
        keys, sizes = keys[keep], sizes[keep]
        ids = ids[: int(sizes.sum())]
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.start[number], self.size[number] = len(self.ids) + np.cumsum(sizes) - sizes, sizes
        self.ids, self.n = np.concatenate([self.ids, ids]), self.n + len(keys)
        slot, left = (keys >> U(64 - self.bits)).astype(np.int64), np.arange(len(keys))
        for probe in range(self.PROBES):
            free = left[self.entry[slot[left] + probe] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won] + probe], self.entry[slot[won] + probe] = keys[won], number[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            if not len(left):
                break

    def forget(self) -> None:
        """Keeps what was looked up since the last time, at most half of the room."""
        filled = np.flatnonzero(self.entry >= 0)
        filled = filled[self.used[self.entry[filled]]][: self.most // 2]
        keys, entry = self.keys[filled], self.entry[filled]
        sizes = self.size[entry]
        ids = self.ids[spans(self.start[entry], sizes)]
        self.reset()
        self.add(keys, sizes, ids)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places start, start + 1 ... of every range of ``size``, one after the other."""
    size = size.astype(np.int64)
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class WordEncoder:
    """Ids of texts by a tokenizers file that encodes each of its pre-tokens on its own.

    Texts of printable ASCII, the letters U+00C0 to U+00FF and white space are split here,
    for a whole batch at once and exactly as the file's normalizer and pre-tokenizer split
    them.  A corpus repeats its pre-tokens, so their ids are kept (``PieceStore``), and only
    unseen ones go through the tokenizer.  Any other text, one that holds the string of a
    special token, and every text under another pre-tokenizer is encoded whole.
    """

    def __init__(self, path: str, most: int = 400_000):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.path, self._whole = path, None
        self.pieces = Tokenizer.from_file(path)
        vocabulary = self.pieces.get_vocab()
        size = max(vocabulary.values(), default=0) + 1
        self.width = 2 if size <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.special = [t.content.encode() for t in self.pieces.get_added_tokens_decoder().values()]
        self.last = np.zeros(size, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        steps = (json.loads(self.pieces.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.fast = steps[0].get("pattern", {}).get("Regex") == SPLIT
        # Pieces are normalised and split already.
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.store = PieceStore(most, self.kind)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
        return [np.array(x.ids, self.kind) for x in self._whole.encode_batch_fast(texts, add_special_tokens=False)]

    def learned(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of distinct pieces."""
        sizes, found = [], []
        for i in range(0, len(pieces), 2048):
            some = pieces[i : i + 2048]
            ids = np.array(self.pieces.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != len(some):  # a piece without an end-of-word id
                each = self.whole([p.decode() for p in some])
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            sizes.append(np.diff(stops, prepend=0))
            found.append(ids)
        return np.concatenate(sizes), np.concatenate(found)

    def split(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(lower-case bytes, starts, ends of the pre-tokens, easy): ``bounds`` are the texts' places in ``data``."""
        kind, low = KIND[data], LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        after = lead + 1
        second = data[after]
        sign = (second == 0x97) | (second == 0xB7)
        low[after] = np.where((second < 0x9F) & (second != 0x97), second + np.uint8(0x20), second)
        kind[after] = kind[lead] = np.where(sign, SIGN, LETTER)
        hard = np.concatenate([[0], np.cumsum(kind == OTHER)])[bounds]
        easy = np.diff(hard) == 0 if self.fast else np.zeros(len(bounds) - 1, bool)
        raw = data.tobytes()
        for token in self.special:
            at = raw.find(token)
            while at >= 0:
                easy[np.searchsorted(bounds, at, side="right") - 1] = False
                at = raw.find(token, at + 1)
        edge = np.zeros(len(data) + 1, bool)
        edge[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        edge[bounds] = True
        at = np.flatnonzero(edge)
        filled = kind[at[:-1]] != BLANK
        start, end = at[:-1][filled], at[1:][filled]
        # Contractions: a lone apostrophe takes the letters that follow it.
        lone = np.flatnonzero((low[start[:-1]] == ord("'")) & (end[:-1] - start[:-1] == 1) & (start[1:] == end[:-1]) & (kind[start[1:]] == LETTER))
        at = start[lone + 1]
        lone = lone[bounds[np.searchsorted(bounds, at)] != at]  # in one text
        at = start[lone + 1]
        one, two = low[at].astype(np.int64), low[np.minimum(at + 1, end[lone + 1] - 1)].astype(np.int64)
        two[end[lone + 1] - at < 2] = 0
        taken = np.where(np.isin(one, list(b"stmd")), 1, np.where(np.isin(one << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]), 2, 0))
        end[lone] += taken
        start[lone + 1] += taken
        some = end > start
        return low, start[some], end[some], easy

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, each with ``end`` after it; number of ids of each text)."""
        texts = texts.cast(pa.large_binary())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        entry, easy = np.zeros(0, np.int64), np.ones(n, bool)
        first = np.zeros(n + 1, np.int64)
        sizes = ids = None
        if len(data):
            low, start, stop, easy = self.split(data, bounds)
            inside = easy[np.searchsorted(bounds, start, side="right") - 1]
            start, stop = start[inside], stop[inside]
            first = np.searchsorted(start, bounds)
            keys = hashes_of_bytes(low, start, stop)
            entry = self.store.find(keys)
            missed = np.flatnonzero(entry < 0)
            sizes = np.where(entry < 0, 0, self.store.size[entry])
            at, ids = self.store.start[entry].astype(np.int64), self.store.ids
            if len(missed):
                new, one, which = np.unique(keys[missed], return_index=True, return_inverse=True)
                at_new = missed[one]
                raw = low.tobytes()
                new_sizes, new_ids = self.learned([raw[a:b] for a, b in zip(start[at_new].tolist(), stop[at_new].tolist(), strict=True)])
                sizes[missed] = new_sizes[which]
                at[missed] = len(ids) + (np.cumsum(new_sizes) - new_sizes)[which]
                ids = np.concatenate([ids, new_ids])
                self.store.add(new, new_sizes, new_ids)
        upto = np.concatenate([[0], np.cumsum(sizes)]) if sizes is not None else np.zeros(1, np.int64)
        counts = np.diff(upto[first])
        hard = np.flatnonzero(~easy)
        others = self.whole([texts[int(i)].as_py().decode("utf-8") for i in hard]) if len(hard) else []
        for i, x in zip(hard, others, strict=True):
            counts[i] = len(x)
        out = np.empty(int(counts.sum()) + n, self.kind)
        tail = np.cumsum(counts + 1) - 1
        out[tail] = end
        if sizes is not None:
            begin = (tail - counts)[easy]
            out[spans(begin, counts[easy])] = ids[spans(at, sizes)]
        for i, x in zip(hard, others, strict=True):
            out[tail[i] - len(x) : tail[i]] = x
        return out, counts + 1


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder: about 60 MB, of which the store of 20 MB has a fixed size."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_file(folder: str, width: int, rank: int, number: int, doc_ids: pa.Array, counts: np.ndarray, ids: list[np.ndarray]) -> tuple[str, int]:
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1])
    absent = doc_ids.is_null().to_numpy(zero_copy_only=False)
    values = doc_ids.fill_null(0).to_numpy().astype("<i8")
    keys = zlib.compress(values.tobytes() + np.packbits(absent, bitorder="little").tobytes(), 1)
    bounds = EliasFano.build(ends, total + 1).to_bytes()
    path, out = files.create(folder, f"{rank:06d}-{number:06d}")
    with out:
        out.write(HEAD.pack(MAGIC, VERSION, width, 0, len(ends), total, rank, number, len(keys)))
        out.write(keys + struct.pack("<Q", len(bounds)) + bounds)
        for x in ids:
            out.write(x.tobytes())
    return path, total


class TokenFile:
    """A shard read through its boundaries: any run of documents by two selects and one read."""

    def __init__(self, f, path: str):
        magic, version, self.width, _, self.n, self.total, _, _, keys = HEAD.unpack(f.read(HEAD.size))
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError(f"{path}: not a token file")
        raw = zlib.decompress(f.read(keys))
        absent = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * self.n), bitorder="little")[: self.n].astype(bool)
        self.doc_ids = pa.array(np.frombuffer(raw, "<i8", self.n), pa.int64(), mask=absent)
        length = struct.unpack("<Q", f.read(8))[0]
        self.bounds = EliasFano.from_bytes(f.read(length))
        self.f, self.first = f, HEAD.size + keys + 8 + length
        if self.bounds.n != self.n or (self.n and self.bounds.select(self.n - 1) != self.total):
            raise ValueError(f"{path}: the boundaries don't end at {self.total} ids")

    def offset(self, i: int) -> int:
        """Where the i-th document begins; for i = n, where the last one ends."""
        return self.bounds.select(i - 1) if i else 0

    def read(self, i: int, j: int) -> np.ndarray:
        """The ids of documents i to j (not included)."""
        start, end = self.offset(i), self.offset(j)
        self.f.seek(self.first + start * self.width)
        return np.frombuffer(self.f.read((end - start) * self.width), f"<u{self.width}")


def read_document(path: str, i: int) -> np.ndarray:
    """The ids of the file's i-th document alone."""
    with files.seekable(path) as f:
        return TokenFile(f, path).read(i, i + 1)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, partitions: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shard files; one row per file.

    Returns (path, rank, number, documents, ids), stored: the files are written once.
    """
    n = partitions or max(2, shuffle_partitions(docs.sparkSession))
    # The last two keys split the rows of one doc_id, however many there are.
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    ordered = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, rank, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        keys: list[pa.Array] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def close():
            nonlocal keys, counts, held, size, number
            n_docs = sum(map(len, counts))
            path, total = write_file(folder, e.width, rank, number, pa.concat_arrays(keys), np.concatenate(counts), held)
            row = pa.RecordBatch.from_pydict({"path": [path], "rank": [rank], "number": [number], "documents": [n_docs], "ids": [total]}, schema=out)
            keys, counts, held, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                ids, each = e.encode(part.column("text"), end_id)
                upto = np.concatenate([[0], np.cumsum(each)])
                i = 0
                while i < len(each):
                    # As many documents as the shard has room for; one in an empty shard in any case.
                    j = int(np.searchsorted(upto, upto[i] + shard_ids - size, side="right")) - 1
                    if j <= i and held:
                        yield close()
                        continue
                    j = max(i + 1, j)
                    keys.append(part.column("doc_id").slice(i, j - i))
                    counts.append(each[i:j])
                    held.append(ids[upto[i] : upto[j]])
                    size += int(upto[j] - upto[i])
                    i = j
        if held:
            yield close()

    out = pa.schema([("path", pa.string()), ("rank", pa.int64()), ("number", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
    return stored(ordered.mapInArrow(write, "path string, rank long, number long, documents long, ids long"), "token-files")


def read_ids(manifest: DataFrame, run: int = 4096) -> DataFrame:
    """One row per document of the files: doc_id, start among all ids, n_tokens, ids_crc32.

    A file is read by runs of documents, each found by its boundaries.
    """
    # A few rows per shard: sums by range first, so the ordered sum is over ranges only.
    ranges = manifest.groupBy("rank").agg(F.sum("ids").alias("_n")).withColumn("_base", F.sum("_n").over(W.orderBy("rank")) - F.col("_n")).drop("_n")
    inner = F.sum("ids").over(W.partitionBy("rank").orderBy("number")) - F.col("ids")
    # A task takes a few files; a file is read by one task.
    spread = max(2, shuffle_partitions(manifest.sparkSession))
    placed = manifest.withColumn("_inner", inner).join(ranges, "rank").select("path", (F.col("_base") + F.col("_inner")).alias("base")).repartition(spread)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with files.seekable(path) as f:
                    found = TokenFile(f, path)
                    for i in range(0, found.n, run):
                        j = min(found.n, i + run)
                        ids, start = found.read(i, j).astype("<u4"), found.offset(i)
                        ends = np.array([found.offset(k) for k in range(i + 1, j + 1)]) - start
                        starts = np.concatenate([[0], ends[:-1]])
                        crc = [zlib.crc32(ids[a:b].data) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                        columns = [found.doc_ids.slice(i, j - i), pa.array(base + start + starts), pa.array(ends - starts), pa.array(crc, pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    return read_ids(write_ids(docs, fresh_path(spark, "tokens"), tokenizer or tokenizer_path()))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_ids": op2_token_ids}
ORACLES: dict[str, str] = {}
