"""Benchmark decontamination by latent semantic retrieval and sequence checks.

Texts are compared in lower case and without punctuation (``folded``).  Passages are runs
of ``BLOCK``-word blocks, one from every block on, at the lengths of ``SPANS``.  Features
are the distinct words of the benchmark, weighed by inverse passage frequency over the
whole corpus; any other word adds a fixed weight to a passage's norm only, as it is
orthogonal to every item.  A passage with less than ``COSINE`` squared of its norm in
benchmark words can't reach that cosine with any item, so it is done with.

A distributed randomised SVD of the TF-IDF rows (the passages of the corpus that may reach
``FIT_COSINE`` with an item, here one after the other without overlap, and the items themselves, weighed as ``ITEMS`` times the
corpus) gives the latent space: every task
sums its part of A'(A S) for one random test matrix S; the driver gets one matrix of fixed
size (features x rank) and takes the singular vectors of the Nystroem approximation of A'A.
Passages are then compared with the items by cosine in that space, as a share of the cosine
that the item's own copy has there (many items don't fit in ``RANK`` dimensions and keep
only a part of their norm; under ``KEPT`` of it the share is taken of ``KEPT``).  Beside
this, an exact route looks up every run of ``GRAM`` words among those of the items, so that
a copy is found however little the space keeps of its item; ``cosine`` is 0 for what only
this route finds.

Candidates of both are checked in the text around them: the longest common subsequences of
the item's parts (sentences, those of over ``SEGMENT`` words cut), whose places may change,
must cover ``LCS`` of its words, or ``PARAPHRASE`` of them where the cosine found it, or
``ANSWERED`` of them where the item's answer (its last sentence) is there too.

A benchmark of over ``PART_BYTES`` is searched by several indexes, one after the other.
Items longer than the longest passage are looked up by pieces of that length, and checked
in as much text as they have words, with a margin of an eighth of them.  Items of common
words only have no cosine: of these, runs of ``GRAM`` words or more are found where the
whole item stands word for word.

Defined cases: null and empty texts have no passage and are clean; items without words,
and items of fewer than ``GRAM`` words that are all common, match nothing; an item without
an id counts once for each text, and the verdict's item_id is then null; repeated rows get
equal verdicts; of equal verdicts the least item_id is named; whole texts are searched,
whatever their length; columns of ``docs`` named like one of ``ADDED`` are replaced by
``search`` and kept by ``drop_contaminated``; an empty table or benchmark gives clean
verdicts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table, text_or_empty
from .words import Words, hashes_by_eight, runs, slices, window_hashes, words_of

BLOCK = 8
#: Passage lengths in blocks; an item is looked up at the shortest that holds it.
SPANS = (4, 6, 8, 11, 16)
RANK = 256
ITEMS = 30.0
COSINE = 0.48
#: Cosine that a passage must be able to reach to take part in the fit of the space.
FIT_COSINE = 0.74
#: Least share of an item's squared norm in the latent space by which its cosines are scaled.
KEPT = 0.25
#: Words of the runs that are looked up; runs of more than FEW items serve only the items that have no LEAST_GRAMS rarer ones.
GRAM, FEW, LEAST_GRAMS = 3, 64, 4
#: Weight of words outside the benchmark, as a share of the largest.
FOREIGN = 0.5
#: Shares of an item's words that decide: of any candidate, of one by cosine, and of one by cosine that has ANSWER of the answer.
LCS, PARAPHRASE, ANSWERED, ANSWER = 0.7, 0.48, 0.4, 0.8
#: No candidate of a smaller share decides.
LEAST_SHARE = min(LCS, PARAPHRASE, ANSWERED)
#: Words of an item's parts that may change places.
SEGMENT = 24
#: Bytes of benchmark text in one index: some 15,000 words, 75,000 at most, so 15 MB of vectors,
#: 77 MB at most.  Larger benchmarks are searched by several indexes.
PART_BYTES = 1 << 19
TABLE_BITS = 20
STRIP, FAN = 1 << 14, 32
COMMON = 50


#: Bytes as they are compared: ASCII in lower case, its punctuation as blanks.
FOLD = np.arange(256, dtype=np.uint8)
for _x in range(0x21, 0x7F):
    FOLD[_x] = ord(chr(_x).lower()) if chr(_x).isalnum() else 0x20


def folded(texts: pa.Array) -> pa.Array:
    """Texts (string; null is empty) in lower case, with ASCII and general punctuation as blanks."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())
    n = len(low)
    offsets = np.frombuffer(low.buffers()[1], np.int64)[low.offset : low.offset + n + 1]
    data = FOLD[np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]] if n else np.zeros(0, np.uint8)
    # U+2000 to U+206F: dashes, quotes, ellipses, spaces.
    at = np.flatnonzero(data == 0xE2)
    at = at[(data[at + 1] == 0x80) | ((data[at + 1] == 0x81) & (data[at + 2] < 0xB0))]
    for k in range(3):
        data[at + k] = 0x20
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data)])


def folded_words(texts: pa.Array) -> Words:
    return words_of(folded(texts), hashes_by_eight)


def words_in(text: str) -> list[bytes]:
    return folded(pa.array([text]))[0].as_py().split()


class Vocabulary:
    """Numbers of the benchmark's words, by their sorted hashes; a table has where each run of upper bits begins."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        bits = min(TABLE_BITS, max(8, (16 * len(self.hashes)).bit_length()))
        self.shift = np.uint64(64 - bits)
        size = np.bincount((self.hashes >> self.shift).astype(np.int64), minlength=1 << bits)
        self.longest, self.begin = int(size.max()), (np.cumsum(size) - size).astype(np.int32)

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """The feature of every word, -1 for none."""
        out = np.full(len(hashes), -1, np.int64)
        n = len(self.hashes)
        if not n:
            return out
        at = self.begin.take((hashes >> self.shift).view(np.int64))
        low = self.hashes.take(at, mode="clip")
        np.copyto(out, at, where=low == hashes)
        left = np.flatnonzero((low < hashes) & (at < n - 1))
        at = at[left]
        for _ in range(1, self.longest):  # others with these upper bits
            at += 1
            low, high = self.hashes.take(at), hashes[left]
            same = low == high
            out[left[same]] = at[same]
            more = (low < high) & (at < n - 1)
            left, at = left[more], at[more]
        return out


def blocks(w: Words, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word of every block, its text, and per text its first block; the last may be short."""
    counts = -(-np.diff(w.first) // size)
    first = np.concatenate([[0], np.cumsum(counts)])
    text = np.repeat(np.arange(len(counts)), counts)
    return w.first[:-1][text] + (np.arange(first[-1]) - first[:-1][text]) * size, text, first


def block_of_words(w: Words, first: np.ndarray, size: int = BLOCK) -> np.ndarray:
    text = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    return first[text] + (np.arange(len(w.start)) - w.first[text]) // size


def _reduced(frames: DataFrame, part, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all tasks of the arrays that ``part(batches)`` returns, by a tree of sums.

    A task's array travels in strips of ``STRIP`` numbers; a summing task meets at most
    ``FAN`` strips of each place, whatever the number of tasks, and the driver gets one sum
    of each place.
    """
    from pyspark import TaskContext

    schema = "task long, at long, x binary"
    names = ["task", "at", "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = part(batches).reshape(-1).astype(np.float32)
        task = TaskContext.get().partitionId()
        for i in range(0, len(total), STRIP):
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([i]), pa.array([total[i : i + STRIP].tobytes()], pa.binary())], names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (task, at): one running sum is held."""
        key, total = None, None
        for batch in batches:
            for task, at, x in zip(batch.column("task").to_pylist(), batch.column("at").to_pylist(), batch.column("x"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.float32)
                if key == (task, at):
                    total = total + x
                    continue
                if key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names)
                key, total = (task, at), x.astype(np.float64)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names)

    spark = frames.sparkSession
    size = int(np.prod(shape))
    tasks = frames.mapInArrow(run, schema).rdd.getNumPartitions()
    rows = frames.mapInArrow(run, schema)
    while tasks:
        tasks = -(-tasks // FAN) if tasks > 1 else 0  # the last sum leaves one of each place
        n = max(1, min(shuffle_partitions(spark), max(1, tasks) * -(-size // STRIP)))
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN).cast("long")).repartition(n, "task", "at").sortWithinPartitions("task", "at").mapInArrow(add, schema)
    total = np.zeros(size)
    found = rows.select("at", "x").toArrow()
    for at, x in zip(found.column("at").to_pylist(), found.column("x"), strict=True):
        x = np.frombuffer(x.as_buffer(), np.float32)
        total[at : at + len(x)] += x
    return total.reshape(shape)


def passage_counts(docs: DataFrame, vocabulary) -> tuple[np.ndarray, int]:
    """Blocks that hold each feature, and blocks in all, over the whole table."""
    n = len(vocabulary.value.hashes)

    def part(batches):
        v, total = vocabulary.value, np.zeros(n + 1)
        for batch in batches:
            for s in slices(batch, "text"):
                w = folded_words(s.column("text"))
                _, _, first = blocks(w)
                number = v.number(w.hash)
                some = number >= 0
                # The words of a block are next to each other, so the numbers are nearly sorted.
                pair = block_of_words(w, first)[some] * (n + 1) + number[some]
                pair = np.sort(pair.astype(np.int32) if first[-1] * (n + 1) < 1 << 31 else pair)
                total += np.bincount(pair[np.append(pair[1:] != pair[:-1], True)[: len(pair)]] % (n + 1), minlength=n + 1)
                total[n] += first[-1]
        return total

    got = _reduced(docs, part, (n + 1,))
    return got[:n], int(got[n])


class Passages:
    """The TF-IDF passages of a batch: which of them can reach a cosine, and their rows."""

    def __init__(self, w: Words, vocabulary: Vocabulary, idf: np.ndarray):
        self.starts, self.text, first = blocks(w)
        self.number = vocabulary.number(w.hash)
        block = self.block = block_of_words(w, first)
        self.first = first[:-1][self.text]
        weight = np.where(self.number >= 0, idf[self.number] ** 2 if len(idf) else 0.0, (FOREIGN * idf.max(initial=0.0)) ** 2)
        weight[(self.number < 0) & (w.end - w.start < 2)] = 0.0  # single signs
        total = lambda x: np.concatenate([[0.0], np.cumsum(np.bincount(block, x, minlength=len(self.starts)))])
        self.inside, self.all = total(np.where(self.number >= 0, weight, 0.0)), total(weight)
        self.last = first[1:][self.text]
        self.used = (self.number >= 0) & (weight > 0)
        self.count = len(w.start)

    def able(self, span: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first block, end block, squared norm) of the passages of ``span`` blocks that may reach ``cosine``."""
        at = np.arange(len(self.starts))
        end = np.minimum(at + span, self.last)
        inside, whole = self.inside[end] - self.inside[:-1], self.all[end] - self.all[:-1]
        ok = np.flatnonzero((inside > 1e-9) & (inside >= cosine * cosine * whole))
        return ok, end[ok], whole[ok]

    def tiles(self, span: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, feature) of the benchmark words of passages of ``span`` blocks that follow one another without
        overlap and may reach ``cosine``; rows ascend."""
        at = np.arange(len(self.starts))
        first = np.flatnonzero((at - self.first) % span == 0)
        end = np.minimum(first + span, self.last[first])
        inside, whole = self.inside[end] - self.inside[first], self.all[end] - self.all[first]
        able = (inside > 1e-9) & (inside >= cosine * cosine * whole)
        tile = np.searchsorted(first, self.block, side="right") - 1
        words = np.flatnonzero(self.used & able[tile]) if len(first) else np.zeros(0, np.int64)
        return tile[words], self.number[words]

    def covered(self, passages: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Which blocks are in any of these (first block, end block) passages."""
        change = np.zeros(len(self.starts) + 1, np.int64)
        for first, end in passages:
            change[:-1] += np.bincount(first, minlength=len(self.starts))[: len(self.starts)]
            change -= np.bincount(end, minlength=len(self.starts) + 1)
        return np.cumsum(change[:-1]) > 0

    @staticmethod
    def places(covered: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(covered)])

    def words_in(self, blocks_: np.ndarray) -> np.ndarray:
        """The benchmark words in these blocks (a mask)."""
        return np.flatnonzero(self.used & blocks_[self.block])

    def sums(self, words: np.ndarray, place: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """Running sums over the covered blocks of the rows of ``matrix`` of these words' features.

        ``place``: the number of covered blocks before each block.  A passage's vector is the
        difference of the rows at its ends' places, so every word is projected once, however
        many passages it is in.
        """
        out = np.zeros((int(place[-1]) + 1, matrix.shape[1]), np.float32)
        row, feature = place[self.block[words]], self.number[words]
        new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(row)))
        held = np.empty((512, matrix.shape[1]), np.float32)
        for i in range(0, len(new), 512):  # runs of blocks, so that their rows stay near; those of most words first
            order = np.argsort(-size[i : i + 512], kind="stable") + i
            part, n = new[order], size[order]
            total = matrix.take(feature[part], axis=0)
            for k in range(1, int(n[0])):  # the k-th word of every block that has one
                some = np.count_nonzero(n > k)
                total[:some] += matrix.take(feature[part[:some] + k], axis=0, out=held[:some], mode="clip")
            out[row[part] + 1] = total
        return np.cumsum(out, axis=0, out=out)


def basis(docs: DataFrame, vocabulary, idf: np.ndarray, items: list[np.ndarray], rank: int = RANK, cosine: float = FIT_COSINE, seed: int = 7) -> np.ndarray:
    """features x rank: the leading right singular vectors of the TF-IDF rows.

    One pass sums Z = A'(A S).  With C = S'Z, A'A is near Z C^-1 Z'; its eigenvectors
    are the left singular vectors of Z C^-1/2.
    """
    n = len(idf)
    rank = min(rank, n)
    test = np.random.default_rng(seed).standard_normal((n, rank)).astype(np.float32)
    scaled = test * idf[:, None].astype(np.float32)

    def add(total, feature, vectors, number):
        """Adds to each feature's row the vector of that number."""
        order = np.argsort(feature, kind="stable")
        f = feature[order]
        if len(f):
            start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
            total[f[start]] += np.add.reduceat(vectors[number[order]], start, axis=0)

    def part(batches):
        v, total = vocabulary.value, np.zeros((n, rank), np.float32)
        for batch in batches:
            for s in slices(batch, "text", 1 << 18):
                p = Passages(folded_words(s.column("text")), v, idf)
                row, feature = p.tiles(SPANS[1], cosine)
                if len(row):
                    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    y = np.add.reduceat(scaled[feature], new, axis=0)  # A S
                    add(total, feature, y, np.repeat(np.arange(len(new)), np.diff(np.append(new, len(row)))))
        return total

    z = _reduced(docs, part, (n, rank))
    own = np.zeros((n, rank), np.float32)
    for x in items:
        add(own, x, scaled[x].sum(axis=0)[None, :], np.zeros(len(x), np.int64))
    # The items stand for so many passages that together they weigh ITEMS times what the
    # corpus does (by the traces of S'A'A S), or a large corpus would crowd them out.
    z, own = z * idf[:, None], own.astype(np.float64) * idf[:, None]
    z += own * (ITEMS * (test * z).sum() / max((test * own).sum(), 1e-9) + 1)
    c = test.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    keep = values > values.max(initial=0) * 1e-6
    if not keep.any():
        return np.zeros((n, 1), np.float32)
    u, _, _ = np.linalg.svd(z @ (vectors[:, keep] / np.sqrt(values[keep])), full_matrices=False)
    return u.astype(np.float32)


@dataclass
class Item:
    item_id: int | None
    words: list[bytes]
    segments: list[list[bytes]]
    answer: list[bytes]
    #: All words are common: only the item word for word counts.
    common: bool

    def __post_init__(self):
        self.parts, self.answer_parts = Parts(self.segments), Parts([self.answer])
        self.key = (self.item_id, b" ".join(self.words) if self.item_id is None else b"")

    @classmethod
    def of(cls, item_id: int | None, text: str, common: bool) -> Item:
        return cls(item_id, words_in(text), segments_of(text), answer_of(text), common)

    @property
    def margin(self) -> int:
        """Words beside the item's place that are searched too."""
        return max(BLOCK, len(self.words) // 8)


def pieces(n: int) -> list[tuple[int, int]]:
    """(first, end) of the pieces of an item of n words that are looked up; the last ends with the item."""
    most = SPANS[-1] * BLOCK
    return [(min(a, max(0, n - most)), min(n, a + most)) for a in range(0, max(n, 1), most)]


def sentences_of(text: str) -> list[list[bytes]]:
    return [w for x in re.split(r"(?<=[.!?])\s+|\n+", text) if (w := words_in(x))]


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence of three words or more (of the whole text if there is none)."""
    return next((s for s in reversed(sentences_of(text)) if len(s) >= 3), words_in(text))


def segments_of(text: str) -> list[list[bytes]]:
    """The item's sentences, those of over ``SEGMENT`` words cut evenly: parts that may change places."""
    out = []
    for s in sentences_of(text):
        k = -(-len(s) // SEGMENT)
        out += [s[i * len(s) // k : (i + 1) * len(s) // k] for i in range(k)]
    return out


class Parts:
    """An item's segments, by word the bits of its places in them: a zero bit ends each, and stops its carry."""

    def __init__(self, segments: list[list[bytes]]):
        self.where: dict[bytes, int] = {}
        #: In how many segments each word is: by no more does it lengthen their common subsequences.
        self.segments = Counter(x for a in segments for x in set(a))
        self.full, at = 0, 0
        for a in segments:
            for x in a:
                self.where[x] = self.where.get(x, 0) | 1 << at
                self.full |= 1 << at
                at += 1
            at += 1

    def most(self, b: list[bytes]) -> int:
        """What these words add at most to the common subsequences."""
        return sum(map(self.segments.get, b, repeat(0)))

    def common(self, b: list[bytes]) -> int:
        """Sum of the lengths of the longest common subsequences of every segment and ``b``.

        One integer operation per word of ``b`` for all segments.
        """
        v = full = self.full
        for m in filter(None, map(self.where.get, b)):
            u = v & m
            v = ((v + u) | (v - u)) & full
        return full.bit_count() - v.bit_count()


def common_subsequence(segments: list[list[bytes]], b: list[bytes]) -> int:
    """Sum of the lengths of the longest common subsequences of every segment and ``b``."""
    return Parts(segments).common(b)


class Grams:
    """Runs of ``GRAM`` words of the items: by hash, the items and their places there."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.length = np.array([len(i.words) for i in items], np.int64)
        self.margin = np.array([i.margin for i in items], np.int64)
        w = words_of(pa.array([b" ".join(i.words) for i in items], pa.binary()), hashes_by_eight)
        starts, item = runs(w.first, GRAM)
        key, place = window_hashes(w.hash, starts, GRAM), starts - w.first[item]
        order = np.lexsort((place, item, key))
        key, item, place = key[order], item[order], place[order]
        # One row for each run and item, with its first and last place in the item.
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (item[1:] != item[:-1])])[: len(key)])
        last = np.append(new[1:], len(key))[: len(new)] - 1
        key, item, first, last = key[new], item[new], place[new], place[last]
        _, group, count = np.unique(key, return_inverse=True, return_counts=True)
        order = np.lexsort((count[group], item))
        rank = np.empty(len(key), np.int64)
        rank[order] = np.arange(len(key)) - np.searchsorted(item[order], item[order])
        keep = (count[group] <= FEW) | (rank < LEAST_GRAMS)
        self.known, self.item, self.first, self.last = Vocabulary(key[keep]), item[keep], first[keep], last[keep]
        self.bounds = np.append(np.searchsorted(key[keep], self.known.hashes), keep.sum())

    def candidates(self, w: Words) -> Iterator[tuple[int, int, int, Item, float]]:
        """(text, first word, end word, item, 0.0) of every place where a run of an item stands."""
        starts, text = runs(w.first, GRAM)
        number = self.known.number(window_hashes(w.hash, starts, GRAM))
        some = np.flatnonzero(number >= 0)
        begin, size = self.bounds[number[some]], self.bounds[number[some] + 1] - self.bounds[number[some]]
        hit = np.repeat(some, size)
        row = np.arange(len(hit)) - np.repeat(np.cumsum(size) - size - begin, size)
        item = self.item[row]
        low, high = starts[hit] - self.last[row], starts[hit] - self.first[row] + self.length[item]
        # Runs of one copy point to one place, which is checked once.
        t, i, a, b = np.unique(np.stack([text[hit], item, low // BLOCK, high // BLOCK], axis=1), axis=0).T
        low = np.maximum(w.first[t], a * BLOCK - self.margin[i])
        high = np.minimum(w.first[t + 1], (b + 1) * BLOCK + self.margin[i])
        for t, low, high, i in zip(t.tolist(), low.tolist(), high.tolist(), i.tolist(), strict=True):
            yield t, low, high, self.items[i], 0.0


class Index:
    """Benchmark items, their latent vectors and the projection of words."""

    def __init__(self, vocabulary: Vocabulary, idf: np.ndarray, vectors: np.ndarray, rows: list[tuple[int | None, str]]):
        self.vocabulary, self.idf = vocabulary, idf
        self.project = (vectors * idf[:, None]).astype(np.float32)
        #: By span: the item and the place of each piece.
        self.items: dict[int, list[tuple[Item, int]]] = {s: [] for s in SPANS}
        found, rows_of_span = [], {s: [] for s in SPANS}
        for item_id, text in rows:
            found_words = folded_words(pa.array([text]))
            number = vocabulary.number(found_words.hash)
            item = Item.of(item_id, text, not (idf[number] > 0).any())
            words = item.words
            found.append(item)
            for low, high in pieces(len(words)):
                norm = float(np.sqrt((idf[number[low:high]] ** 2).sum()))
                if norm > 0:
                    span = next((s for s in SPANS if s * BLOCK >= high - low), SPANS[-1])
                    vector = self.project[number[low:high]].sum(axis=0) / norm
                    # The cosine of the item's own copy, which scales those of all passages.
                    own = min(1.0, max(KEPT, float(vector @ vector)))
                    self.items[span].append((item, low))
                    rows_of_span[span].append(vector / own)
        self.grams = Grams(found)
        self.matrix = {s: np.array(v, np.float32).T for s, v in rows_of_span.items() if v}
        # Fewer items than dimensions: words go to the items' axes at once, and no product is left.
        self.columns: dict[int, slice] = {}
        if self.matrix and sum(m.shape[1] for m in self.matrix.values()) <= self.project.shape[1]:
            ends = np.cumsum([0] + [m.shape[1] for m in self.matrix.values()])
            self.columns = {s: slice(a, b) for s, a, b in zip(self.matrix, ends[:-1].tolist(), ends[1:].tolist(), strict=True)}
            self.project = self.project @ np.concatenate(list(self.matrix.values()), axis=1)

    def candidates(self, w: Words, cosine: float) -> Iterator[tuple[int, int, int, Item, float]]:
        """(text, first word, end word, item, cosine) of every passage near an item."""
        p = Passages(w, self.vocabulary, self.idf)
        able = {span: p.able(span, cosine) for span in self.matrix}
        covered = p.covered([x[:2] for x in able.values()])
        at_block = p.places(covered)
        upto = p.sums(p.words_in(covered), at_block, self.project)
        for span, matrix in self.matrix.items():
            first, end, norm2 = able[span]
            lengths, margins, places = (np.array(x, np.int64) for x in zip(*[(len(i.words), i.margin, place) for i, place in self.items[span]], strict=True))
            for i in range(0, len(first), 4000):
                f, e = first[i : i + 4000], end[i : i + 4000]
                own = upto[:, self.columns[span]] if self.columns else upto
                total = own[at_block[e]] - own[at_block[f]]
                cosines = (total if self.columns else total @ matrix) / np.sqrt(norm2[i : i + 4000]).astype(np.float32)[:, None]
                row, column = np.divmod(np.flatnonzero((cosines >= cosine).ravel()), cosines.shape[1])
                at = f[row]
                text, start = p.text[at], p.starts[at] - places[column]
                low = np.maximum(w.first[text], start - margins[column])
                high = np.minimum(w.first[text + 1], start + np.maximum((span + 1) * BLOCK, lengths[column] + margins[column]))
                close = np.minimum(1.0, cosines[row, column].astype(np.float64))
                for t, a, b, k, x in zip(text.tolist(), low.tolist(), high.tolist(), column.tolist(), close.tolist(), strict=True):
                    yield t, a, b, self.items[span][k][0], x
        yield from self.grams.candidates(w)


def answered(item: Item, around: list[bytes]) -> float:
    """The share of the words of the item's answer in these."""
    return item.answer_parts.common(around) / len(item.answer)


def parts_of(benchmark: DataFrame, most: int = PART_BYTES) -> list[list[tuple[int | None, str]]]:
    """The rows of ``benchmark`` in parts of about ``most`` bytes of text, each collected on its own."""
    rows = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty().alias("text")), "benchmark")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = -(-size // most) or 1
    placed = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    return [[(r.item_id, r.text) for r in placed.filter(F.col("part") == i).select("item_id", "text").orderBy("item_id", "text").collect()] for i in range(n)]


def build_index(docs: DataFrame, rows: list[tuple[int | None, str]], rank: int = RANK, fit_cosine: float = FIT_COSINE) -> Index:
    """The index of one part of a benchmark: (item_id, text) rows.

    The space is fitted on the passages that may reach ``fit_cosine`` with an item (0 for all).
    """
    words = folded_words(pa.array([t for _, t in rows], pa.string()))
    vocabulary = Vocabulary(words.hash)
    if not len(vocabulary.hashes):
        return Index(vocabulary, np.zeros(0), np.zeros((0, 1), np.float32), [])
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)
    counts, passages = passage_counts(docs, held)
    # A word in over a tenth of all blocks, and in more than COMMON, tells nothing about which item a passage is.
    idf = np.where(counts > 0.1 * passages + COMMON, 0.0, np.log(1 + (1 + passages) / (1 + counts)))
    number = vocabulary.number(words.hash)
    items = [number[a + low : a + high] for a, b in zip(words.first[:-1], words.first[1:], strict=True) for low, high in pieces(b - a)]
    return Index(vocabulary, idf, basis(docs, held, idf, items, rank, fit_cosine), rows)


ADDED = ("contaminated", "item_id", "cosine", "lcs_share", "answer_share", "n_items")
SCHEMA = "contaminated boolean, item_id long, cosine double, lcs_share double, answer_share double, n_items integer"


def search(docs: DataFrame, index: Index, cosine: float = COSINE) -> DataFrame:
    """``docs`` with the verdict and its strongest item (null, zeros and false without a candidate).

    Columns of ``docs`` of the names in ``SCHEMA`` are replaced.
    """
    names = [c for c in docs.columns if c not in {x.split()[0] for x in SCHEMA.split(", ")}]
    held = docs.sparkSession.sparkContext.broadcast(index)
    extra = [x.split()[0] for x in SCHEMA.split(", ")]

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = held.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 18):
                w = folded_words(part.column("text"))
                best: list[tuple | None] = [None] * part.num_rows
                hits: list[set] = [set() for _ in range(part.num_rows)]
                known: tuple | None = None
                #: By text and item: a place, and what its common subsequences have at most.
                reach: dict[tuple[int, int], tuple[int, int, int]] = {}
                for text, low, high, item, close in ix.candidates(w, cosine):
                    if item.key in hits[text]:
                        continue
                    strongest, before = best[text], reach.get((text, id(item)))
                    if strongest and before and low >= before[0]:
                        # Words after the last place add so much at most; what can neither decide nor be the strongest goes.
                        after = max(low, before[1])
                        upto = before[2] + (item.parts.most(w.text(after, high).split()) if high > after else 0)
                        if upto / len(item.words) < min(strongest[1], LEAST_SHARE):
                            reach[text, id(item)] = (low, max(high, before[1]), upto)
                            continue
                    if known is None or known[:2] != (low, high):
                        known = (low, high, w.text(low, high).split())
                    around = known[2]
                    if item.common and b" " + b" ".join(item.words) + b" " not in b" " + b" ".join(around) + b" ":
                        continue
                    common = item.parts.common(around)
                    reach[text, id(item)] = (low, high, common)
                    share, answer = common / len(item.words), None
                    bad = share >= LCS or (close > 0 and share >= PARAPHRASE)
                    if not bad and close > 0 and share >= ANSWERED:
                        answer = answered(item, around)
                        bad = answer >= ANSWER
                    if bad:
                        hits[text].add(item.key)
                    found = (bad, share, close, item.item_id is not None, -(item.item_id or 0))
                    if strongest is None or found >= strongest[:5]:
                        found += (answered(item, around) if answer is None else answer, item.item_id)
                        if strongest is None or found[:6] > strongest[:6]:
                            best[text] = found
                columns = list(zip(*[(b[0], b[6], b[2], b[1], b[5], len(h)) if b else (False, None, 0.0, 0.0, 0.0, 0) for b, h in zip(best, hits, strict=True)], strict=True))
                kinds = [pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names + extra)

    schema = docs.select(*names).schema
    for field in SCHEMA.split(", "):
        schema = schema.add(*field.split())
    return docs.select(*names).mapInArrow(check, schema)


#: Which of a document's candidates is the strongest; of equal ones that of the least item_id.
STRENGTH = ("contaminated", "lcs_share", "cosine", "item_id IS NOT NULL", "coalesce(-item_id, 0)", "answer_share")


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """``docs`` (with text) and the verdict over the whole benchmark, in parts of ``most`` bytes.

    With several parts the rows are numbered in one stored table, and each part's search
    gives only the numbers of the rows with candidates; their strongest joins the rows again.
    """
    parts = parts_of(benchmark, most)
    if len(parts) == 1:
        return search(docs, build_index(docs.select("text"), parts[0]))
    names = [c for c in docs.columns if c not in ADDED]
    rows = stored(docs.select(F.struct(*names).alias("_doc"), "text", F.monotonically_increasing_id().alias("_number")), "leaks-rows")
    candidate = "item_id IS NOT NULL OR n_items > 0 OR cosine > 0 OR lcs_share > 0"
    found = None
    for part in parts:
        some = stored(search(rows.select("_number", "text"), build_index(rows.select("text"), part)).filter(candidate).drop("text"), "leaks-part")
        found = some if found is None else found.unionByName(some)
    strongest = F.max_by(F.struct(*ADDED), F.struct(*map(F.expr, STRENGTH))).alias("_best")
    best = found.groupBy("_number").agg(strongest, F.sum("n_items").cast("int").alias("_n"))
    absent = {"contaminated": F.lit(False), "item_id": F.lit(None).cast("long"), "n_items": F.lit(0)}
    verdict = [F.coalesce(F.col("_n" if c == "n_items" else f"_best.{c}"), absent.get(c, F.lit(0.0))).alias(c) for c in ADDED]
    return rows.join(best, "_number", "left").select("_doc.*", *verdict)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    return contaminated(docs, table(spark, sf_dir, "benchmark")).drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), text_or_empty().alias("text"))
    return contaminated(packed, benchmark).filter("NOT contaminated").select("_row.*")


QUERIES = {"op10_decontamination": op10_decontamination}
ORACLES: dict[str, str] = {}
