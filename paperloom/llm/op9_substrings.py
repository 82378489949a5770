"""Removal of repeated passages, decided by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document; every word of a window whose
word sequence also starts anywhere else goes.  Windows are judged on the input.

Routing.  Each window has an anchor: the least hash among its runs of ``RUN`` words
(leftmost of equals).  Neighbouring windows with one anchor form a piece, at most
``WINDOW - RUN + 1`` windows.  Equal windows have equal anchors, so windows of different
anchors never match, each window is in exactly one piece, and an anchor that occurs once
in the corpus proves its piece unique.  Only anchors that recur go on.

Matching.  The distinct pieces of an anchor, with the number of their occurrences, are
one reference shard.  Its suffix automaton over words carries for every state how often
its strings occur; the pieces are streamed through it, and a window is repeated if the
state of its ``WINDOW``-word match occurs twice or more.  Windows are compared as words
there; only pieces, which must be equal whole to count as one, are told apart by 64-bit
hashes of their words (two of ten million differ and agree with a probability under 1e-5).
A shard goes to one task and is not broadcast to all, because the reference is the corpus
itself and only pieces of the same anchor can match.

Hot anchors.  Pieces at the edge of a passage that very many documents share differ in
their outer words.  An anchor with more than ``SHARD`` distinct pieces first loses, by a
combining sum over window hashes, the windows that occur once (a hash that two windows
share only keeps them for the automaton).  What is left is cut again by a second anchor,
under other hashes, and so on while a group has over ``SHARD`` distinct pieces: windows of
different second anchors don't match either.  After ``CUTS`` anchors what is still larger
is decided by counting its windows' words, so that no shard exceeds its bound.

Defined cases: null text is empty and has no words; texts shorter than a window keep all
words; repeated rows are occurrences of their own, so all their windows repeat; rows of
a null doc_id are judged like others; whole texts are read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, shuffle_partitions, stored, table, text_or_empty
from .words import U, Words, hashes_of, mix, slices, window_hashes, words_of

WINDOW, RUN = 35, 8
#: Distinct pieces of one reference shard at most: about 100,000 words, so an automaton of some 50 MB.
SHARD = 2048
#: Anchors by which a hot group is cut.
CUTS = 4
#: Bits of an anchor's order and of a word's place in a batch, packed in one number.
PLACE_BITS = 26


def pieces(w: Words, width: int = WINDOW, run: int = RUN, seed: int = 0) -> tuple[np.ndarray, ...]:
    """(text, first window, windows, anchor, content hash) of every piece of a batch."""
    n, span = len(w.start), width - run + 1
    none = np.zeros(0, np.int64)
    counts = np.maximum(np.diff(w.first) - (width - 1), 0)
    if not counts.sum():
        return none, none, none, none.astype(U), none.astype(U)
    if n >> PLACE_BITS:
        raise ValueError(f"a text of {n} words")
    kmer = window_hashes(w.hash, np.arange(n - run + 1), run, seed)
    place = np.arange(len(kmer), dtype=U)
    low = (kmer >> U(PLACE_BITS) << U(PLACE_BITS)) | place
    size = 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < span:
        low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
    text = np.repeat(np.arange(len(counts)), counts)
    start = w.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = (low[start] & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (text[1:] != text[:-1])]))
    windows = np.diff(np.append(new, len(text)))
    first = start[new]
    content = mix(hashes_of(w.hash, first, first + windows + width - 1) + windows.astype(U))
    return text[new], first, windows, kmer[at[new]], content


def row_key(column: str = "text"):
    """60 bits of the text's MD5: with the doc_id it names a row."""
    return F.conv(F.substring(F.md5(text_or_empty(column)), 1, 15), 16, 10).cast("long")


def anchored(docs: DataFrame, width: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, t, pos (first word), n (windows), anchor and piece of every piece of every text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                text, first, n, anchor, content = pieces(w, width, run)
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("t").take(rows), pa.array((first - w.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc_id", "t", "pos", "n", "anchor", "piece"],
                )

    return docs.select("doc_id", row_key().alias("t"), text_or_empty().alias("text")).mapInArrow(read, "doc_id long, t long, pos int, n int, anchor long, piece long")


class SuffixAutomaton:
    """A suffix automaton of several word sequences, with weighted counts of occurrences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, words: list[bytes], weight: int) -> None:
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for c in words:
            known = nxt[last].get(c)
            if known is not None:  # of an earlier sequence
                if length[known] == length[last] + 1:
                    last = known
                else:
                    last = self._split(last, known, c)
                count[last] += weight
                continue
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            count.append(weight)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = cur

    def _split(self, p: int, q: int, c: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(nxt[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        self.count.append(0)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def finish(self) -> None:
        """Sums the counts up the suffix links: a state occurs wherever a longer one does."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list[bytes], width: int) -> list[bool]:
        """For every window of the sequence: does it occur twice or more in the reference?"""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state = size = 0
        out = []
        for i, c in enumerate(words):
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                size += 1
            while state and length[link[state]] >= width:  # the state that holds the window itself
                state = link[state]
                size = length[state]
            if i >= width - 1:
                out.append(size >= width and count[state] >= 2)
        return out


def judged(shards: DataFrame, width: int = WINDOW) -> DataFrame:
    """(anchor, piece, mask): bit i set if the piece's window i is repeated.

    ``shards``: anchor, piece, first (the first window's number in its piece), n, c
    (occurrences) and words, all rows of an anchor in one partition and in a row.
    """

    def shard(rows: list[tuple]) -> list[tuple[int, int, int]]:
        split = [(*r[:5], r[5].split()) for r in rows]
        if len(split) == 1:  # a lone piece matches itself, whole
            anchor, piece, first, n, c, _ = split[0]
            return [(anchor, piece, ((1 << n) - 1) << first if c >= 2 else 0)]
        automaton = SuffixAutomaton()
        weights: dict[tuple[bytes, ...], int] = {}
        for *_, c, words in split:
            key = tuple(words)
            weights[key] = weights.get(key, 0) + c
        for words, c in weights.items():
            automaton.add(list(words), c)
        automaton.finish()
        verdicts = {words: sum(1 << i for i, x in enumerate(automaton.repeated(list(words), width)) if x) for words in weights}
        return [(anchor, piece, verdicts[tuple(words)] << first) for anchor, piece, first, _, _, words in split]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple[int, int, int]] = []
        names = ("anchor", "piece", "first", "n", "c")
        for batch in batches:
            words = batch.column("words").cast(pa.binary()).to_pylist()
            for row in zip(*(batch.column(c).to_pylist() for c in names), words, strict=True):
                if held and held[0][0] != row[0]:
                    done += shard(held)
                    held = []
                held.append(row)
            if len(done) > 10_000:
                yield rows_of(done)
                done = []
        if held:
            done += shard(held)
        if done:
            yield rows_of(done)

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], ["anchor", "piece", "mask"])

    return shards.select("anchor", "piece", "first", "n", "c", "words").mapInArrow(run, "anchor long, piece long, mask long")


def _trimmed(hot: DataFrame, width: int = WINDOW) -> DataFrame:
    """Runs of windows of hot anchors' pieces whose hash occurs twice or more, as pieces of their own."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column("words"))
            counts = np.maximum(np.diff(w.first) - width + 1, 0)
            row = np.repeat(np.arange(len(counts)), counts)
            off = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            h = window_hashes(w.hash, w.first[:-1][row] + off, width)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column("anchor").take(take), batch.column("piece").take(take), pa.array(off.astype(np.int32)), pa.array(h.view(np.int64)), batch.column("c").take(take)], ["anchor", "piece", "off", "h", "c"])

    rows = stored(hot.select("anchor", "piece", "c", "words").mapInArrow(windows, "anchor long, piece long, off int, h long, c long"), "substring-windows")
    # Stored, so that the join is of two plain exchanges and Spark can split a hot window.
    again = stored(rows.groupBy("anchor", "h").agg(F.sum("c").alias("s")).filter("s > 1").select("anchor", "h"), "substring-twice")
    kept = rows.join(again, ["anchor", "h"]).groupBy("anchor", "piece").agg(F.collect_set("off").alias("offs"))  # 28 at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "piece", "first", "n", "c", "words"]
        for batch in batches:
            out = []
            for anchor, piece, c, words, offs in zip(*(batch.column(x).to_pylist() for x in ("anchor", "piece", "c", "words", "offs")), strict=True):
                split, offs = words.encode().split(), sorted(offs)
                start = 0
                for i in range(len(offs)):
                    if i + 1 == len(offs) or offs[i + 1] != offs[i] + 1:
                        a, b = offs[start], offs[i]
                        out.append((anchor, piece, a, b - a + 1, c, b" ".join(split[a : b + width]).decode()))
                        start = i + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()], strict=True)], names)

    return hot.join(kept, ["anchor", "piece"]).select("anchor", "piece", "c", "words", "offs").mapInArrow(cut, "anchor long, piece long, first int, n int, c long, words string")


def _cut_again(runs: DataFrame, seed: int, width: int = WINDOW) -> DataFrame:
    """``runs`` (anchor, piece, first, n, c, words, group) cut by another anchor, which joins their group; w names their words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words_of(batch.column("words"))
            row, start, n, anchor, content = pieces(w, width, RUN, seed)
            take = pa.array(row)
            first = batch.column("first").to_numpy()[row] + (start - w.first[row])
            group = mix(batch.column("group").to_numpy().view(np.uint64)[row] ^ anchor).view(np.int64)
            words = [w.text(a, a + k + width - 1).decode() for a, k in zip(start.tolist(), n.tolist(), strict=True)]
            columns = [batch.column("anchor").take(take), batch.column("piece").take(take), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), batch.column("c").take(take), pa.array(words, pa.string()), pa.array(group), pa.array(content.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "piece", "first", "n", "c", "words", "group", "w"])

    return runs.select("anchor", "piece", "first", "n", "c", "words", "group").mapInArrow(cut, "anchor long, piece long, first int, n int, c long, words string, group long, w long")


def _counted(runs: DataFrame, width: int = WINDOW) -> DataFrame:
    """(anchor, piece, mask) of runs by counting the words of their windows, combined before the shuffle."""
    words = F.split("words", " ")
    windows = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.array_join(F.slice(words, i + 1, F.lit(width)), " "))
    rows = stored(runs.select("anchor", "piece", "first", "c", F.posexplode(windows).alias("off", "window")), "substring-counted")
    again = stored(rows.groupBy("window").agg(F.sum("c").alias("s")).filter("s > 1").select("window"), "substring-again-windows")
    kept = rows.join(again, "window").groupBy("anchor", "piece").agg(F.bit_or(F.expr("shiftleft(1L, off + first)")).alias("mask"))
    return kept.select("anchor", "piece", "mask")


def candidates(docs: DataFrame, width: int = WINDOW, run: int = RUN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, places, distinct): the rows of ``docs`` with the distinct pieces whose words they
    give; the places of all pieces of recurring anchors; those pieces with their occurrences."""
    every = stored(anchored(docs, width, run), "substring-anchors")
    # Stored, so that the join below is of two plain exchanges and Spark can split a hot anchor.
    again = stored(every.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor"), "substring-again")
    places = stored(every.join(again, "anchor"), "substring-places")
    drop_stored(every)
    # One row per distinct piece, its occurrences, and the first of them to take its words from.
    distinct = stored(places.groupBy("anchor", "piece", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "t", "pos")).alias("rep")), "substring-distinct")
    owned = distinct.groupBy(F.col("rep.doc_id").alias("d_"), F.col("rep.t").alias("t_")).agg(F.collect_list(F.struct(F.col("rep.pos").alias("pos"), "n", "anchor", "piece", "c")).alias("own"))
    some = places.groupBy(F.col("doc_id").alias("d_"), F.col("t").alias("t_")).agg(F.lit(True).alias("some"))
    named = some.join(owned.withColumnsRenamed({"d_": "d2_", "t_": "t2_"}), F.col("d_").eqNullSafe(F.col("d2_")) & (F.col("t_") == F.col("t2_")), "left").drop("d2_", "t2_")
    rows = docs.select("doc_id", row_key().alias("t"), text_or_empty().alias("text"))
    joined = rows.join(named, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("t") == F.col("t_")), "left").select("doc_id", "t", "text", F.coalesce("some", F.lit(False)).alias("some"), "own")
    return joined, places, distinct


def marks_of(held: DataFrame, places: DataFrame, distinct: DataFrame, width: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """d_, t_ and the list of (pos, mask) of the documents with repeated windows.

    ``held``: stored rows (doc_id, t, text, own) of documents that have any piece.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "piece", "n", "c", "words"]
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                out = []
                for i, own in enumerate(part.column("own").to_pylist()):
                    for x in own or ():
                        a = int(w.first[i]) + x["pos"]
                        out.append((x["anchor"], x["piece"], x["n"], x["c"], b" ".join(w.text(a, a + x["n"] + width - 1).split()).decode()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()], strict=True)], names)

    spelled = held.filter("own IS NOT NULL").select("text", "own").mapInArrow(spell, "anchor long, piece long, n int, c long, words string").withColumn("first", F.lit(0))
    sizes = distinct.groupBy("anchor").agg(F.count("*").alias("k"))
    hot = stored(sizes.filter(F.col("k") > shard).select("anchor"), "substring-hot")
    n = max(2, shuffle_partitions(held.sparkSession))
    dealt = lambda x: x.select("anchor", "piece", "first", "n", "c", "words").repartition(n, "anchor").sortWithinPartitions("anchor")
    if hot.isEmpty():
        masks = judged(dealt(spelled), width)
    else:
        spelled = stored(spelled, "substring-spelled")
        left = stored(_trimmed(spelled.join(hot, "anchor"), width).withColumn("group", F.col("anchor")), "substring-trimmed")
        masks = judged(dealt(spelled.join(hot, "anchor", "left_anti")), width)
        for level in range(1, CUTS + 1):
            left = stored(_cut_again(left, level, width), "substring-cut")
            # A run is judged once for all pieces that share it.
            one = stored(left.groupBy("group", "w", "words", "n").agg(F.sum("c").alias("c")), "substring-runs")
            large = stored(one.groupBy("group").agg(F.count("*").alias("k")).filter(F.col("k") > shard).select("group"), "substring-large")
            some = one.join(large, "group", "left_anti")
            verdicts = judged(dealt(some.select(F.col("group").alias("anchor"), F.col("w").alias("piece"), F.lit(0).alias("first"), "n", "c", "words")), width)
            back = left.select("anchor", "piece", "first", "group", "w").join(verdicts.select(F.col("anchor").alias("group"), F.col("piece").alias("w"), "mask"), ["group", "w"])
            masks = masks.unionByName(back.select("anchor", "piece", F.expr("shiftleft(mask, first)").alias("mask")))
            if large.isEmpty():
                left = None
                break
            left = stored(left.join(large, "group").drop("w"), "substring-left")
        if left is not None:
            masks = masks.unionByName(_counted(left, width))
    masks = stored(masks.filter("mask <> 0").groupBy("anchor", "piece").agg(F.bit_or("mask").alias("mask")), "substring-masks")
    found = places.join(masks, ["anchor", "piece"])
    return found.groupBy(F.col("doc_id").alias("d_"), F.col("t").alias("t_")).agg(F.collect_set(F.struct("pos", "mask")).alias("marks"))


def removed(rows: DataFrame, width: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of rows (doc_id, text, marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_removed, digests = [], [], []
                for text, marks in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("marks").to_pylist(), strict=True):
                    words = text.split()
                    keep = words
                    if marks:
                        change = np.zeros(len(words) + 1, np.int64)
                        for m in marks:
                            mask, pos = m["mask"], m["pos"]
                            while mask:
                                low = (mask & -mask).bit_length() - 1
                                change[pos + low] += 1
                                change[pos + low + width] -= 1
                                mask &= mask - 1
                        keep = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(keep))
                    digests.append(hashlib.sha256(b" ".join(keep)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return rows.select("doc_id", "text", "marks").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WINDOW, run: int = RUN, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, words removed and the digest of what is kept."""
    rows, places, distinct = candidates(docs, width, run)
    # Documents without a recurring anchor are done here; only the others' texts are written and met again.
    held = stored(_settled(rows), "substring-held")
    done = held.filter("NOT some").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    open_ = held.filter("some").select("doc_id", "t", "text", "own")
    marks = marks_of(open_, places, distinct, width, shard)
    rest = open_.drop("own").join(marks, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("t") == F.col("t_")), "left").select("doc_id", "text", "marks")
    return removed(rest, width).unionByName(done)


def _settled(rows: DataFrame) -> DataFrame:
    """Rows without candidates get their digest and lose their text; the others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "t", "some", "own", "text", "n_words", "kept_sha256"]
        for batch in batches:
            for part in slices(batch, "text", 4 << 20):
                some = part.column("some").to_pylist()
                texts, n_words, digests = [], [], []
                for text, more in zip(part.column("text"), some, strict=True):
                    words = () if more else text.as_buffer().to_pybytes().split()
                    texts.append(text.as_py() if more else None)
                    n_words.append(None if more else len(words))
                    digests.append(None if more else hashlib.sha256(b" ".join(words)).hexdigest())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(digests, pa.string())], names)

    own = "array<struct<pos:int,n:int,anchor:long,piece:long,c:long>>"
    return rows.select("doc_id", "t", "some", "own", "text").mapInArrow(run, f"doc_id long, t long, some boolean, own {own}, text string, n_words long, kept_sha256 string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op9_substring_dedup": op9_substring_dedup}
ORACLES: dict[str, str] = {}
