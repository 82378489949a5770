"""Phrase collocations by PCY/DHP passes: hashed bucket counts of the next length, then exact counts.

Pass j reads all texts once.  It counts, exactly, the phrases of j words that may be
frequent, and counts in ``BUCKETS`` hashed buckets the phrases of j + 1 words whose two
parts of j words may be.  Two bitmaps of fixed size go to every task of the next pass: the
buckets that reached the bound, and the hashes of the phrases that were found frequent.
A phrase is counted exactly only if its bucket's bit and the bits of its two shorter parts
are set, so neither bitmap can lose a frequent phrase; what they let through in vain is
dropped by its exact count.  Bitmaps don't grow with the corpus (2 MB each), so a larger
one only makes them let more through.

Counts are joined within a slice of text by exact numbers of words, then by Spark before
the shuffle, so a phrase costs each task one row however often it occurs.

Words, pieces and languages: A-Z become lower case; texts are cut into pieces at
``[.,;:!?]`` and at line ends (0x0A-0x0D), pieces into words at spaces and tabs; phrases
don't cross pieces.  All counts are by language.

Defined cases: a null language is ``und``, which it shares with rows that say so; null,
empty and blank texts have no words; repeated rows and doc_ids count as often as they
occur; a language without a candidate has no row; other columns are not read; an empty
table gives no rows.  Equal scores are ordered by count, then by the phrase's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, shuffle_partitions, stored, table, text_or_empty
from .words import SPACE, U, mix, words_of

LEAST, LONGEST, TOP, SHARE = 30, 4, 2000, 80
#: Hashed buckets, a bit each in a bitmap; and the buckets of a row of counts.
BUCKETS, BLOCK = 1 << 24, 1 << 16
SLICE_BYTES = 1 << 22
#: Bytes as they are counted: A-Z in lower case, marks that end a piece as line ends.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 0x20
_FOLD[list(b".,;:!?")] = 0x0A
_BREAK = np.zeros(256, bool)
_BREAK[0x0A:0x0E] = True


def pieces(batch: pa.RecordBatch, max_bytes: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(langs, folded texts) of a batch in runs of about ``max_bytes``; longer texts are cut after a piece."""
    texts, langs = batch.column("text").cast(pa.large_binary()), batch.column("lang")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    if not len(texts) or raw is None:
        return
    data = np.frombuffer(raw, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= max_bytes:
            yield langs.slice(i, j - i), _binary(_FOLD[data[low:high]], offsets[i : j + 1] - low)
        else:  # one long text
            while low < high:
                end = min(high, low + max_bytes)
                while end < high and not (cuts := _BREAK[_FOLD[data[end : min(high, end + max_bytes)]]]).any():
                    end = min(high, end + max_bytes)
                end = end + int(cuts.argmax()) + 1 if end < high else high
                yield langs.slice(i, 1), _binary(_FOLD[data[low:end]], np.array([0, end - low]))
                low = end
        i = j


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])


def _lang_hash(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one word more."""
    return mix((hashes ^ words) * U(0xD6E8FEB86659FD93) + U(1))


class Phrases:
    """The words of a run of texts: exact numbers, hashes by language, and where phrases may stand."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        w = words_of(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        known = langs.dictionary_encode()
        self.names, code = known.dictionary, known.indices.to_numpy(zero_copy_only=False)
        self.lang, self.word_hash, self.n = code[doc].astype(np.int64), w.hash, len(w.hash)
        seeds = np.array([_lang_hash(x) for x in self.names.to_pylist()], U)
        self.hash = mix(w.hash + seeds[self.lang]) if self.n else w.hash
        ends = np.cumsum(_BREAK[w.data])
        piece = ends[w.start] if self.n else np.zeros(0, np.int64)
        self.joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        words = _binary(w.data[~SPACE[w.data]], np.concatenate([[0], np.cumsum(w.end - w.start)])).dictionary_encode()
        self.words, self.word = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1, 2... words: hashes of the phrases from each word on, and whether they are in one piece."""
        hashes, whole = self.hash, np.ones(self.n, bool)
        for more in range(1, self.n + 1):
            yield hashes, whole
            hashes, whole = _longer(hashes[:-1], self.word_hash[more:]), whole[:-1] & self.joined[more - 1 :]

    def counts(self, starts: np.ndarray, length: int) -> pa.RecordBatch:
        """lang, phrase and n of the phrases at ``starts``."""
        key = self.lang[starts]
        for k in range(length):
            key = np.unique(key * (len(self.words) + 1) + self.word[starts + k], return_inverse=True)[1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = starts[first]
        phrase = pc.binary_join_element_wise(*[self.words.take(pa.array(self.word[at + k])) for k in range(length)], pa.scalar(b" ", pa.large_binary()))
        return pa.RecordBatch.from_arrays([self.names.take(pa.array(self.lang[at])), phrase.cast(pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> U(65 - buckets.bit_length())).astype(np.int64)


class Bitmap:
    """A bit for each bucket; without bytes, all are set."""

    def __init__(self, packed: bytes | None = None):
        self.bits = np.unpackbits(np.frombuffer(packed, np.uint8)).view(bool) if packed else None

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return np.ones(len(hashes), bool) if self.bits is None else self.bits[_bucket(hashes, len(self.bits))]


def _blocks(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows block, at (places in it, 16 bits each) and times (8 bits each) of buckets that are not 0."""
    for block in range(0, len(counts), BLOCK):
        part = counts[block : block + BLOCK]
        at = np.flatnonzero(part)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([block // BLOCK], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([part[at].tobytes()], pa.binary())], ["block", "at", "times"])


def _add(counts: np.ndarray, buckets: np.ndarray, most: int) -> None:
    """Counts ``buckets`` into the 8-bit ``counts``, which stop at ``most``."""
    at, n = np.unique(buckets, return_counts=True)
    counts[at] = np.minimum(counts[at] + n, most).astype(np.uint8)


def bitmap_of(rows: DataFrame, least: int, buckets: int = BUCKETS) -> bytes:
    """The packed bits of the buckets whose times reach ``least`` in all.

    Rows of one block meet in one task, sorted, and are added as they stream by.  What
    comes to the driver is a bit for each bucket.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = -1, np.zeros(BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, at, times in zip(*[batch.column(c).to_pylist() for c in ("block", "at", "times")], strict=True):
                if block != now:
                    if now >= 0:
                        yield done()
                    now = block
                    sums[:] = 0
                sums[np.frombuffer(at, "<u2")] += np.frombuffer(times, np.uint8)
        if now >= 0:
            yield done()

    n = max(2, min(buckets // BLOCK, shuffle_partitions(rows.sparkSession)))
    dealt = rows.select("block", "at", "times").repartition(n, "block").sortWithinPartitions("block")
    found = dealt.mapInArrow(total, "block int, bits binary").collect()
    packed = np.zeros(max(buckets, BLOCK) // 8, np.uint8)
    for row in found:
        packed[row.block * BLOCK // 8 : (row.block + 1) * BLOCK // 8] = np.frombuffer(row.bits, np.uint8)
    return packed[: buckets // 8].tobytes()


_PASS = "lang string, phrase string, n long, block int, at binary, times binary"


def _padded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The columns of a pass, null where ``batch`` has none."""
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int32(), "at": pa.binary(), "times": pa.binary()}
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(k).cast(t) if k in have else pa.nulls(batch.num_rows, t) for k, t in kinds.items()], list(kinds))


def one_pass(texts: DataFrame, length: int, frequent, full, least: int, last: bool, buckets: int = BUCKETS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Counts of phrases of ``length`` words (lang, phrase, n) and the bucket rows of the next length.

    ``texts``: lang and text.  ``frequent`` and ``full``: broadcast bitmaps of the phrases
    one word shorter and of the buckets of this length (None in the first pass, which also
    counts all words of a language, as rows with a null phrase).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = Bitmap(frequent.value if frequent else None)
        filled = Bitmap(full.value if full else None)
        counts = np.zeros(0 if last else buckets, np.uint8)
        for batch in batches:
            for langs, folded in pieces(batch, slice_bytes):
                p = Phrases(langs, folded)
                shorter = None
                for k, (hashes, whole) in enumerate(p.runs(), 1):
                    if k == length - 1:
                        shorter = parts.has(hashes) & whole
                    elif k == length:
                        may = whole & filled.has(hashes)
                        if shorter is not None:
                            may &= shorter[:-1] & shorter[1:]
                        starts = np.flatnonzero(may)
                        if len(starts):
                            yield _padded(p.counts(starts, length))
                        if length == 1:
                            each = np.bincount(p.lang, minlength=len(p.names))
                            yield _padded(pa.RecordBatch.from_arrays([p.names, pa.array(each.astype(np.int64))], ["lang", "n"]))
                        if last:
                            break
                    elif k == length + 1:
                        _add(counts, _bucket(hashes[whole & may[:-1] & may[1:]], buckets), max(1, min(255, least)))
                        break
        if not last:
            yield from map(_padded, _blocks(counts))

    return texts.mapInArrow(run, _PASS)


def _bits_of_phrases(level: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Bucket rows of the phrases of ``level``, each counted once or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint8)
        for batch in batches:
            w = words_of(batch.column("phrase"))
            seeds = {x: _lang_hash(x) for x in batch.column("lang").unique().to_pylist()}
            lang = np.array([seeds[x] for x in batch.column("lang").to_pylist()], U)
            at, size = w.first[:-1], np.diff(w.first)
            hashes = mix(w.hash[at] + lang)
            for k in range(1, int(size.max(initial=0))):
                more = size > k
                hashes[more] = _longer(hashes[more], w.hash[at[more] + k])
            counts[_bucket(hashes, buckets)] = 1
        yield from _blocks(counts)

    return level.mapInArrow(run, "block int, at binary, times binary")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS, slice_bytes: int = SLICE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words with at least ``least`` occurrences: (lang, phrase, words, f), and (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    levels, totals, frequent, full = None, None, None, None
    for length in range(1, longest + 1):
        last = length == longest
        found = stored(one_pass(texts, length, frequent, full, least, last, buckets, slice_bytes), f"phrases-{length}")
        level = stored(found.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least), f"frequent-{length}")
        if length == 1:
            totals = stored(found.filter("phrase IS NULL AND block IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
        if not last:
            bits = bitmap_of(_bits_of_phrases(level, buckets), 1, buckets), bitmap_of(found.filter("block IS NOT NULL"), least, buckets)
            frequent, full = (spark.sparkContext.broadcast(b) for b in bits)
        drop_stored(found)
        level = level.withColumn("words", F.lit(length))
        levels = level if levels is None else levels.unionByName(level)
    return levels, totals


def _wide(column):
    return F.col(column).cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE, **sizes) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of every language's first ``top`` phrases.

    ``sizes``: buckets (a power of 2) and slice_bytes; they don't change the result.
    """
    levels, totals = phrase_counts(docs, least, longest, **sizes)
    known = levels.select("lang", "phrase", "f")
    found = levels.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    def part(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    # Every cut of a phrase, met with the counts of its two parts; both are frequent, as the phrase is.
    cuts = found.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("_right"))
    lefts = known.withColumnsRenamed({"phrase": "_left", "f": "l"})
    rights = known.withColumnsRenamed({"phrase": "_right", "f": "r"})
    sided = stored(cuts.join(lefts, ["lang", "_left"]).select("lang", "phrase", "a", "k", "_right", "l"), "phrase-lefts")
    scored = sided.join(rights, ["lang", "_right"]).withColumn("score", F.expr(f"CAST({2_000_000} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("s")).select("lang", "phrase", "s.a", "s.l", "s.r", "s.score")
    # A phrase goes if a longer candidate around it has nearly all its occurrences: only the most frequent one matters.
    inner = found.filter("words > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)).alias("at"))
    around = inner.select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_around"))
    kept = lowest.join(around, ["lang", "phrase"], "left").filter(F.col("_around").isNull() | (100 * _wide("_around") < share * _wide("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    # Spark keeps the first rows of every task before it deals them by language.
    ranked = kept.select("lang", "phrase", "a", "l", "r", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle() -> str:
    grams = "\nUNION ALL ".join(f"SELECT lang, array_to_string(w[i : i + {k - 1}], ' ') AS phrase, {k} AS words FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM p WHERE len(w) >= {k})" for k in range(1, LONGEST + 1))
    return rf"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
g AS ({grams}),
f AS (SELECT lang, phrase, words, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
c AS (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1),
k AS (SELECT *, unnest(range(1, words)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, (2000000 * k.a::HUGEINT // (x.f + y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ')
         JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, w, unnest(range(2, words)) AS size FROM c WHERE words > 2),
j AS (SELECT lang, a, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM i),
o AS (SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS around FROM j GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.around IS NULL OR 100 * o.around::HUGEINT < {SHARE} * b.a::HUGEINT)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM d JOIN n ON n.lang = d.lang
QUALIFY row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) <= {TOP}
"""


QUERIES = {"op11_collocations": op11_collocations}
ORACLES = {"op11_collocations": oracle()}
