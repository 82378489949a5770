"""Quality rules on tokeniser fertility, with bands per language, length and script.

A public byte-fallback vocabulary encodes each word of a text on its own.  Measures
(``FLOOR``), of the whole text: characters per token, share of byte-fallback tokens,
entropy of its tokens; of its windows of ``SPAN`` words, one every ``STEP``: the mean and
the least entropy of the tokens that end a word, and the least characters per token.
Words of a language end in many ways, so signs, bars and markup that stand after words
lower the entropy of ends, wherever in a text they are; a window has the same size in
texts of any length, so all texts of a language share a band.

A text is rejected when a measure leaves its band: median +- ``WIDTH`` robust standard
deviations ((p75 - p25) / 1.349, at least ``FLOOR``, and at least ``NOISE`` over the root
of the text's tokens), by language and length class: the whole part of log2 of the tokens
for measures of the text, of the words (``SPAN`` at most) for those of windows.
Bands are fitted on the texts that pass the base rules, each distinct text once, so
neither junk nor groups of copies widen them.  A class of fewer than ``LEAST`` such texts
takes its language's band (measures that don't depend on length), else that of its script
and length; a script's band holds for any number of texts, with the deviation times the
root of ``LEAST`` over it if they are fewer.

Base rules come first: too few words, or too many words in repeated 5-word windows.

Defined cases: null text is empty, has no words and fails the base; null lang is a
language of its own; ties and repeated rows get equal verdicts; whole texts are read
whatever their length; a word that the vocabulary drops has no token and ends in id 0; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table
from .words import runs, slices, window_hashes, words_of, mix

WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Words of a window of tokens, and from one window to the next.
SPAN, STEP = 64, 32
LEAST = 100
#: Half width of each measure's band in standard deviations.
WIDTH = {"chars_per_token": 6.0, "byte_share": 6.0, "entropy": 5.0, "end_entropy": 5.0, "worst_end_entropy": 6.0, "worst_chars_per_token": 6.0}
#: Least standard deviation of each measure.
FLOOR = {"chars_per_token": 0.1, "byte_share": 0.02, "entropy": 0.2, "end_entropy": 0.15, "worst_end_entropy": 0.15, "worst_chars_per_token": 0.1}
#: Deviation of the measure of one token.
NOISE = {"chars_per_token": 1.5, "byte_share": 0.15, "entropy": 1.0, "end_entropy": 2.0, "worst_end_entropy": 2.0, "worst_chars_per_token": 1.5}
#: Bands (of ``KEYS``) that a measure takes: the first that there is.
LEVELS = {
    "chars_per_token": ("_ll", "_l", "_s"),
    "byte_share": ("_ll", "_l", "_s"),
    "entropy": ("_ll", "_sl"),
    "end_entropy": ("_lw", "_sw"),
    "worst_end_entropy": ("_lw", "_sw"),
    "worst_chars_per_token": ("_lw", "_sw"),
}
KEYS = {"_ll": ("lang", "length_class"), "_l": ("lang",), "_sl": ("script", "length_class"), "_s": ("script",), "_lw": ("lang", "word_class"), "_sw": ("script", "word_class")}
#: Ids whose entropies are taken at once.
STRETCH = 1 << 20
#: Signs that are counted for the contract; no verdict comes from them.
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"#*$%&|<>")] = 1
#: Script by the first byte of a letter's UTF-8: 1 Latin, 2 Greek, 3 Cyrillic, 4 Hebrew, 5 Arabic, 6 Indic and Thai, 7 other, 8 kana and signs, 9 Han, 10 Hangul; 0 none.
SCRIPT = np.zeros(256, np.int64)
for _low, _high, _script in ((0x41, 0x5B, 1), (0x61, 0x7B, 1), (0xC3, 0xCA, 1), (0xCD, 0xD0, 2), (0xD0, 0xD4, 3), (0xD6, 0xD8, 4), (0xD8, 0xDC, 5), (0xE0, 0xE1, 6), (0xE1, 0xE2, 7), (0xE3, 0xE4, 8), (0xE4, 0xEA, 9), (0xEA, 0xEE, 10), (0xF0, 0xF5, 7)):
    SCRIPT[_low:_high] = _script
SPACES = b" \t\n\r\x0b\x0c"


class Fertility:
    """Token ids of words by a sentencepiece model; recent words' ids are kept, boundedly."""

    def __init__(self, path: str, most: int = 200_000):
        import sentencepiece

        self.model, self.most, self.known = sentencepiece.SentencePieceProcessor(model_file=path), most, {}
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.size = len(self.is_byte)

    def ids(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and each word's number of ids."""
        found = set().union(*texts)
        unseen = [w for w in found if w not in self.known]
        if len(self.known) + len(unseen) > self.most:
            self.known = dict(islice(self.known.items(), len(self.known) // 2, None))
            unseen = [w for w in found if w not in self.known]
        got = self.model.encode([w.decode("utf-8", "replace") for w in unseen], num_threads=1) if unseen else []
        self.known.update((w, np.array(x, "<u4").tobytes()) for w, x in zip(unseen, got, strict=True))
        of = self.known.__getitem__
        got = [of(word) for words in texts for word in words]
        return np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) >> 2


_MODELS: dict[str, Fertility] = {}


def repeated_words(w, width: int = WINDOW) -> np.ndarray:
    """Per text: its words that lie in a window found twice or more in that text."""
    starts, text = runs(w.first, width)
    if not len(starts):
        return np.zeros(len(w.first) - 1, np.int64)
    keys = window_hashes(w.hash, starts, width) ^ mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    change = np.zeros(len(w.start) + 1, np.int64)
    np.add.at(change, starts[again], 1)
    np.add.at(change, starts[again] + width, -1)
    covered = np.cumsum(np.cumsum(change)[:-1] > 0)
    upto = np.concatenate([[0], covered])[w.first]
    return np.diff(upto)


def scripts(w) -> np.ndarray:
    """Per text: the script of most of its letters."""
    n, k = len(w.first) - 1, SCRIPT.max() + 1
    word = np.repeat(np.arange(n), np.diff(w.first))
    upto = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(upto, w.start, np.diff(word, prepend=0))
    counts = np.bincount(np.cumsum(upto)[:-1] * k + SCRIPT[w.data], minlength=n * k).reshape(n, k)
    return counts[:, 1:].argmax(axis=1) + 1 if n else np.zeros(0, np.int64)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def entropies(ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The entropy (bits) of the ids in each range start..end; 0 of an empty one."""
    out, n = np.zeros(len(start)), end - start
    upto = np.cumsum(n)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] - n[i] + STRETCH, side="right")))
        size = n[i:j]
        place = np.arange(size.sum()) + np.repeat(start[i:j] - (np.cumsum(size) - size), size)
        keys = np.sort(np.repeat(np.arange(j - i) << 32, size) | ids[place].astype(np.int64))
        new = np.flatnonzero(np.diff(keys, prepend=-1))
        count = np.diff(new, append=len(keys))
        some = np.maximum(size, 1)
        out[i:j] = np.log2(some) - np.bincount(keys[new] >> 32, count * np.log2(count), j - i) / some
        i = j
    return out


def windows(first: np.ndarray, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the windows of texts whose words are first[i]..first[i + 1].

    One every ``step`` words and one at the end; a shorter text is one window, an empty one has none.
    """
    n = np.diff(first)
    room = np.maximum(n - span, 0)
    count = np.where(n > 0, 1 - (-room // step), 0)
    text = np.repeat(np.arange(len(n)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + np.minimum(number * step, room[text])
    return text, start, start + np.minimum(n[text], span)


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "n_byte_tokens", "script"]
SHARES = ["entropy", "end_entropy", "worst_end_entropy", "worst_chars_per_token"]


def measures(docs: DataFrame, model: str, column: str = "text") -> DataFrame:
    """doc_id, lang, the counts of ``NAMES`` and the measures of ``SHARES`` (entropies in bits)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _MODELS:
            _MODELS[model] = Fertility(model)
        vocabulary = _MODELS[model]
        for batch in batches:
            for part in slices(batch, column):
                texts = [t or b"" for t in part.column(column).cast(pa.binary()).to_pylist()]
                w = words_of(part.column(column))
                # Code points: bytes that don't continue one, outside white space.
                upto = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
                upto_chars = np.concatenate([[0], np.cumsum(upto[w.end] - upto[w.start])])  # by word
                word_chars = upto_chars[w.first]
                sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                symbols = np.concatenate([[0], np.cumsum(SYMBOL[w.data])])[sizes]
                ids, count = vocabulary.ids([t.split() for t in texts])
                upto_ids = np.concatenate([[0], np.cumsum(count)])  # by word
                bound = upto_ids[w.first]
                tokens = np.diff(bound)
                byte_tokens = np.diff(np.concatenate([[0], np.cumsum(vocabulary.is_byte[ids])])[bound])
                ends = np.zeros(len(count), np.int64)
                ends[count > 0] = ids[upto_ids[1:][count > 0] - 1]
                text, low, high = windows(w.first)
                of_ends = entropies(ends, low, high)
                of_chars = (upto_chars[high] - upto_chars[low]) / np.maximum(upto_ids[high] - upto_ids[low], 1)
                least = np.full((2, part.num_rows), np.inf)
                for worst, values in zip(least, (of_ends, of_chars), strict=True):
                    np.minimum.at(worst, text, values)
                mean = np.bincount(text, of_ends, part.num_rows) / np.maximum(np.bincount(text, minlength=part.num_rows), 1)
                counts = [np.diff(w.first), np.diff(word_chars), np.diff(symbols), [duplicate_lines(t) for t in texts], repeated_words(w), tokens, byte_tokens, scripts(w)]
                shares = [entropies(ids, bound[:-1], bound[1:]), mean, *np.where(np.isinf(least), 0.0, least)]
                arrays = [part.column("doc_id"), part.column("lang"), *(pa.array(np.asarray(c, np.int64)) for c in counts), *(pa.array(c, pa.float64()) for c in shares)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", *NAMES, *SHARES])

    schema = ", ".join([*(f"{n} long" for n in NAMES), *(f"{n} double" for n in SHARES)])
    return docs.select("doc_id", "lang", F.col(column).cast("string").alias(column)).mapInArrow(read, f"doc_id long, lang string, {schema}")


def _bands(rows: DataFrame, suffix: str, least: int) -> DataFrame:
    """Median and deviation of the measures of a level by its keys; exact percentiles of rounded values, which combine by value."""
    keys, names = KEYS[suffix], [n for n, levels in LEVELS.items() if suffix in levels]
    quarters = [F.percentile(F.round(n, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_{n}") for n in names]
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *quarters).filter(F.col("_n") >= least)
    few = F.sqrt(F.greatest(F.lit(1.0), F.lit(float(LEAST)) / F.col("_n")))
    columns = [F.col(k).alias(f"_k{suffix}_{k}") for k in keys]
    for name in names:
        p = F.col(f"_{name}")
        columns += [p[1].alias(f"{name}_mid{suffix}"), (F.greatest((p[2] - p[0]) / 1.349, F.lit(FLOOR[name])) * few).alias(f"{name}_sd{suffix}")]
    return found.select(*columns)


def judge(counted: DataFrame, least: int = LEAST, measured: tuple[str, ...] = tuple(LEVELS)) -> DataFrame:
    """The rows of ``measures`` (a stored table) with base_failed, the measures and kept, which ``measured`` decide."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    some = F.greatest(F.col("n_tokens"), F.lit(1))
    classes = {"length_class": F.floor(F.log2(some)).cast("int"), "word_class": F.floor(F.log2(F.least(F.greatest(F.col("n_words"), F.lit(1)), F.lit(SPAN)))).cast("int")}
    rows = counted.withColumns({"base_failed": failed, "chars_per_token": F.col("word_chars") / some, "byte_share": F.col("n_byte_tokens") / some, **classes})
    # Copies of a text have equal counts in all columns.
    fit = stored(rows.filter("NOT base_failed").select("lang", *classes, *NAMES, *FLOOR).distinct(), "quality-fit")
    joined = rows
    for suffix, keys in KEYS.items():
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k{suffix}_{k}"))
        joined = joined.join(_bands(fit, suffix, least if "lang" in keys else 1), same, "left")
    inside = F.lit(True)
    for name in measured:
        middle, sd = (F.coalesce(*(f"{name}_{x}{s}" for s in LEVELS[name])) for x in ("mid", "sd"))
        chance = NOISE[name] / F.sqrt(some)  # what a text of so few tokens deviates by chance
        inside = inside & F.coalesce(F.abs(F.col(name) - middle) <= WIDTH[name] * F.greatest(sd, chance), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "n_tokens", *FLOOR)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(stored(measures(table(spark, sf_dir, "documents"), model_path()), "fertility"))


QUERIES = {"op8_fertility": op8_fertility}
ORACLES: dict[str, str] = {}
