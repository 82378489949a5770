"""Words of whole Arrow batches as numpy arrays, without a Python object per word.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D).
Hashes are polynomials over random 64-bit byte values, taken for all words at once
from one running sum, then mixed; equal words have equal hashes in every batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


VALUE = mix(np.arange(1, 257, dtype=U) * U(_BASE))


#: Bytes whose hashes are summed at once; only a longer word needs more powers, and those aren't kept.
_SPAN = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    found = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, U)
        x[:1] = 1
        found.append(np.multiply.accumulate(x))
    return found[0], found[1]


_POWERS = _powers(_SPAN + 1)


def hashes_of(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of ``values`` (64-bit) in each range start..end: not empty, starts and ends ascend.

    Sums run over stretches of about ``_SPAN`` values, so memory doesn't grow with a batch.
    """
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, low + _SPAN, side="right")))
        n = int(end[j - 1]) - low
        up, down = _POWERS if n <= _SPAN else _powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(values[low : low + n] * up[:n], out=total[1:])
        a, b = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((total[b] - total[a]) * down[a])
        i = j
    return out


def hashes_of_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """``hashes_of`` over bytes, whose 64-bit values are looked up stretch by stretch."""
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, low + _SPAN, side="right")))
        out[i:j] = hashes_of(VALUE[data[low : int(end[j - 1])]], start[i:j] - low, end[i:j] - low)
        i = j
    return out


#: What is left of eight bytes read at once, of which so many belong to a word; words of more bytes than LONG aren't read so.
_OF_EIGHT = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG = 64


def hashes_by_eight(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Other hashes of the same ranges, for short words: each is read eight bytes at once, and not by every byte."""
    size = end - start
    out = size.astype(U) * U(_BASE)
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at, of = start, slice(None)
    while len(at):
        out[of] = mix(out[of] ^ (eight[at] & _OF_EIGHT[np.minimum(end[of] - at, 8)]))
        more = np.flatnonzero((end[of] - at > 8) & (size[of] <= LONG))
        at, of = at[more] + 8, more if isinstance(of, slice) else of[more]
    long = np.flatnonzero(size > LONG)
    if len(long):
        out[long] = hashes_of_bytes(data, start[long], end[long])
    return out


@dataclass
class Words:
    """Words of a run of texts: byte ranges in ``data``, hashes, and each text's first word."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1
    hash: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j (not included), with what stands between them."""
        return self.data[self.start[i] : self.end[j - 1]].tobytes() if j > i else b""


def words_of(texts: pa.Array, hashes=hashes_of_bytes) -> Words:
    """``texts``: an Arrow string or binary array; null is empty.  ``hashes`` of (data, start, end)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if n else (0, 0)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[low:high] if raw is not None and high > low else np.zeros(0, np.uint8)
    bounds = offsets - low
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    before[:1], before[1:] = False, inside[:-1]
    edge = bounds[(bounds >= 0) & (bounds < len(data))]
    before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1:], after[:-1] = False, inside[1:]
    after[edge[edge > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, bounds)
    return Words(data, start, end, first, hashes(data, start, end))


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``max_bytes`` of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, i = np.cumsum(size), 0
    while i < len(size):
        done = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, done + max_bytes, side="right")))
        yield batch.slice(i, j - i)
        i = j


def runs(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows of ``width`` words that lie in one text, and their text's number."""
    counts = np.maximum(np.diff(first) - (width - 1), 0)
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[:-1][text] + at, text


def window_hashes(hashes: np.ndarray, starts: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A hash of the ``width`` word hashes from each start on, order kept."""
    out = np.full(len(starts), (seed * 2 + 1) * _BASE % (1 << 64), U)
    for j in range(width):
        out = (out ^ hashes[starts + j]) * U(0xD6E8FEB86659FD93)
        out ^= out >> U(32)
    return mix(out)
