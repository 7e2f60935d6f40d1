"""Words, their hashes and shingle sets over Arrow text batches, in numpy.

Words are maximal runs of bytes of one class in UTF-8 text; every byte of a
character outside ASCII belongs to the same class, so byte runs are words.
Work goes in slices of about a megabyte, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES, SLICE_ROWS, BLOCK = 1 << 20, 1024, 1 << 20
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def byte_class(keep) -> np.ndarray:
    """A table of the 256 bytes that ``keep`` accepts."""
    return np.array([bool(keep(b)) for b in range(256)])


LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
SAME = np.arange(256, dtype=np.uint8)
#: words ``[^\x20\x09-\x0D]+``
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse modulo 2**64 for i below n; kept up to a block."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        steps = np.full(max(n, BLOCK + 1), base, U)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= BLOCK + 1:
        _powers = tuple(made)
    return tuple(made)


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES,
           max_rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in pieces of bounded text size, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(sizes)])
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(total, total[at] + max_bytes, side="right")) - 1
        to = min(max(to, at + 1), at + max_rows, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; null is empty."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Word spans of the texts of a slice: ``first[d]:first[d + 1]`` are those of text d."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order, from prefix sums block by block."""
    out = np.empty(len(start), U)
    at = 0
    while at < len(start):
        lo = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, lo + BLOCK, side="right")))
        hi = int(end[to - 1])
        up, down = powers(hi - lo + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum((data[lo:hi].astype(U) + U(1)) * up[:hi - lo])])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
        at = to
    return out


def words_of(text: pa.Array, kind: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words of each text, its bytes folded first."""
    raw, offsets = text_buffer(text)
    data = fold[raw]
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a word never crosses texts
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    first[-1] = len(start)
    return Words(data, offsets, start, end, first, span_hashes(data, start, end))


@dataclass
class Sets:
    """Distinct shingle hashes, ascending within each text: ``first[d]:first[d + 1]``."""

    hash: np.ndarray
    first: np.ndarray

    def of(self, d: int) -> np.ndarray:
        return self.hash[self.first[d]:self.first[d + 1]]


def shingle_sets(text: pa.Array, size: int, kind: np.ndarray = SPACED) -> Sets:
    """The distinct word n-grams of each text; all its words as one when it has fewer."""
    w = words_of(text, kind)
    count = np.diff(w.first)
    per = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(per)), per)
    at = w.first[:-1][doc] + np.arange(len(doc)) - first[:-1][doc]
    length = np.minimum(count[doc], size)
    value = length.astype(U)
    for step in range(size):
        inside = length > step
        word = w.hash[np.minimum(at + step, max(len(w.hash) - 1, 0))] if len(w.hash) else np.zeros(len(at), U)
        value = np.where(inside, (value ^ word) * U(BASE) + (value >> U(29)), value)
    value = mix(value)
    for d in range(len(per)):
        value[first[d]:first[d + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return Sets(value[new], np.searchsorted(doc[new], np.arange(len(per) + 1)))
