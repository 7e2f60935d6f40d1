"""Importance resampling towards a target corpus by hashed word n-grams."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import ALNUM, BASE, U, Words, mix, slices, words_of
from tidemark.operators.ranks import numbered

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
#: The head: at most so many words are broadcast, at 12 bytes each, and the pairs of so many of them, at 10 bytes.
HEAD_WORDS, PAIRED_WORDS = 1 << 16, 1 << 9
#: Entries that a task holds before it passes counts on.
HELD = 1 << 20


@dataclass
class Head:
    """Hashes of frequent words with the checksum state of their bytes, and of frequent pairs with their bucket."""

    word: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    state: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))
    pair: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    bucket: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint16))


def _find(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted ones, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys, at


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of two consecutive words of one text, and where the first one is."""
    inside = np.ones(len(w.hash), bool)
    last = w.first[1:][np.diff(w.first) > 0] - 1
    inside[last] = False
    at = np.flatnonzero(inside)
    return mix(w.hash[at] * U(BASE) + w.hash[np.minimum(at + 1, max(len(w.hash) - 1, 0))]), at


class Slice:
    """Words and pairs of some texts, each distinct one once, with checksums of their bytes.

    A head word's state and a head pair's bucket come from the broadcast
    tables.  A word of the tail is read byte by byte; a pair that is not in the
    head goes on from the state of its first word over a space and the bytes of
    its second.
    """

    def __init__(self, text: pa.Array, head: Head):
        self.words = w = words_of(text, ALNUM)
        self.raw, self.head = w.data.tobytes(), head
        self.word, first, self.of = np.unique(w.hash, return_index=True, return_inverse=True)
        self.start, self.end = w.start[first].tolist(), w.end[first].tolist()
        known, at = _find(self.word, head.word)
        self.state = np.zeros(len(self.word), np.uint32)
        self.state[known] = head.state[at[known]]
        for k in np.flatnonzero(~known).tolist():
            self.state[k] = zlib.crc32(self.raw[self.start[k]:self.end[k]])

    def pair_checksum(self, a: np.ndarray, b: np.ndarray) -> list[int]:
        """Checksums of pairs of distinct words, given by number."""
        spaced: dict[int, int] = {}
        out = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            state = spaced.get(x)
            if state is None:
                state = spaced[x] = zlib.crc32(b" ", int(self.state[x]))
            out.append(zlib.crc32(self.raw[self.start[y]:self.end[y]], state))
        return out

    def buckets(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all words and pairs, text by text, and the offsets of the texts."""
        w = self.words
        one = (self.state % np.uint32(buckets)).astype(np.uint16)[self.of]
        keys, at = _pairs(w)
        pair, first, of = np.unique(keys, return_index=True, return_inverse=True)
        known, where = _find(pair, self.head.pair)
        two = np.zeros(len(pair), np.uint16)
        two[known] = self.head.bucket[where[known]]
        tail = first[~known]
        two[~known] = np.array(self.pair_checksum(self.of[at[tail]], self.of[at[tail] + 1]), np.uint32) % np.uint32(buckets)
        n = np.diff(w.first)
        size = n + np.maximum(n - 1, 0)
        offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(offsets[-1], np.uint16)
        shift = (offsets[:-1] - w.first[:-1])[w.doc]
        place = np.arange(len(w.hash)) + shift
        out[place] = one
        out[place[at] + n[w.doc[at]]] = two[of]
        return out, offsets


def _counted(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of equal keys summed; what else is known of a key is taken once."""
    key = np.concatenate([p[0] for p in parts])
    key, first, of = np.unique(key, return_index=True, return_inverse=True)
    value = np.concatenate([p[1] for p in parts])[first]
    return key, value, np.bincount(of, np.concatenate([p[2] for p in parts]), len(key)).astype(np.int64)


def _tally(batches: Iterator[pa.RecordBatch], each) -> Iterator[pa.RecordBatch]:
    """Counts of a task, key by key, passed on whenever they exceed what a task holds."""
    held: list[tuple[np.ndarray, ...]] = []

    def out(parts):
        key, value, n = parts
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value.astype(np.int64)), pa.array(n)], ["key", "value", "n"])

    size = 0
    for batch in batches:
        for part in slices(batch):
            found = each(part.column("text"))
            held.append(found)
            size += len(found[0])
            if size > HELD:
                held = [_counted(held)]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield out(held[0])
                    held, size = [], 0
    if held:
        yield out(_counted(held))


def _count_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s = Slice(text, Head())
    return s.word, s.state, np.bincount(s.of, minlength=len(s.word))


def _count_pairs(text: pa.Array, head: Head, paired: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two words among ``paired``, their bucket and count."""
    s = Slice(text, head)
    frequent = _find(s.word, paired)[0][s.of]
    keys, at = _pairs(s.words)
    both = frequent[at] & frequent[np.minimum(at + 1, max(len(s.of) - 1, 0))]
    keys, at = keys[both], at[both]
    pair, first, of = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.array(s.pair_checksum(s.of[at[first]], s.of[at[first] + 1]), np.uint32)
    return pair, sums % np.uint32(buckets), np.bincount(of, minlength=len(pair))


def _counts(texts: DataFrame, each) -> DataFrame:
    return texts.mapInArrow(lambda it: _tally(it, each), "key long, value long, n long").groupBy("key").agg(
        F.min("value").alias("value"), F.sum("n").alias("n"))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys ascending, values and counts of a table of bounded size."""
    found = counts.select("key", "value", "n").toArrow()
    key = found.column("key").to_numpy().astype(np.int64).view(U)
    order = np.argsort(key)
    return key[order], found.column("value").to_numpy()[order], found.column("n").to_numpy()[order]


def _most(counts: DataFrame, limit: int) -> DataFrame:
    """Rows of the largest counts, at most ``limit``: those above a count that a histogram of all gives.

    A step of the histogram is a sixteenth of a power of two; a step that does
    not fit in whole stays out.
    """
    step = F.floor(F.log2("n") * 16)
    left, least = limit, None
    for row in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        if row["count"] > left:
            break
        left, least = left - row["count"], row.step
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


def frequent(texts: DataFrame, words: int = HEAD_WORDS, paired: int = PAIRED_WORDS, buckets: int = BUCKETS) -> Head:
    """The most frequent words of all texts, and the pairs that occur of the first ``paired`` of these.

    So the number of pairs is bounded by ``paired`` squared before they are counted.
    """
    counts = stored(_counts(texts, _count_words), "word-counts")
    word, state, n = _collected(_most(counts, words))
    head = Head(word, state.astype(np.uint32))
    first = np.sort(word[np.argsort(-n, kind="stable")[:paired]])
    if len(first):
        sent = texts.sparkSession.sparkContext.broadcast((head, first))
        pair, bucket, _ = _collected(_counts(texts, lambda text: _count_pairs(text, *sent.value, buckets)))
        head = Head(word, head.state, pair, bucket.astype(np.uint16))
    return head


def _encode(batches: Iterator[pa.RecordBatch], head: Head, buckets: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            s = Slice(part.column("text"), head)
            found, offsets = s.buckets(buckets)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
                None, pa.py_buffer((offsets * 2).astype(np.int64).tobytes()), pa.py_buffer(found.astype("<u2").tobytes())])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(s.words.first)), data.cast(pa.binary())],
                                             ["doc_id", "n_words", "features"])


def _lists(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = part.column("features").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] // 2
    data = np.frombuffer(column.buffers()[2], "<u2") if column.buffers()[2] else np.zeros(0, "<u2")
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def totals(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: one row of counts per task is summed."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "features"):
                sums += np.bincount(_lists(part)[0], minlength=buckets)
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(sums[full])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in features.select("features").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(((t + 1) (S + B)) / ((s + 1) (T + B))))`` of each of B buckets, in doubles."""
    whole_s, whole_t = float(int(s.sum()) + len(s)), float(int(t.sum()) + len(t))
    return np.array([math.floor(1000 * math.log((float(y + 1) * whole_s) / (float(x + 1) * whole_t)))
                     for x, y in zip(s.tolist(), t.tolist(), strict=True)], np.int64)


def _weigh(batches: Iterator[pa.RecordBatch], gain: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "features"):
            found, offsets = _lists(part)
            sums = np.concatenate([[0], np.cumsum(gain[found])])
            n = np.diff(offsets)
            weight = (sums[offsets[1:]] - sums[offsets[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), pa.array(n), pa.array(weight)],
                                             ["doc_id", "n_words", "n_features", "weight"])


def importance(docs: DataFrame, target: DataFrame, words: int = HEAD_WORDS, paired: int = PAIRED_WORDS,
               buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document: how much likelier its features are in the target."""
    texts, aim = (x.select(F.col(c).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                  for x, c in ((docs, "doc_id"), (target.withColumn("doc_id", F.lit(0)), "doc_id")))
    head = docs.sparkSession.sparkContext.broadcast(frequent(texts.select("text"), words, paired, buckets))
    schema = "doc_id long, n_words long, features binary"
    held = stored(texts.mapInArrow(lambda it: _encode(it, head.value, buckets), schema), "features")
    gain = gains(totals(held, buckets), totals(aim.mapInArrow(lambda it: _encode(it, head.value, buckets), schema), buckets))
    return held.mapInArrow(lambda it: _weigh(it, gain), "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
             words: int = HEAD_WORDS, paired: int = PAIRED_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """Draw documents without replacement, likelier ones under the target corpus first.

    Takes ``doc_id, text`` and the target's ``text``; other columns are
    ignored.  Returns one row per input row: ``doc_id, n_features, weight,
    score, rank`` (all long).  Features are the words (lower-cased A-Z) and the
    pairs of consecutive words of a whole text, each in bucket ``crc32 mod
    buckets``.  ``weight`` is the floored mean of its buckets' log ratios, in
    thousandths, and ``score`` adds Gumbel noise from a hash of ``seed:doc_id``.
    Of the documents of ``least_words`` or more, ``percent`` % (floored) of
    highest scores have a ``rank``, ties to the smaller id.

    The most frequent words, and the pairs of the most frequent of them, are
    counted over all documents and broadcast with their checksum states and
    buckets, a bounded number; other features are checksummed as they come.  Both ways give the same
    bucket, so the head decides speed alone.  Totals are sums of one row of
    counts per task.

    Null, empty and wordless texts have no feature, weight 0 and no rank.  A
    null id hashes as an empty one and loses ties.  Rows of one id share their
    noise; ties among them go to fewer features, and repeated rows take ranks
    of their own.  An empty target, like a target without words, gives every
    bucket the same count.  No rows, no result.
    """
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296.0)))
    scored = stored(importance(docs, target, words, paired, buckets).select(
        "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score")), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    number = able.count() * percent // 100
    placed = numbered(able, [], [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features"], "rank")
    out = ["doc_id", "n_features", "weight", "score"]
    return placed.select(*out, F.when(F.col("rank") <= number, F.col("rank")).alias("rank")).unionByName(
        scored.where(F.col("n_words") < least_words).select(*out, F.lit(None).cast("long").alias("rank")))
