"""Hashed word n-gram logistic models trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import SAME, SPACED, U, byte_class, mix, slices, span_hashes, text_buffer, words_of

DIMENSIONS = 1 << 18
#: Labelled rows that a fit reads at most, over all shards; beyond it rows are taken by a hash of their id.
SAMPLE_ROWS, SHARD_ROWS, EPOCHS = 24_000, 3_000, 4
#: Bytes of text, each text counted up to ``DIMENSIONS`` as it has no more distinct features, that one task fits.
SHARD_BYTES = 1 << 26
LETTERS = byte_class(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)
MARKS = SPACED & ~LETTERS
UPPER, LOW, DIGIT = (byte_class(lambda b, lo=lo, hi=hi: lo <= b <= hi) for lo, hi in ((65, 90), (97, 122), (48, 57)))


@dataclass
class Features:
    """Features of text d: ``index[first[d]:first[d + 1]]``, each of weight ``weight[d]``."""

    index: np.ndarray
    first: np.ndarray
    weight: np.ndarray


def features(text: pa.Array, presence: bool = False, useful: np.ndarray | None = None) -> Features:
    """Word 1- and 2-grams and shape 1- to 3-grams, hashed.

    By default every occurrence weighs ten over their number: a text is what it
    is on average.  With ``presence`` every distinct feature weighs five over
    the fourth root of that number: a single telling word counts.  Then
    features that are not ``useful``, of weight zero in a model, may be left
    out before the distinct ones are sorted; what is left weighs the same.

    Words are runs of letters and digits or runs of marks.  The shape of a word
    is its letter cases, digits and whether it repeats the word before it or
    the one before that; of marks it is the marks themselves.
    """
    raw, _ = text_buffer(text)
    letters, marks = words_of(text, LETTERS, SAME), words_of(text, MARKS, SAME)
    start = np.concatenate([letters.start, marks.start])
    order = np.argsort(start, kind="stable")
    word = np.concatenate([letters.hash, marks.hash])[order]
    doc = np.concatenate([letters.doc, marks.doc])[order]
    shape = np.zeros(len(letters.start), U)
    if len(shape):
        for bit, kind in enumerate((UPPER, LOW, DIGIT)):
            sums = np.concatenate([[0], np.cumsum(kind[raw])])
            shape |= ((sums[letters.end] > sums[letters.start]).astype(U) << U(bit))
        shape |= UPPER[raw[letters.start]].astype(U) << U(3)
        shape |= np.minimum(letters.end - letters.start, 15).astype(U) // U(4) << U(4)
    shape = np.concatenate([shape, marks.hash])[order]

    def before(x: np.ndarray, step: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[step:] = np.where(doc[step:] == doc[:-step], x[:-step], U(0)) if len(x) > step else out[step:]
        return out

    previous, second = before(word, 1), before(word, 2)
    shape = mix(shape * U(4) + (word == previous) * U(1) + (word == second) * U(2) + U(77))
    one, two = before(shape, 1), before(shape, 2)
    families = [mix(word + U(1)), mix(word * U(3) + previous + U(2)), mix(shape + U(3)), mix(shape * U(3) + one + U(4)),
                mix(shape * U(9) + one * U(3) + two + U(5))]
    index = np.stack(families, axis=1).reshape(-1)
    index = (index >> U(32)).astype(np.int64) * DIMENSIONS >> 32
    first = np.searchsorted(doc, np.arange(len(text) + 1)) * len(families)
    number = np.maximum(np.diff(first), 1)
    if not presence:
        return Features(index, first, 10 / number)
    owner = np.repeat(doc, len(families))
    if useful is not None:
        kept = useful[index]
        owner, index = owner[kept], index[kept]
    once = np.unique(owner * DIMENSIONS + index)
    return Features(once % DIMENSIONS, np.searchsorted(once, np.arange(len(text) + 1) * DIMENSIONS), 5 / number ** 0.25)


@dataclass
class Leader:
    """Per-coordinate follow-the-regularised-leader state of one logistic output."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 1e-4
    z: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS + 1))
    n: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS + 1))

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def sigmoid(t):
    return 1 / (1 + np.exp(-np.clip(t, -30, 30)))


def _examples(batches: Iterator[pa.RecordBatch], presence: bool):
    """``(index, value, label)`` of each labelled text; the last index is the constant."""
    for batch in batches:
        for part in slices(batch):
            f = features(part.column("text"), presence)
            for d, label in enumerate(part.column("label").to_pylist()):
                at, times = np.unique(f.index[f.first[d]:f.first[d + 1]], return_counts=True)
                x = np.append(times * f.weight[d], 1.0).astype(np.float32)
                yield np.append(at, DIMENSIONS).astype(np.int32), x, label


def _fit_shard(batches: Iterator[pa.RecordBatch], outputs: int, epochs: int, presence: bool) -> Iterator[pa.RecordBatch]:
    rows = list(_examples(batches, presence))
    if not rows:
        return
    leaders = [Leader(alpha=0.3, l1=2.0) if presence else Leader() for _ in range(outputs)]
    for _ in range(epochs):
        for at, x, label in rows:
            for k, leader in enumerate(leaders):
                leader.learn(at, x, float(label == (1 if outputs == 1 else k)))
    everywhere = np.arange(DIMENSIONS + 1)
    w = np.stack([leader.weights(everywhere) for leader in leaders]).astype(np.float32)
    yield pa.RecordBatch.from_pydict({"rows": [len(rows)], "w": [w.tobytes()]},
                                     pa.schema([("rows", pa.int64()), ("w", pa.binary())]))


def fit(labelled: DataFrame, outputs: int = 1, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS,
        epochs: int = EPOCHS, presence: bool = False, marks: DataFrame | None = None) -> np.ndarray:
    """Weights ``[outputs, DIMENSIONS + 1]`` from ``doc_id, text, label`` rows (label: 0/1, or the output's number).

    Labels may be in a table of their own, ``marks`` of ``doc_id, label``.
    They are counted and drawn by hashes of the texts, and only the texts of
    the sample are looked up, so no other text is shuffled.

    Rows of equal id, text and label are one example, however often they come.
    The sample is bounded by ``sample_rows``: beyond it, examples are taken by
    a hash of their id and text, the same ones in every run.  It is dealt by
    another hash over tasks of about ``shard_rows`` rows, or fewer where texts
    are very long; each runs ``epochs`` passes in a fixed order and
    returns a weight vector of fixed size, and the vectors are averaged.
    Without labelled rows the weights are zero, which scores 0.5.
    """
    turn = F.xxhash64(F.lit("order"), "doc_id", "text")
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30))
    keys = ["turn", "part"] if marks is not None else ["turn", "part", "label"]
    keyed = labelled.withColumns({"turn": turn, "part": part})
    sized = keyed.select("doc_id", *keys, F.least(F.length("text"), F.lit(DIMENSIONS)).alias("size"))
    if marks is not None:
        sized = sized.join(marks.select("doc_id", "label"), "doc_id")
    once = stored(sized.groupBy("turn", "part", "label").agg(F.max("size").alias("size")), "examples")
    total, size = once.agg(F.count("*"), F.sum("size")).first()
    if total > sample_rows:
        once = stored(once.filter(F.col("part") < int((1 << 30) * sample_rows / total)), "sample")
        size = (size or 0) * sample_rows // total
    shards = max(-(-min(total, sample_rows) // shard_rows), -(-(size or 0) // SHARD_BYTES)) or 1
    # The sample holds about sample_rows rows at most, whatever the table, so it may always be broadcast.
    drawn = keyed.select("text", *keys).join(F.broadcast(once.drop("size")), keys)
    dealt = drawn.groupBy("turn", "label").agg(F.min("text").alias("text")).repartition(
        shards, F.pmod("turn", F.lit(shards))).sortWithinPartitions("turn", "label")
    found = dealt.mapInArrow(lambda it: _fit_shard(it, outputs, epochs, presence), "rows long, w binary").collect()
    out = np.zeros((outputs, DIMENSIONS + 1))
    for row in sorted(found, key=lambda r: bytes(r.w)):
        out += np.frombuffer(row.w, np.float32).reshape(out.shape) * (row.rows / sum(r.rows for r in found))
    return out.astype(np.float32)


def margins(text: pa.Array, weights: np.ndarray, presence: bool = False) -> np.ndarray:
    """Sparse dot products ``[outputs, texts]``."""
    f = features(text, presence, (weights[:, :-1] != 0).any(axis=0) if presence else None)
    out = np.empty((len(weights), len(text)))
    for k, w in enumerate(weights):
        sums = np.concatenate([[0.0], np.cumsum(w[f.index], dtype=np.float64)])
        out[k] = (sums[f.first[1:]] - sums[f.first[:-1]]) * f.weight + w[-1]
    return out


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """One id in five by its checksum; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
