"""Language of texts by unigram pieces of a fixed vocabulary, summed over all segmentations."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import U, mix, slices

UNKNOWN = "und"
#: Rounds of expectation-maximisation, and the count that every piece has beforehand.
ROUNDS, PRIOR = 4, 0.05
#: Languages whose models one task holds at once; more are judged in further blocks.
BLOCK = 64
#: Longest piece and longest unit in bytes; characters of the parts of a longer run of letters.
PIECE_BYTES, UNIT_BYTES, CUT = 16, 64, 16
#: Tokens that a counting task holds, and megabytes of scores that a worker remembers.
HELD, MEMORY = 1 << 19, 64
#: Probabilities are multiplied by this for every byte, so that long units stay in the range of a double.
SCALE = 4096.0

_RUN = re.compile(r"[^\W\d_]+")


def units(text: str) -> list[str]:
    """Runs of letters of the lower-cased text, each after a space; long runs in parts, only the first after one."""
    runs = _RUN.findall(text.lower())
    if not runs or max(map(len, runs)) <= CUT:
        return [" " + r for r in runs]
    out = []
    for r in runs:
        if len(r) <= CUT or len(r.encode()) < UNIT_BYTES:
            out.append(" " + r)
        else:
            out.append(" " + r[:CUT - 1])
            out.extend(r[k:k + CUT] for k in range(CUT - 1, len(r), CUT))
    return out


# -- pieces ----------------------------------------------------------------

def public_pieces(path: str) -> list[bytes]:
    """Lower-case letter pieces of a public vocabulary as bytes, a word's beginning as a space; and all single bytes.

    With the single bytes every unit has a segmentation.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)}
    for k in range(model.get_piece_size()):
        piece = model.id_to_piece(k).replace("▁", " ")
        core = piece.removeprefix(" ")
        if core.isalpha() and core == core.lower() and len(piece.encode()) <= PIECE_BYTES:
            found.add(piece.encode())
    return sorted(found)


class Pieces:
    """Finds all pieces in many units at once, by a hash table of the pieces' prefixes."""

    def __init__(self, pieces: list[bytes]):
        self.number, self.longest = len(pieces), max(map(len, pieces))
        self.length = np.array([len(p) for p in pieces])
        place = {p: k for k, p in enumerate(pieces)}
        prefixes = sorted({p[:n] for p in pieces for n in range(1, len(p) + 1)})
        keys = np.array([self._key(p) for p in prefixes], U)
        self.mask = (1 << (8 * len(prefixes)).bit_length()) - 1
        self.key, self.piece = np.zeros(self.mask + 1, U), np.full(self.mask + 1, self.number, np.int32)
        for key, prefix in zip(mix(keys).tolist(), prefixes, strict=True):
            at = key & self.mask
            while self.key[at]:
                at = (at + 1) & self.mask
            self.key[at], self.piece[at] = key, place.get(prefix, self.number)
        # Most look-ups are of one or two bytes; those have tables of their own.
        byte = np.arange(256).astype(U) + U(1)
        self.short = [self._look_up(byte), self._look_up((byte[:, None] * U(0x100000001B3) + byte).reshape(-1))]

    @staticmethod
    def _key(prefix: bytes) -> int:
        key = 0
        for byte in prefix:
            key = (key * 0x100000001B3 + byte + 1) & 0xFFFFFFFFFFFFFFFF
        return key

    def _look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is that of a prefix, and its piece."""
        key = mix(key)
        at = (key & U(self.mask)).astype(np.int64)
        held = self.key[at]
        open_ = np.flatnonzero((held != key) & (held != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            now = self.key[at[open_]]
            held[open_] = now
            open_ = open_[(now != key[open_]) & (now != 0)]
        known = held == key
        return known, np.where(known, self.piece[at], self.number)

    def edges(self, block: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(begin, end, units, pieces)`` of all pieces in units of n bytes each, by end and begin.

        A substring is looked up only while what precedes its last byte is a prefix of some piece.
        """
        n, m = block.shape[1], block.shape[0]
        flat = block.T.astype(U) + U(1)  # a row for each byte
        flat = np.ascontiguousarray(flat).reshape(-1)
        cell = np.arange(n * m)  # begin * m + unit
        key, out = np.zeros(n * m, U), []
        for size in range(1, min(self.longest, n) + 1):
            inside = cell < (n - size + 1) * m
            cell, key = cell[inside], key[inside]
            before = key if size == 2 else None
            last = flat[cell + (size - 1) * m]
            key = key * U(0x100000001B3) + last
            if size <= 2:  # the key of one byte is that byte
                code = (last - U(1) if size == 1 else (before - U(1) << U(8)) + last - U(1)).astype(np.int64)
                known, piece = (column[code] for column in self.short[size - 1])
            else:
                known, piece = self._look_up(key)
            real = np.flatnonzero(piece < self.number)
            mine, pieces = cell[real], piece[real]
            cuts = np.searchsorted(mine, np.arange(n - size + 2) * m)
            for begin in range(n - size + 1):
                a, b = cuts[begin], cuts[begin + 1]
                if a < b:
                    out.append((begin, begin + size, mine[a:b] - begin * m, pieces[a:b]))
            on = np.flatnonzero(known)
            cell, key = cell[on], key[on]
            if not len(cell):
                break
        return sorted(out, key=lambda e: (e[1], e[0]))


def by_length(some: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Units of equal byte length together: their numbers and their bytes."""
    raw = [u.encode("utf-8", "replace") for u in some]
    size = np.array([len(r) for r in raw])
    for n in np.unique(size):
        who = np.flatnonzero(size == n)
        for at in range(0, len(who), 20_000):
            part = who[at:at + 20_000]
            yield part, np.frombuffer(b"".join([raw[k] for k in part]), np.uint8).reshape(len(part), n)


def forward(edges, prob, n: int, shape: tuple) -> np.ndarray:
    """Summed probability of all segmentations of the first 0, 1, ... n bytes; ``prob`` has those of each edge."""
    alpha = np.zeros((n + 1, *shape))
    alpha[0] = 1
    for (begin, end, units_, _), p in zip(edges, prob, strict=True):
        alpha[end][units_] += alpha[begin][units_] * p
    return alpha


def backward(edges, prob, n: int, shape: tuple) -> np.ndarray:
    """The same of what follows the first 0, 1, ... n bytes."""
    beta = np.zeros((n + 1, *shape))
    beta[n] = 1
    for (begin, end, units_, _), p in sorted(zip(edges, prob, strict=True), key=lambda e: -e[0][0]):
        beta[begin][units_] += beta[end][units_] * p
    return beta


def scaled(p: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Probabilities ``[pieces, languages]`` by the bytes of each piece."""
    return p * SCALE ** length[:, None]


def log_likelihood(some: list[str], pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """``[units, languages]`` from scaled probabilities."""
    out = np.zeros((len(some), p.shape[1]))
    for who, block in by_length(some):
        edges, n = pieces.edges(block), block.shape[1]
        alpha = forward(edges, [p[k] for *_, k in edges], n, (len(who), p.shape[1]))
        out[who] = np.log(alpha[n]) - n * np.log(SCALE)
    return out


def expected(some: list[str], language: np.ndarray, times: np.ndarray, pieces: Pieces, p: np.ndarray) -> np.ndarray:
    """Expected piece counts ``[pieces, languages]`` of units that occur so often in a language."""
    out = np.zeros(pieces.number * p.shape[1])
    for who, block in by_length(some):
        edges, spoken, n = pieces.edges(block), language[who], block.shape[1]
        prob = [p[k, spoken[units_]] for _, _, units_, k in edges]
        alpha, beta = (way(edges, prob, n, (len(who),)) for way in (forward, backward))
        each = times[who] / alpha[n]
        place = np.concatenate([k.astype(np.int64) * p.shape[1] + spoken[units_] for _, _, units_, k in edges])
        weight = np.concatenate([each[units_] * alpha[begin][units_] * q * beta[end][units_]
                                 for (begin, end, units_, _), q in zip(edges, prob, strict=True)])
        out += np.bincount(place, weight, len(out))
    return out.reshape(-1, p.shape[1])


# -- learning --------------------------------------------------------------

def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, tokens in held.items():
            sums: Counter = Counter()
            for token, n in tokens.items():
                for unit in units(token):
                    sums[unit] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sums), pa.string()), pa.array(sums.keys(), pa.string()),
                                              pa.array(sums.values(), pa.int64())], ["lang", "unit", "n"])

    held: dict[str, Counter] = {}
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                # Runs of letters never cross white space, so equal tokens are cut once.
                held.setdefault(lang, Counter()).update(text.split())
            if sum(map(len, held.values())) > HELD:
                yield from out(held)
                held = {}
    yield from out(held)


def unit_counts(texts: DataFrame) -> DataFrame:
    """``lang, unit, n`` over all texts."""
    return texts.mapInArrow(_count, "lang string, unit string, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray


def fit(counts: DataFrame, documents: dict[str, int], pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """Piece probabilities of some languages by expectation-maximisation over all their units.

    A round is one pass over the distinct units, in parallel; what comes back
    is a number for each piece and language.
    """
    names = sorted(documents, key=str.encode)
    spark = counts.sparkSession
    p = np.full((pieces.number, len(names)), 1.0 / pieces.number)
    place = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "lang string, language int")
    rows = counts.join(F.broadcast(place), "lang").select("unit", "language", "n")
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, scaled(p, pieces.length)))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            known, now = sent.value
            sums = np.zeros((known.number, now.shape[1]))
            for batch in batches:
                sums += expected(batch.column("unit").to_pylist(), batch.column("language").to_numpy(), batch.column("n").to_numpy(), known, now)
            piece, language = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(language.astype(np.int32)), pa.array(sums[piece, language])],
                                             ["piece", "language", "n"])

        found = rows.mapInArrow(expect, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        p = np.full(p.shape, PRIOR)
        p[found.column("piece").to_numpy(), found.column("language").to_numpy()] += found.column("n").to_numpy()
        p /= p.sum(axis=0)
    return Model(names, np.log([documents[n] for n in names]), scaled(p, pieces.length))


# -- judging ---------------------------------------------------------------

class Judge:
    """Log probabilities of texts; those of tokens between white space are remembered up to some megabytes.

    A worker keeps what it remembers from task to task.
    """

    def __init__(self, pieces: Pieces, model: Model, memory: int = MEMORY):
        self.pieces, self.model, self.memory = pieces, model, memory << 20
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.value, self.letter, self.used = np.zeros((1024, len(self.model.languages))), np.zeros(1024, bool), 0

    def learn(self, tokens: list[str]) -> None:
        split = [units(t) for t in tokens]
        some = list(set().union(*split))
        at = dict(zip(some, range(len(some)), strict=True))
        each = log_likelihood(some, self.pieces, self.model.p)
        owner = np.repeat(np.arange(len(tokens)), [len(u) for u in split])
        mine = np.array([at[u] for us in split for u in us], np.int64)
        begin, end = len(self.place), len(self.place) + len(tokens)
        if end > len(self.value):
            more = max(end, 2 * len(self.value)) - len(self.value)
            self.value, self.letter = np.vstack([self.value, np.zeros((more, self.value.shape[1]))]), np.concatenate([self.letter, np.zeros(more, bool)])
        for k in range(self.value.shape[1]):
            self.value[begin:end, k] = np.bincount(owner, each[mine, k], len(tokens))
        self.letter[begin:end] = [any(map(str.isalpha, t)) if u else False for t, u in zip(tokens, split, strict=True)]
        self.place.update(zip(tokens, range(begin, end), strict=True))
        self.used += sum(map(len, tokens)) + len(tokens) * (160 + 8 * self.value.shape[1])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``[texts, languages]``, and whether a text has a letter."""
        split = [t.split() for t in texts]
        found = [list(map(self.place.get, some)) for some in split]
        new = {t for some, at in zip(split, found, strict=True) if None in at for t, k in zip(some, at, strict=True) if k is None}
        if new and self.used > self.memory:
            self.forget()
            new = set().union(*split)
        if new:
            self.learn(list(new))
            found = [list(map(self.place.__getitem__, some)) for some in split]
        out, letters = np.tile(self.model.prior, (len(texts), 1)), np.zeros(len(texts), bool)
        for d, at in enumerate(found):
            if at:
                out[d] += self.value[at].sum(axis=0)
                letters[d] = self.letter[at].any()
        return out, letters


def _judge(batches: Iterator[pa.RecordBatch], judge: Judge) -> Iterator[pa.RecordBatch]:
    """Adds a block of languages to what is known of a text: the best one, its log probability, and that of all."""
    model = judge.model
    for batch in batches:
        for part in slices(batch):
            found, letters = judge([t or "" for t in part.column("text").to_pylist()])
            best = found.argmax(axis=1)
            top = found[np.arange(len(found)), best]
            whole = np.logaddexp.reduce(found, axis=1)
            rows = []
            for d, (name, high, every) in enumerate(zip(*(part.column(c).to_pylist() for c in ("name", "high", "every")), strict=True)):
                if not letters[d]:
                    rows.append((None, None, None))
                elif name is None:
                    rows.append((model.languages[best[d]], top[d], whole[d]))
                else:
                    rows.append((model.languages[best[d]], top[d], np.logaddexp(whole[d], every)) if top[d] > high
                                else (name, high, np.logaddexp(whole[d], every)))
            new = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), *new], ["doc_id", "text", "name", "high", "every"])


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Ids whose checksum leaves 2 when divided by 4; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """The language of every text: ``doc_id, held_out, lang_pred, score``, one row per input row.

    Takes ``doc_id, text, lang``; other columns are ignored.  ``vocabulary`` is
    the file of a public sentencepiece model; its pieces are fixed, and each
    language gets a probability for each.  A unit (a run of letters,
    lower-cased) has the summed probability of all ways to cut it into pieces,
    by the forward algorithm, and a text the product of its units'.
    Probabilities are learned by expectation-maximisation from the unit counts
    of all rows with a language that are not held out; ``score`` is the
    posterior of the predicted language, with the number of learned rows as
    prior.

    A null text and one without a letter are ``und``, with score 0; so is every
    text when no row has a language.  Null ids are learned from.  A repeated
    row counts as often as it occurs, and ties go to the bytewise smaller
    language.  A run of over 64 bytes is cut into parts of 16 characters.  More than ``block`` languages
    are learned and judged in blocks, with equal results.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    learned = rows.where("lang is not null and text is not null").where(~held_out()).select("lang", "text")
    number = dict(sorted(learned.groupBy("lang").count().collect(), key=lambda r: r[0].encode()))
    judged = rows.select("doc_id", "text", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("high"), F.lit(None).cast("double").alias("every"))
    if number:
        pieces = Pieces(public_pieces(vocabulary))
        counts = stored(unit_counts(learned), "unit-counts")
        names = list(number)
        for at in range(0, len(names), block):
            model = fit(counts, {n: number[n] for n in names[at:at + block]}, pieces, rounds)
            sent = docs.sparkSession.sparkContext.broadcast(Judge(pieces, model))
            judged = judged.mapInArrow(lambda it, sent=sent: _judge(it, sent.value), "doc_id long, text string, name string, high double, every double")
    posterior = F.exp(F.least(F.col("high") - F.col("every"), F.lit(0.0)))
    return judged.select("doc_id", held_out().alias("held_out"), F.coalesce("name", F.lit(UNKNOWN)).alias("lang_pred"),
                         F.when(F.col("name").isNotNull(), posterior).otherwise(0.0).alias("score"))
