"""Token ids as length-delimited binary records with an offset index."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import slices
from tidemark.session import scratch_path

#: Bytes of pieces and their ids that a worker remembers, with what a dictionary needs for each.
CACHE = 192 << 20
END, READ, ENTRY, SLICE, WORDS = 0, 4 << 20, 160, 4 << 20, 512

# -- checksums -------------------------------------------------------------

POLYNOMIAL, MASK, CHUNK, BLOCK = 0x82F63B78, 0xA282EAD8, 64, 4096


def _bytes_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


_TABLE = _bytes_table()
_AT = [_TABLE]  # of a byte followed by that many zero bytes
for _ in range(CHUNK - 1):
    _AT.append(_TABLE[_AT[-1] & 255] ^ (_AT[-1] >> 8))


def _then(op: np.ndarray, c: np.ndarray) -> np.ndarray:
    return op[0][c & 255] ^ op[1][(c >> 8) & 255] ^ op[2][(c >> 16) & 255] ^ op[3][c >> 24]


def _zeros() -> list[np.ndarray]:
    """Operators that append 1, 2, 4, ... zero bytes, each as tables of a state's four bytes."""
    one = np.stack([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)])
    ops = [np.stack([_TABLE[x & 255] ^ (x >> 8) for x in one])]
    for _ in range(40):
        ops.append(np.stack([_then(ops[-1], row) for row in ops[-1]]))
    return ops


_ZEROS = _zeros()


def masked_crc32c(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of byte spans, all at once.

    A checksum without its start value is linear: every 64-byte chunk (the
    first one padded in front, which changes nothing) is a sum of table
    entries, and chunks join by appending zeros: neighbours first, then pairs,
    so a span takes as many steps as the logarithm of its size.
    """
    count = -(-size // CHUNK)
    end = np.cumsum(count) * CHUNK
    padded = np.zeros(int(count.sum()) * CHUNK, np.uint8)
    for s, n, e in zip(start.tolist(), size.tolist(), end.tolist(), strict=True):
        padded[e - n:e] = data[s:s + n]
    grid, part = padded.reshape(-1, CHUNK), np.zeros(len(padded) // CHUNK, np.uint32)
    longest = int(size.max()) if len(size) else 0
    for at in range(0, len(grid), BLOCK):
        columns = np.ascontiguousarray(grid[at:at + BLOCK].T)
        for k in range(CHUNK - min(longest, CHUNK), CHUNK):
            part[at:at + BLOCK] ^= _AT[CHUNK - 1 - k][columns[k]]
    some, step = size > 0, CHUNK.bit_length() - 1
    while longest > 1 << step:
        odd = count & 1  # such a span gets a chunk of zeros in front
        count = (count + odd) // 2
        pairs = np.zeros((int(count.sum()), 2), np.uint32)
        pairs.reshape(-1)[np.arange(len(part)) + np.repeat(np.cumsum(odd), 2 * count - odd)] = part
        part = _then(_ZEROS[step], pairs[:, 0]) ^ pairs[:, 1]
        step += 1
    state = np.zeros(len(size), np.uint32)
    state[some] = part
    whole = np.full(len(size), 0xFFFFFFFF, np.uint32)
    for bit in range(longest.bit_length()):
        odd = (size >> bit & 1) == 1
        whole[odd] = _then(_ZEROS[bit], whole[odd])
    crc = state ^ whole ^ np.uint32(0xFFFFFFFF)
    return ((crc >> 15) | (crc << 17)) + np.uint32(MASK)


# -- ids -------------------------------------------------------------------

_WHITE = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]
_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"
_SPACES = re.escape("".join(_WHITE))
#: Pieces that hold a space, end in white space or are empty; and those that end in a letter or number.
_ODD, _WORD = f" |[{_SPACES}]$|^$", r"[\p{L}\p{N}]$"


def _strings(text: pa.Array) -> list[str]:
    return text.to_numpy(zero_copy_only=False).tolist()


def _taken(flat: np.ndarray, first: np.ndarray, size: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat[first[r]:first[r] + size[r]]`` of the rows, one after the other, and their sizes."""
    size = size[rows]
    ahead = np.cumsum(size) - size
    return flat[np.repeat(first[rows] - ahead, size) + np.arange(int(size.sum()))], size


class Encoder:
    """Ids of texts by a byte-level BPE vocabulary, remembered piece by piece.

    The vocabulary's pattern starts a new unit at a space between two
    non-spaces, and where ASCII marks other than an apostrophe follow a letter;
    the ids of such pieces do not depend on what stands around them.  So each
    distinct piece goes through the tokenizer once, and a text's ids are its
    pieces' ids in order.  Arrow finds the distinct pieces of the texts at
    hand, and only those are looked up.
    """

    def __init__(self, path: str, width: int = 2, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind, self.cache = Tokenizer.from_file(path), np.dtype(f"<u{width}"), cache
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # Texts with a space that does not stand between two non-spaces, or with a special token.
        self.uneven = "|".join(["  ", "^ ", " $", f"[{_SPACES}] ", f" [{_SPACES}]", *map(re.escape, self.special)])
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.forget()

    def forget(self) -> None:
        self.spaced: dict[str, int] = {}  # the number of a piece after its space
        self.marks: dict[str, int] = {}  # of marks as they stand
        # The ids of piece k: flat[first[k]:first[k + 1]]; both arrays have room at their end.
        self.flat, self.first, self.count = np.zeros(1 << 12, self.kind), np.zeros(1 << 10, np.int64), 0
        self.used = 0
        self._add(np.zeros(0, self.kind), np.zeros(1, np.int64))  # piece 0 has no ids

    def _add(self, ids: np.ndarray, size: np.ndarray) -> range:
        """Numbers of new pieces, whose ids follow each other."""
        at, to = int(self.first[self.count]), self.count + len(size)
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(at + 2 * len(ids), self.kind)])
        if to + 1 > len(self.first):
            self.first = np.concatenate([self.first[:self.count + 1], np.zeros(self.count + 2 * len(size), np.int64)])
        self.flat[at:at + len(ids)] = ids
        self.first[self.count + 1:to + 1] = at + np.cumsum(size)
        made, self.count = range(self.count, to), to
        return made

    def _ids(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces by number, one after the other, and how many each has."""
        first = self.first[:self.count + 1]
        return _taken(self.flat, first[:-1], np.diff(first), pieces)

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]

    def _alone(self, pieces: list[str]) -> range:
        found = self._each(pieces)
        return self._add(np.concatenate(found) if found else np.zeros(0, self.kind), np.array([len(x) for x in found], np.int64))

    def _joined(self, words: list[str]) -> range:
        """Words without white space, encoded as few texts and cut where a space begins a token."""
        ids = [np.array(self.tokenizer.encode_batch_fast([" " + " ".join(words[at:at + WORDS])], add_special_tokens=False)[0].ids, np.int64)
               for at in range(0, len(words), WORDS)]
        ids = np.concatenate([*ids, np.zeros(0, np.int64)])
        return self._add(ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids))))

    def _learn(self, new: pa.Array, spelled: list[str]) -> np.ndarray:
        """Remember pieces after their space; their numbers."""
        made, odd = np.zeros(len(new), np.int64), pc.match_substring_regex(new, _ODD).to_numpy(zero_copy_only=False)
        alone, joined = np.flatnonzero(odd), np.flatnonzero(~odd)
        made[alone] = self._alone([" " + spelled[k] for k in alone.tolist()])
        made[joined] = self._joined([spelled[k] for k in joined.tolist()])
        self._remember(new, spelled, made)
        return made

    def _remember(self, words: pa.Array, spelled: list[str], made: np.ndarray) -> None:
        self.spaced.update(zip(spelled, made.tolist(), strict=True))
        # Every piece is about as long as its ids.
        self.used += 2 * int(pc.sum(pc.binary_length(words)).as_py() or 0) + ENTRY * len(spelled)

    def _known(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; those not remembered yet are learnt."""
        spelled = _strings(words)
        found = np.fromiter(map(self.spaced.get, spelled, repeat(-1)), np.int64, len(spelled))
        new = np.flatnonzero(found < 0)
        if len(new):
            if self.used > self.cache:  # what these texts hold stays
                kept = np.flatnonzero(found >= 0)
                ids, size = self._ids(found[kept])
                self.forget()
                found[kept] = self._add(ids, size)
                self._remember(words.take(pa.array(kept)), [spelled[k] for k in kept.tolist()], found[kept])
            found[new] = self._learn(words.take(pa.array(new)), [spelled[k] for k in new.tolist()])
        return found

    def _pairs(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of each distinct piece without the marks at its end, and of these marks."""
        core = pc.ascii_rtrim(pieces, characters=_MARKS)
        size = pc.binary_length(pieces).to_numpy() - pc.binary_length(core).to_numpy()  # of ASCII marks, so of characters too
        marked = np.flatnonzero(size)
        some = pieces.take(pa.array(marked))
        ends = pc.and_not(pc.match_substring_regex(core.take(pa.array(marked)), _WORD), pc.match_substring_regex(some, _ODD))
        some, marked = some.filter(ends), marked[ends.to_numpy(zero_copy_only=False)]
        trimmed = np.zeros(len(pieces), bool)
        trimmed[marked] = True
        core = pc.if_else(pa.array(trimmed), core, pieces).dictionary_encode()
        pair = np.zeros((len(pieces), 2), np.int64)
        pair[:, 0] = self._known(core.dictionary)[core.indices.to_numpy()]
        marks = [p[-n:] for p, n in zip(_strings(some), size[marked].tolist(), strict=True)]
        fresh = list(set(marks) - self.marks.keys())
        if fresh:
            self.marks.update(zip(fresh, self._alone(fresh), strict=True))
            self.used += sum(map(len, fresh)) * 2 + ENTRY * len(fresh)
        pair[marked, 1] = list(map(self.marks.__getitem__, marks))
        return pair

    def _cut(self, text: str) -> list[str]:
        """A first piece and the pieces that follow a space each; texts that spell a special token stay whole."""
        return [text] if any(x in text for x in self.special) else _SAFE_SPACE.split(text)

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        whole = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        held = pa.large_list(pa.large_string())
        odd = pc.match_substring_regex(whole, self.uneven)
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable").tolist()
        split = pa.concat_arrays([pc.split_pattern(whole.filter(pc.invert(odd)), " ").cast(held),
                                  pa.array([self._cut(t) for t in _strings(whole.filter(odd))], held)])
        first = split.offsets.to_numpy() - split.offsets[0].as_py()
        pieces = split.flatten()
        heads = self._each(_strings(pieces.take(pa.array(first[:-1]))))
        follows = np.ones(len(pieces), bool)
        follows[first[:-1]] = False
        coded = pieces.filter(pa.array(follows)).dictionary_encode()
        flat, size = self._ids(self._pairs(coded.dictionary).reshape(-1))
        size = size.reshape(-1, 2).sum(axis=1)
        ids, size = _taken(flat, np.cumsum(size) - size, size, coded.indices.to_numpy())
        place = np.concatenate([[0], np.cumsum(size)])[first - np.arange(len(first))]  # of each text's ids, heads apart
        out: list[bytes] = [b""] * len(texts)
        for k, head, a, b in zip(order, heads, place.tolist(), place[1:].tolist(), strict=False):
            out[k] = head.tobytes() + ids[a:b].tobytes()
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int) -> Encoder:
    """The encoder of this worker: it loads the vocabulary once and remembers pieces from task to task."""
    if (path, width) not in _encoders:
        _encoders.clear()
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]


# -- files -----------------------------------------------------------------
# A record: length (8 bytes), masked checksum of these, payload, masked
# checksum of the payload.  A payload: 1 byte, 0 for a null id; the id (8
# bytes); token ids of equal width.  Numbers are little-endian.

_HEAD = "<?q"
_HEAD_SIZE = struct.calcsize(_HEAD)


def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def _write(batches: Iterator[pa.RecordBatch], folder: str, path: str, width: int, end: int) -> Iterator[pa.RecordBatch]:
    ids_of, place, out = encoder(path, width).ids, 0, None
    stop = np.array([end], f"<u{width}").tobytes()
    part = TaskContext.get().partitionId()
    # Each attempt writes a file of its own; the index, committed by Spark, names those that count.
    name = f"part-{part:06d}-{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex[:8]}.rec"
    try:
        for batch in batches:
            for piece in slices(batch, max_bytes=SLICE, max_rows=2048):
                doc_ids = piece.column("doc_id").to_pylist()
                payload = [struct.pack(_HEAD, i is not None, i or 0) + ids + stop
                           for i, ids in zip(doc_ids, ids_of(piece.column("text")), strict=True)]
                size = np.array([len(p) for p in payload])
                start = np.concatenate([[0], np.cumsum(size)[:-1]])
                sums = masked_crc32c(np.frombuffer(b"".join(payload), np.uint8), start, size)
                lengths = size.astype("<u8").view(np.uint8)
                length_sums = masked_crc32c(lengths, np.arange(len(size)) * 8, np.full(len(size), 8))
                if out is None:
                    system, root = _filesystem(folder)
                    system.create_dir(root, recursive=True)
                    out = system.open_output_stream(f"{root}/{name}", compression=None, buffer_size=READ)
                out.write(b"".join(struct.pack("<QI", n, a) + p + struct.pack("<I", b)
                                   for n, a, p, b in zip(size.tolist(), length_sums.tolist(), payload, sums.tolist(), strict=True)))
                offset = place + np.concatenate([[0], np.cumsum(size + 16)[:-1]])
                place = int(offset[-1] + size[-1] + 16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(size), pa.int32()), pa.array([name] * len(size)), pa.array(offset, pa.int64()),
                     pa.array(size, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array((size - _HEAD_SIZE) // width, pa.int64())],
                    ["part", "file", "offset", "length", "doc_id", "n_tokens"])
    finally:
        if out is not None:
            out.close()


def write_records(docs: DataFrame, folder: str, tokenizer: str, width: int = 2, end: int = END) -> DataFrame:
    """Encode texts and write records in ascending ``doc_id`` order (null first, then by text); returns the index.

    The index has ``part, file, offset, length, doc_id, n_tokens``: files in
    order of ``part``, a record's place and payload size in its file.  Texts
    move once, to be sorted by range; encoding and writing happen in the task
    that holds the sorted range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return rows.select("doc_id", "text").mapInArrow(
        lambda it: _write(it, folder, tokenizer, width, end),
        "part int, file string, offset long, length long, doc_id long, n_tokens long")


class DamagedRecord(ValueError):
    pass


def parse(block: bytes, last: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and sizes of the whole payloads in a block, checked, and the bytes they take."""
    start, size, sums, at = [], [], [], 0
    while at + 12 <= len(block):
        n, _ = struct.unpack_from("<QI", block, at)
        if at + 16 + n > len(block):
            break
        start.append(at + 12)
        size.append(n)
        sums.append((struct.unpack_from("<I", block, at + 8)[0], struct.unpack_from("<I", block, at + 12 + n)[0]))
        at += 16 + n
    if last and at != len(block):
        raise DamagedRecord("a record is cut short")
    data, start, size = np.frombuffer(block, np.uint8), np.array(start, np.int64), np.array(size, np.int64)
    held = np.array(sums, np.uint32).reshape(-1, 2)
    if (masked_crc32c(data, start - 12, np.full(len(start), 8)) != held[:, 0]).any() or (masked_crc32c(data, start, size) != held[:, 1]).any():
        raise DamagedRecord("a checksum differs")
    return start, size, at


def _payloads(folder: str, name: str) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    system, root = _filesystem(folder)
    with system.open_input_stream(f"{root}/{name}", compression=None) as source:
        held = b""
        while True:
            more = source.read(max(READ, len(held)))
            held += more
            start, size, used = parse(held, last=not more)
            if len(start):
                yield held, start, size
            held = held[used:]
            if not more:
                break


def _read(batches: Iterator[pa.RecordBatch], folder: str, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, at in zip(batch.column("file").to_pylist(), batch.column("begin").to_pylist(), strict=True):
            for block, start, size in _payloads(folder, name):
                rows = []
                for s, n in zip(start.tolist(), size.tolist(), strict=True):
                    known, doc_id = struct.unpack_from(_HEAD, block, s)
                    ids = np.frombuffer(block, f"<u{width}", (n - _HEAD_SIZE) // width, s + _HEAD_SIZE)
                    rows.append((doc_id if known else None, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_records(index: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """Read whole files back, checking every record: ``doc_id, start, n_tokens, ids_crc32``.

    ``start`` counts the ids of all records before, in file order.  Only one
    row per file is gathered to number the files; each file with its number is
    read in a task of its own, which needs nothing else.
    """
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("ids"))
    begin = files.select("file", (F.sum("ids").over(Window.orderBy("part", "file")) - F.col("ids")).alias("begin"))
    begin = stored(begin, "files")
    # A given number of partitions is not merged afterwards, as few small rows would be.
    return begin.repartition(max(1, begin.count())).mapInArrow(
        lambda it: _read(it, folder, width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(index: DataFrame, folder: str, width: int = 2) -> DataFrame:
    """Token ids of some rows of an index by offset, as a shuffled reader would: ``doc_id, ids``."""
    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, root = _filesystem(folder)
                with system.open_input_file(f"{root}/{row['file']}") as source:
                    source.seek(row["offset"])
                    block = source.read(row["length"] + 16)
                start, size, _ = parse(block, last=True)
                ids = np.frombuffer(block, f"<u{width}", (size[0] - _HEAD_SIZE) // width, start[0] + _HEAD_SIZE)
                yield pa.RecordBatch.from_pydict({"doc_id": [row["doc_id"]], "ids": [ids.tolist()]},
                                                 pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    return index.select("file", "offset", "length", "doc_id").mapInArrow(load, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, tokenizer: str, width: int = 2, end: int = END) -> DataFrame:
    """Write all documents as records in the shared folder and read them back.

    Takes ``doc_id, text``; other columns are ignored.  Returns one row per
    input row: ``doc_id, start, n_tokens, ids_crc32``; every document ends with
    the id ``end``.  Null and empty texts hold that id alone.  A null id comes
    first and is read back as null; rows of one id are ordered by a hash of
    their text, and repeated rows give repeated records.  No rows, no files.
    """
    folder = scratch_path(docs.sparkSession, "records")
    index = stored(write_records(docs, folder, tokenizer, width, end), "record-index")
    return read_records(index, folder, width)
