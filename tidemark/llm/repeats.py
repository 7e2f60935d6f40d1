"""Long repeated byte strings, found by longest-previous-factor arrays over anchored suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import U, mix, powers, slices, text_buffer

LENGTH, GRAM = 200, 48
#: Text bytes per piece of a scan, contexts sorted together, and contexts of one anchor beyond which they are dealt by string.
PIECE, SORTED, CROWD = 1 << 20, 1000, 2000
#: Of a context: its anchor, its hash, occurrences, least and greatest id, and the first occurrence.
KNOWN = ["gram", "context", "n", "least_id", "last_id", "id", "text_hash", "begin"]


# -- anchors -----------------------------------------------------------------

def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    out = x
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return out if span == width else np.minimum(out[:len(x) - width + 1], out[width - span:])


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of string starts that share an anchor: ``text, begin, starts, gram_hash, context_hash``.

    The anchor of a string of ``length`` bytes is its ``gram``-byte piece of the
    smallest hash, the leftmost of equals, so equal strings have equal anchors
    at equal places.  Consecutive starts with one anchor form a run, and its
    context is what their strings cover.
    """
    if len(data) < length:
        return None
    up, down = powers(len(data) + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * up[:len(data)])])

    def hashes(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))

    place = np.arange(len(data) - gram + 1)
    h = hashes(place, place + gram)
    least = sliding_min((h >> U(26) << U(26)) | place.astype(U), length - gram + 1)
    at = (least & U((1 << 26) - 1)).astype(np.int64)  # the anchor of each start
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(at)]
    whole = np.arange(len(at)) + length <= offsets[1:][text]
    new = whole.copy()
    new[1:] &= (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    starts = np.bincount(run[whole], minlength=len(begin)) if len(begin) else np.zeros(0, np.int64)
    anchor = at[begin] - begin
    return text[begin], begin, starts, h[at[begin]], mix(hashes(begin, begin + starts + length - 1) ^ anchor.astype(U))


def _pieces(part: pa.RecordBatch, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, offsets and first places of texts; a long text comes in pieces that share ``length - 1`` bytes."""
    data, offsets = text_buffer(part.column("text"))
    if len(data) <= 4 * PIECE:
        yield data, offsets, np.zeros(len(offsets) - 1, np.int64)
        return
    for at in range(0, len(data), PIECE):  # a text over the piece size is alone in its slice
        some = data[at:at + PIECE + length - 1]
        yield some, np.array([0, len(some)]), np.array([at])


def _salt(part: pa.RecordBatch) -> np.ndarray:
    return mix(part.column("salt").to_numpy(zero_copy_only=False).view(U))


def _anchors(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, max_bytes=PIECE):
            for data, offsets, first in _pieces(part, length):
                if (found := contexts(data, offsets, length, gram)) is None:
                    continue
                text, begin, starts, gram_hash, context_hash = found
                keys = [part.column(c).take(pa.array(text)) for c in ("doc_id", "text_hash")]
                salt = _salt(part)[text]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array((gram_hash ^ salt).view(np.int64)), pa.array((context_hash ^ salt).view(np.int64)),
                     pa.array(begin - offsets[text] + first[text]), pa.array(starts)],
                    ["doc_id", "text_hash", "gram", "context", "begin", "starts"])


def _bytes_of(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted contexts, with what is known of them."""
    for batch in batches:
        for part in slices(batch, max_bytes=PIECE):
            text = [t.encode() for t in part.column("text").to_pylist()]
            rows = []
            for t, wanted in zip(text, part.column("wanted").to_pylist(), strict=True):
                rows += [[w[c] for c in KNOWN] + [t[w["begin"]:w["begin"] + w["starts"] + length - 1]] for w in wanted]
            columns = list(zip(*rows, strict=True)) or [()] * (len(KNOWN) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], pa.binary())],
                                             [*KNOWN, "bytes"])


# -- longest previous factors ------------------------------------------------

def suffix_ranks(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of the substrings of 8, 24, 72, ... and ``length`` bytes at every place.

    Each step joins three ranks (two, where three would not fit 63 bits) of the
    step before, the last ones overlapping.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + length]
    value = np.zeros(n + length, U)
    for k in range(8):
        value = value << U(8) | words[:, k]
    out, size = [(8, np.unique(value, return_inverse=True)[1])], 8
    while size < length:
        rank, wide = out[-1][1], len(value).bit_length()
        size, at = (min(3 * size, length), [size, 2 * size]) if 3 * wide <= 63 else (min(2 * size, length), [size])
        joined = rank.astype(np.int64)
        for step in at:
            step = min(step, size - out[-1][0])
            joined = joined << wide | np.concatenate([rank[step:], np.zeros(step, rank.dtype)])
        out.append((size, np.unique(joined, return_inverse=True)[1]))
    return out


def previous_smaller(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each rank the nearest rank before it with a smaller position, and the least ``lcp`` on the way.

    ``lcp[r]`` is shared with rank r - 1.  Ranks point at their left neighbour
    and jump along its pointer until the position is smaller; all between are
    larger, so pointers of unfinished ranks may be followed as well, which
    doubles the distance.
    """
    to = np.arange(-1, len(order) - 1)
    shared = lcp.copy()
    going = np.flatnonzero((to >= 0) & (order[np.maximum(to, 0)] > order))
    while len(going):
        via = to[going]
        shared[going], to[going] = np.minimum(shared[going], shared[via]), to[via]
        going = going[(to[going] >= 0) & (order[np.maximum(to[going], 0)] > order[going])]
    shared[to < 0] = 0
    return to, shared


def longest_factors(data: np.ndarray, place: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest previous and next factors of ``place``s (ascending) within their groups, capped at ``length``.

    Also a number for each place, equal where group and ``length`` bytes are.

    The suffixes are sorted by group and their first ``length`` bytes; the
    neighbours of smaller position on either side in that order hold the
    longest earlier match, those of larger position the longest later one.
    """
    ranks = suffix_ranks(data, length)
    whole = ranks[-1][1]
    order = np.argsort(group << 32 | whole[place], kind="stable")
    a, b = place[order[:-1]], place[order[1:]]
    shared = np.zeros(len(a), np.int64)
    for size, rank in [r for r in reversed(ranks[:-1]) for _ in range(2)]:
        shared = np.where(shared + size <= length, shared + size * (rank[a + shared] == rank[b + shared]), shared)
    for _ in range(7):
        more = (shared < length) & (data[np.minimum(a + shared, len(data) - 1)] == data[np.minimum(b + shared, len(data) - 1)])
        shared = shared + more
    shared = np.where(whole[a] == whole[b], length, np.minimum(shared, length - 1))
    shared[group[order[:-1]] != group[order[1:]]] = 0
    lcp = np.concatenate([[0], shared])
    out = []
    for position in (order, -order):
        left = previous_smaller(position, lcp)[1]
        right = previous_smaller(position[::-1], np.concatenate([[0], lcp[1:][::-1]]))[1][::-1]
        factor = np.zeros(len(place), np.int64)
        factor[order] = np.maximum(left, right)
        out.append(factor)
    same = np.empty(len(place), np.int64)
    same[order] = np.cumsum(lcp < length)
    return out[0], out[1], same


def _spans(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _resolve(batches: Iterator[pa.RecordBatch], length: int, distinct: bool) -> Iterator[pa.RecordBatch]:
    """Starts of contexts that are repeated, and that are repeated earlier; rows come sorted by anchor and first occurrence."""
    def settle(table: pa.Table) -> pa.RecordBatch:
        held = table.combine_chunks()
        text = held.column("bytes").to_pylist()
        size = np.array([len(t) for t in text])
        data = np.frombuffer(b"".join(text), np.uint8)
        starts = size - length + 1
        context = np.repeat(np.arange(len(size)), starts)
        inside = np.arange(len(context)) - (np.cumsum(starts) - starts)[context]
        place = (np.cumsum(size) - size)[context] + inside
        group = np.unique(held.column("gram").to_numpy(), return_inverse=True)[1]
        before, after, same = longest_factors(data, place, group[context], length)
        if distinct:  # another id must hold it, not only another place
            ends = [(pc.fill_null(held.column(c), default).to_numpy()[context], fold, default) for c, fold, default in (
                ("least_id", np.minimum, np.iinfo(np.int64).max), ("last_id", np.maximum, np.iinfo(np.int64).min))]
            bound = []
            for ids, fold, default in ends:
                bound.append(np.full(same.max(initial=0) + 1, default))
                fold.at(bound[-1], same, ids)
            again = (bound[0] < bound[1])[same]
        else:
            again = (before >= length) | (after >= length) | (held.column("n").to_numpy()[context] > 1)
        begin = np.concatenate([[0], np.cumsum(starts)])
        spans = [_spans(again[begin[c]:begin[c + 1]]) for c in range(len(size))]
        later = [_spans(before[begin[c]:begin[c + 1]] >= length) for c in range(len(size))]
        pairs = pa.list_(pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([held.column("gram").combine_chunks(), held.column("context").combine_chunks(), pa.array(spans, pairs),
                                           pa.array(later, pairs)], ["gram", "context", "spans", "later"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, SORTED):
            held.append(batch.slice(at, SORTED))
            table = pa.Table.from_batches(held)
            if len(table) >= SORTED:  # all but the last anchor are complete
                gram = table.column("gram").to_numpy()
                cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if (gram != gram[-1]).any() else 0
                if cut:
                    yield settle(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield settle(pa.Table.from_batches(held))


def _each_string(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """A row for every string of a context of a crowded anchor."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            text = part.column("bytes").to_pylist()
            starts = np.array([len(t) - length + 1 for t in text])
            context = np.repeat(np.arange(len(text)), starts)
            place = np.arange(len(context)) - (np.cumsum(starts) - starts)[context]
            digest = [hashlib.blake2b(text[c][p:p + length], digest_size=16).digest() for c, p in zip(context, place, strict=True)]
            columns = [part.column(c).take(pa.array(context)) for c in KNOWN]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(place, pa.int32()), pa.array(digest, pa.binary())], [*KNOWN, "place", "digest"])


# -- the operator ------------------------------------------------------------

def repeated_starts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False,
                    distinct: bool = False) -> DataFrame:
    """Covered byte ranges ``doc_id, text_hash, from, to`` of ``doc_id, text_hash, salt, text`` rows.

    Strings are compared among rows of equal ``salt``; with ``distinct`` another
    ``doc_id`` must hold a string.  Rows of equal hash have equal texts (and
    salts); every row counts as a place.
    """
    def scan() -> DataFrame:
        return texts.mapInArrow(lambda it: _anchors(it, length, gram),
                                "doc_id long, text_hash long, gram long, context long, begin long, starts long")

    # A first scan counts anchors; a unique one has no repeated string.
    seen = scan().groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("lo"), F.max("context").alias("hi"),
                                      *([F.min(F.struct("doc_id", "text_hash", "begin")).alias("origin")] if keep_first else []))
    seen = stored(seen.filter("n > 1").select("gram", (F.col("lo") < F.col("hi")).alias("mixed"), *(["origin"] if keep_first else [])), "anchors")
    met = stored(scan().join(seen, "gram"), "places")

    # Anchors of one context: every string of it is repeated.  Of several: the suffixes decide.
    place = F.struct("doc_id", "text_hash", "begin")
    mixed = stored(met.filter("mixed").groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(place).alias("origin"), F.min("doc_id").alias("least_id"),
        F.max("doc_id").alias("last_id"), F.first("starts").alias("starts")), "contexts")
    wanted = mixed.groupBy(F.col("origin.text_hash").alias("text_hash")).agg(F.collect_list(F.struct(
        "gram", "context", "n", "least_id", "last_id", F.col("origin.doc_id").alias("id"),
        F.col("origin.text_hash").alias("text_hash"), F.col("origin.begin").alias("begin"), "starts")).alias("wanted"))
    one = texts.select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["text_hash"])
    known = ", ".join(f"{c} long" for c in KNOWN)
    held = stored(one.mapInArrow(lambda it: _bytes_of(it, length), f"{known}, bytes binary"), "context-bytes")
    crowd = held.groupBy("gram").agg(F.count("*").alias("size")).filter(F.col("size") > CROWD).select("gram")
    few = held.join(crowd, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram", "id", "text_hash", "begin")
    verdict = few.mapInArrow(lambda it: _resolve(it, length, distinct),
                             "gram long, context long, spans array<array<int>>, later array<array<int>>")
    many = held.join(crowd, "gram").mapInArrow(lambda it: _each_string(it, length), f"{known}, place int, digest binary").withColumn(
        "origin", F.struct("id", "text_hash", "begin"))
    again = many.groupBy("gram", "digest").agg(F.sum("n").alias("total"), F.min("least_id").alias("a"), F.max("last_id").alias("z"),
                                               F.min("origin").alias("earliest"))
    back = many.select("gram", "digest", "context", "origin", "place").join(
        again.filter("a < z" if distinct else "total > 1"), ["gram", "digest"])
    start = F.array("place", F.col("place") + 1)
    verdict = verdict.unionByName(back.groupBy("gram", "context").agg(
        F.collect_list(start).alias("spans"), F.collect_list(F.when(F.col("origin") != F.col("earliest"), start)).alias("later")))

    everything = F.array(F.array(F.lit(0), F.col("starts").cast("int")))
    alone = met.filter("not mixed").withColumn("spans", everything)
    if distinct:
        apart = alone.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z")
        alone = alone.join(apart.select("gram"), "gram", "left_semi")
    mark = met.drop("origin").filter("mixed").join(verdict, ["gram", "context"])
    if keep_first:
        alone = alone.filter(place != F.col("origin"))
        mark = mark.join(mixed.select("gram", "context", "origin"), ["gram", "context"]).withColumn(
            "spans", F.when(place == F.col("origin"), F.col("later")).otherwise(everything))
    both = alone.select("doc_id", "text_hash", "begin", "spans").unionByName(mark.select("doc_id", "text_hash", "begin", "spans"))
    return both.select("doc_id", "text_hash", "begin", F.explode("spans").alias("s")).select(
        "doc_id", "text_hash", (F.col("begin") + F.col("s")[0]).alias("from"), (F.col("begin") + F.col("s")[1] + (length - 1)).alias("to"))


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            rows = []
            for text, cover in zip(part.column("text").to_pylist(), part.column("cover").to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), np.uint8)
                step = np.zeros(len(data) + 1, np.int32)
                if cover:
                    at = np.array([(c["from"], c["to"]) for c in cover], np.int64)
                    np.add.at(step, at[:, 0], 1)
                    np.add.at(step, at[:, 1], -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = data[~gone].tobytes()
                rows.append((len(data), int(gone.sum()), len(_spans(gone)), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, with_text: bool = False) -> DataFrame:
    """Remove bytes covered by a ``length``-byte string that also starts elsewhere.

    Takes ``doc_id, text``; other columns are ignored.  Returns one row per
    input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``
    (``kept``, the bytes left, is null unless ``with_text``).  Strings are
    judged on the input and never cross documents.  With ``keep_first`` a
    string stays where it occurs first, by id, a hash of the text and place.

    Strings meet by anchor, the piece of smallest hash in them, so only about
    one place in seventy is shuffled.  Anchors that occur once are dropped,
    and anchors whose surroundings are all alike are settled by counting.  For
    the rest, one copy of each distinct surrounding is fetched, and their
    suffixes are sorted: previous and next smaller positions in suffix order
    give the longest earlier and later matches.  An anchor with more than
    ``CROWD`` distinct surroundings is dealt by string instead of being sorted
    in one task, with the same result.

    Null and empty texts have no bytes and lose none.  Repeated rows are copies
    of each other, and so lose every string of ``length`` bytes (with
    ``keep_first``, rows of one id and text count as one place).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    found = repeated_starts(rows.withColumn("salt", F.lit(0).cast("long")), length, gram, keep_first)
    key = ["doc_id", "text_hash"] if keep_first else ["text_hash"]  # else texts decide, whatever their ids
    cover = found.select(*key, "from", "to").distinct().groupBy(*key).agg(F.collect_list(F.struct("from", "to")).alias("cover"))
    same = F.col("d.text_hash") == F.col("c.text_hash")
    if keep_first:
        same &= F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))
    return rows.alias("d").join(cover.alias("c"), same, "left").select("d.doc_id", "d.text", "c.cover").mapInArrow(
        lambda it: _cut(it, with_text),
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
