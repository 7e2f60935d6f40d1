"""A Merkle manifest of documents whose leaves find their place by bitmap rank."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.operators.ranks import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one slot array reduces: 2**LEVELS consecutive nodes.
LEVELS = 10
#: Bits that a step of the directory drops from a word's number: 58 = 10 + 3 * 16.
STEPS = (10, 16, 16)


# -- leaves ----------------------------------------------------------------

def digest(fields) -> Column:
    """SHA-256 of columns, each ``-`` if null, else UTF-8 byte count, ``:``, value; 32 bytes."""
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*[framed(f) for f in fields]), 256))


def tampered(doc_id: Column) -> Column:
    """Ids whose checksum 7 divides; a null id is none of them."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """``g, doc_id, leaf, changed``: the group's key, the leaf, and the leaf after tampering (null: as it was).

    ``g`` orders null first, then languages bytewise.
    """
    own = [F.col(c) for c in FIELDS]
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    other = [more if c == "n_chars" else F.col(c) for c in FIELDS]
    lang = F.col("lang").cast("string")
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), lang), F.lit("")).alias("g"), F.col("doc_id").cast("long").alias("doc_id"),
        digest(own).alias("leaf"), F.when(tampered(F.col("doc_id")), digest(other)).alias("changed"))


# -- coordinates -----------------------------------------------------------

def directory(rows: DataFrame) -> DataFrame:
    """Bitmaps of each group's ids with what a rank query needs: ``g, word, bits, repeats, before, size``.

    A row is a word of 64 ids that holds any; absent words take no space, so
    scattered ids cost a row each and dense ones a row for 64.  ``before``
    counts the group's rows in earlier words, from popcounts summed by ranges
    of words, ranges of ranges and so on: no step orders more than 65,536
    entries of one parent, whatever the ids are.  ``repeats`` lists the bits
    whose id has more than one row, and how many more.  Null ids come first;
    they are a row without a word.
    """
    ids = rows.groupBy("g", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    bit = F.col("doc_id").bitwiseAND(63).cast("int")
    words = ids.where("doc_id is not null").withColumns({"bit": bit, "word": F.shiftright("doc_id", 6)}).groupBy("g", "word").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("bits"), F.sum("n").alias("rows"),
        F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more")))).alias("repeats"))
    nothing = ids.where("doc_id is null").select("g", F.lit(None).cast("long").alias("key"), F.col("n").alias("rows"))

    words = stored(words, "bitmaps")
    levels = [words.select("g", F.col("word").alias("key"), "rows", F.shiftright("word", STEPS[0]).alias("up"))]
    for step in (*STEPS[1:], None):
        up = levels[-1].groupBy("g", F.col("up").alias("key")).agg(F.sum("rows").alias("rows"))
        levels.append(up.withColumn("up", F.shiftright("key", step)) if step else up.unionByName(nothing))

    def earlier(*keys: str) -> Column:
        over = Window.partitionBy("g", *keys).orderBy(F.asc_nulls_first("key")).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("rows").over(over), F.lit(0))

    known = levels[-1].select("g", "key", earlier().alias("before"), F.sum("rows").over(Window.partitionBy("g")).alias("size"))
    for level in reversed(levels[:-1]):
        above = known.where("key is not null").select("g", F.col("key").alias("up"), F.col("before").alias("above"), "size")
        inside = level.withColumn("inside", earlier("up")).join(above, ["g", "up"])
        lower = inside.select("g", "key", (F.col("above") + F.col("inside")).alias("before"), "size")
        known = lower.unionByName(known.where("key is null"))
    found = known.withColumnRenamed("key", "word")
    return found.where("word is not null").join(words.select("g", "word", "bits", "repeats"), ["g", "word"]).unionByName(
        found.where("word is null").select("*", F.lit(0).cast("long").alias("bits"), F.lit(None).cast("array<struct<bit:int,more:bigint>>").alias("repeats")))


def coordinates(rows: DataFrame) -> DataFrame:
    """Leaves with ``rank`` (from 0) in their group and the group's ``size``.

    The rank is what lies before the id's word plus the popcount of the lower
    bits of that word.  Only rows that share an id are ordered, by leaf, and
    those of equal leaves arbitrarily, with ranges that split an id of many
    rows.
    """
    index = stored(directory(rows), "directory")
    low = F.expr("bit_count(bits & ~shiftleft(-1L, cast(doc_id & 63 as int)))")
    named = rows.where("doc_id is not null").withColumn("word", F.shiftright("doc_id", 6)).join(
        index.where("word is not null"), ["g", "word"])
    placed = named.select(
        "g", "doc_id", "leaf", "changed", "size",
        (F.col("before") + low + F.expr("aggregate(filter(repeats, r -> r.bit < (doc_id & 63)), 0L, (s, r) -> s + r.more)")).alias("rank"),
        F.expr("exists(repeats, r -> r.bit = (doc_id & 63))").alias("shared"))
    unnamed = rows.where("doc_id is null").join(index.where("word is null").select("g", "before", "size"), "g").select(
        "g", "doc_id", "leaf", "changed", "size", F.col("before").alias("rank"), F.lit(True).alias("shared"))
    placed = stored(placed.unionByName(unnamed), "places")
    single, shared = placed.where("not shared"), placed.where("shared")
    if not shared.isEmpty():
        apart = numbered(shared, ["g", "doc_id"], ["leaf"], "among")
        single = single.unionByName(apart.withColumn("rank", F.col("rank") + F.col("among") - 1).drop("among"))
    return single.drop("shared")


# -- reduction -------------------------------------------------------------

def _parent(*nodes: bytes) -> bytes:
    return hashlib.sha256(b"".join(n.hex().encode() for n in nodes)).digest()


def _tree(nodes: list[bytes], left: int, most: int) -> list[list[bytes]]:
    """The levels above consecutive nodes, at most ``most``; ``left`` levels are missing to the group's root."""
    levels = [nodes]
    for _ in range(min(most, left)):
        now = levels[-1]
        levels.append([_parent(*now[i:i + 2]) for i in range(0, len(now), 2)])
    return levels


def _depth(size: int) -> int:
    return (size - 1).bit_length()


def _slots(table: pa.Table) -> tuple[list[bytes], np.ndarray]:
    """The nodes of one block put into their slots, and each row's slot."""
    slot = table.column("slot").to_numpy()
    held: list = [None] * len(slot)
    for s, node in zip(slot.tolist(), table.column("node").to_pylist(), strict=True):
        held[s] = node
    return held, slot


def _reduce(done: int, most: int):
    schema = pa.schema([("g", pa.string()), ("rank", pa.int64()), ("node", pa.binary()), ("size", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        size = table.column("size")[0].as_py()
        nodes, _ = _slots(table)
        root = _tree(nodes, max(0, _depth(size) - done), most)[-1][0]
        return pa.Table.from_pydict({"g": [table.column("g")[0].as_py()], "rank": [table.column("block")[0].as_py()],
                                     "node": [root], "size": [size]}, schema)

    return run


#: A step of a path: 0 no sibling, 1 sibling to the left, 2 to the right; then the sibling.
_NONE, _LEFT, _RIGHT = b"\x00" + bytes(32), b"\x01", b"\x02"


def _paths(levels: list[list[bytes]], slot: int) -> bytes:
    out = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        out.append(_NONE if other >= len(nodes) else (_LEFT if slot & 1 else _RIGHT) + nodes[other])
        slot >>= 1
    return b"".join(out)


def _descend(done: int, most: int):
    """Paths of a block's nodes from the path of the block."""
    schema = pa.schema([("g", pa.string()), ("rank", pa.int64()), ("node", pa.binary()), ("path", pa.binary())])

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        nodes, slot = _slots(table)
        levels = _tree(nodes, max(0, _depth(table.column("size")[0].as_py()) - done), most)
        path = above.column("path")[0].as_py()
        return pa.Table.from_arrays([table.column("g"), table.column("rank"), table.column("node"),
                                     pa.chunked_array([pa.array([_paths(levels, s) + path for s in slot.tolist()], pa.binary())])],
                                    schema=schema)

    return run


def _prove(table: pa.Table, above: pa.Table, most: int) -> pa.Table:
    """Whole proofs of the leaves of a block, folded from what each leaf is now."""
    nodes, slot = _slots(table)
    levels = _tree(nodes, _depth(table.column("size")[0].as_py()), most)
    path, subroot = above.column("path")[0].as_py(), above.column("subroot")[0].as_py()
    proofs, folded = [], []
    for s, leaf, changed in zip(slot.tolist(), table.column("node").to_pylist(), table.column("changed").to_pylist(), strict=True):
        own, node, siblings = _paths(levels, s) + path, leaf if changed is None else changed, []
        for at in range(0, len(own), 33):
            side, other = own[at:at + 1], own[at + 1:at + 33]
            if side == _LEFT:
                node = _parent(other, node)
            elif side == _RIGHT:
                node = _parent(node, other)
            else:
                node = _parent(node)
                continue
            siblings.append(other)
        proofs.append(_parent(*siblings).hex())
        folded.append(node.hex())
    return pa.Table.from_pydict({
        "doc_id": table.column("doc_id").combine_chunks(), "leaf": [n.hex() for n in table.column("node").to_pylist()],
        "subroot": [subroot.hex()] * len(slot), "proof_sha256": proofs, "folded_root": folded,
    }, pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]))


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"block": F.shiftright("rank", LEVELS), "slot": F.col("rank").bitwiseAND((1 << LEVELS) - 1).cast("int")})


def _climb(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of every round, the given ones first and each group's root last."""
    size = nodes.agg(F.max("size")).first()[0] or 1
    rounds = [nodes]
    for k in range(max(1, -(-_depth(size) // LEVELS))):
        grouped = _blocks(rounds[-1]).groupBy("g", "block")
        rounds.append(stored(grouped.applyInArrow(_reduce(k * LEVELS, LEVELS), "g string, rank long, node binary, size long"), "nodes"))
    return rounds


def _down(rounds: list[DataFrame], paths: DataFrame, to: int) -> DataFrame:
    """``g, rank, node, path`` of the nodes of round ``to`` from the paths of the last round's."""
    for k in range(len(rounds) - 2, to - 1, -1):
        above = paths.select("g", F.col("rank").alias("block"), "path").groupBy("g", "block")
        paths = _blocks(rounds[k]).groupBy("g", "block").cogroup(above).applyInArrow(
            _descend(k * LEVELS, LEVELS), "g string, rank long, node binary, path binary")
    return paths


def manifest(docs: DataFrame) -> DataFrame:
    """A Merkle tree over documents by language, and each document's proof checked against the root.

    Takes ``doc_id`` (long), ``source``, ``lang``, ``n_chars``, ``text``; other
    columns are ignored.  Returns one row per input row: ``doc_id, leaf,
    subroot, root, proof_sha256, folded_root, verified``.

    * A leaf is the SHA-256 of the five fields, framed by their length, null as
      ``-``.  Per language leaves ascend by id and every two consecutive nodes
      are hashed (as hex text) until one remains, the language's subroot; a
      last node without partner is hashed alone.  Subroots, null first and then
      bytewise, give the root in the same way.
    * No leaf is sorted: ids become bitmaps, and a leaf's place is a popcount
      (``directory``, ``coordinates``).  Blocks of 1,024 places are put into
      slots and reduced ten levels in one task; the next round does the same
      with the blocks' roots.  A task holds one block.
    * The proof lists the siblings from the leaf to the root.  Where 7 divides
      the checksum of the id, the leaf to fold is that of a document whose
      ``n_chars`` is one more (null stays null, and then it verifies).

    Null ids come first.  Rows of the same id are ordered by their leaf;
    repeated rows are leaves of their own.  A null text is ``-``, an empty one
    ``0:``.  A language of one document has its leaf as subroot; a table of one
    row has its leaf as root and a proof of no siblings.  No rows, no root.
    """
    nodes = stored(coordinates(stored(leaves(docs), "leaves")).withColumnRenamed("leaf", "node"), "coordinates")
    rounds = _climb(nodes)
    subroots = rounds[-1].select(F.col("g").alias("lang_key"), "node")
    ordered = numbered(subroots, [], ["lang_key"], "place")
    top = stored(ordered.select(F.lit("").alias("g"), (F.col("place") - 1).alias("rank"), "node",
                                F.count(F.lit(1)).over(Window.partitionBy()).alias("size"), "lang_key"), "subroots")
    above = _climb(top.drop("lang_key"))
    root = above[-1].select(F.lower(F.hex("node")).alias("root"))
    start = above[-1].select("g", "rank", "node", F.lit(b"").alias("path"))
    paths = _down(above, start, 0).join(top.select("rank", "lang_key"), "rank").select(
        F.col("lang_key").alias("g"), F.lit(0).cast("long").alias("rank"), "node", "path")
    paths = stored(paths, "top-paths")
    blocks = _down(rounds, paths, 1).select("g", F.col("rank").alias("block"), "path").join(
        paths.select("g", F.col("node").alias("subroot")), "g")
    most = LEVELS
    proved = _blocks(nodes).groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(
        lambda own, above: _prove(own, above, most), "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return proved.withColumn("root", root.scalar()).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
