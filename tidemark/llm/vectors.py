"""Nearest neighbours by shifted Hilbert orderings, completed exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored

#: Orderings, projected dimensions, bits of each, neighbours per key window, rows of a scanned block and of its pruned parts.
CURVES, AXES, BITS, NEAR, BLOCK, PART = 8, 8, 7, 40, 1 << 15, 256
#: How far a product of unit vectors may lie from the exact cosine.
MARGIN = 1e-10


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions of integer cells ``[rows, axes]`` on a Hilbert curve of ``bits`` bits an axis, as unsigned integers.

    The transposed form of the curve is reached by undoing exchanges and
    inversions from the highest bit down, then Gray decoding; the key
    interleaves its bits.
    """
    x = cells.astype(np.uint64).T.copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        top, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for k in range(axes):
            set_ = (x[k] & top) > 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[k]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[k] ^= swap
    for k in range(1, axes):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & np.uint64(1 << level), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for k in range(axes):
            key = key << np.uint64(1) | x[k] >> np.uint64(level) & np.uint64(1)
    return key


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1).astype(np.float64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _order(batches: Iterator[pa.RecordBatch], curves: int, axes: int, bits: int) -> Iterator[pa.RecordBatch]:
    """A key of every vector on every curve; each curve has its own projection and shift."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            x = _unit(_matrix(part.column("vector")))
            for curve in range(curves):
                rng = np.random.default_rng(curve)
                y = x @ rng.standard_normal((x.shape[1], axes)) + rng.uniform(-0.5, 0.5, axes)
                # Projections of unit vectors are near normal: three deviations fill the grid.
                cells = np.clip((y + 3) / 6 * (1 << bits), 0, (1 << bits) - 1)
                key = hilbert_keys(cells, bits).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), curve), pa.int32()), pa.array(key), *part.columns],
                                                 ["curve", "key", *part.schema.names])


def _ranked(keyed: DataFrame) -> DataFrame:
    """Rows with their rank along each curve: a range sort, and one counted row per partition and curve."""
    sorted_ = stored(keyed.repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node").select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")), "curves")
    parts = sorted_.groupBy("curve", "part").agg(F.count("*").alias("rows"), F.min("line").alias("begin"))
    before = F.sum("rows").over(Window.partitionBy("curve").orderBy("part")) - F.col("rows")
    parts = parts.select("curve", "part", (before - F.col("begin")).alias("move"))
    return sorted_.join(parts, ["curve", "part"]).withColumn("rank", F.col("line") + F.col("move")).drop("part", "line", "move")


def _cosines(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosines as the result's expression gives them, summed in order."""
    dot, norms, norm = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    with np.errstate(all="ignore"):
        for c, x in zip(rows.T, one, strict=True):
            dot, norms, norm = dot + c * x, norms + c * c, norm + x * x
        return dot / (np.sqrt(norms) * np.sqrt(norm))


def _best(scores: np.ndarray, one: np.ndarray, rows: np.ndarray, least: np.ndarray, nodes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k nearest rows to ``one``, ties to the smaller id.

    ``scores`` are near the cosines, -9 for rows that are no candidates; all
    rows that may be among the k nearest are scored exactly.
    """
    at_least = np.partition(scores, -k)[-k] - MARGIN if len(scores) > k else -8
    some = np.flatnonzero(scores >= max(at_least, -8))
    exact = _cosines(rows[some], one)
    exact = np.where(np.isfinite(exact), exact, scores[some])  # sums of very large or small squares
    order = np.lexsort((nodes[some], least[some], -exact))[:k]
    return some[order], exact[order]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys, from rows that come sorted by them."""
    held: list[pa.RecordBatch] = []

    def key_of(batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            piece = batch.slice(a, b - a)
            if held and key_of(held[0], 0) != key_of(piece, 0):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _answers(rows: list[tuple[int, int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)],
                                      ["query", "node", "least", "score"])


def _windows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each query in a block of neighbouring keys, the k nearest rows there."""
    for table in _groups(batches, ["curve", "block"]):
        asks = table.column("asks").to_numpy()
        nodes, least = table.column("node").to_numpy(), table.column("least").to_numpy()
        raw = _matrix(table.column("vector").combine_chunks())
        x = _unit(raw)
        mine, there = np.flatnonzero(asks), np.flatnonzero(~asks)
        rows = []
        if len(mine) and len(there):
            names, ids, vectors = nodes[there], least[there], raw[there]
            for q, one, scores in zip(nodes[mine], raw[mine], x[mine] @ x[there].T, strict=True):
                places, exact = _best(np.where(names == q, -9.0, scores), one, vectors, ids, names, k)
                rows += [(int(q), int(names[j]), int(ids[j]), float(e)) for j, e in zip(places, exact, strict=True)]
        yield _answers(rows)


def _complete(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Queries against one block of rows, parts of which are skipped where no row can come nearer than what is known.

    Rows come first, in curve order, then the queries with the score of their
    k-th neighbour so far.  A part's rows lie within an angle of its centre, so
    the angle to the centre less that bounds the angle to any of them.
    """
    def prepare(nodes: np.ndarray, least: np.ndarray, raw: np.ndarray, x: np.ndarray):
        cuts = range(0, len(nodes), PART)
        centre = np.stack([x[a:a + PART].mean(axis=0) for a in cuts])
        length = np.sqrt((centre * centre).sum(axis=1, keepdims=True))
        centre = np.divide(centre, length, out=np.zeros_like(centre), where=length > 1e-12)
        reach = np.array([np.arccos(np.clip((x[a:a + PART] @ c).min(), -1, 1)) for a, c in zip(cuts, centre, strict=True)])
        reach[length[:, 0] <= 1e-12] = np.pi
        return nodes, least, raw, x, centre, reach

    def ask(block, queries: np.ndarray, asked: np.ndarray, y: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
        nodes, least, raw, x, centre, reach = block
        angle = np.arccos(np.clip(y @ centre.T, -1, 1)) - reach
        open_ = angle <= np.arccos(np.clip(known, -1, 1))[:, None] + 1e-6
        rows = []
        for part in np.flatnonzero(open_.any(axis=0)):
            at = slice(part * PART, part * PART + PART)
            who = np.flatnonzero(open_[:, part])
            scores = y[who] @ x[at].T
            scores[queries[who][:, None] == nodes[at]] = -9.0
            for q in np.flatnonzero((scores >= known[who][:, None] - MARGIN).any(axis=1)):
                places, exact = _best(scores[q], asked[who[q]], raw[at], least[at], nodes[at], k)
                rows += [(int(queries[who[q]]), int(nodes[at][j]), int(least[at][j]), float(e)) for j, e in zip(places, exact, strict=True)
                         if e >= known[who[q]]]
        return _answers(rows)

    block, held, name = None, [], None
    for batch in batches:
        blocks = batch.column("block").to_numpy()
        asks = batch.column("asks").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            nodes, least = batch.column("node").to_numpy()[a:b], batch.column("least").to_numpy()[a:b]
            raw = _matrix(batch.column("vector").slice(a, b - a))
            x = _unit(raw)
            if name != blocks[a]:
                block, held, name = None, [], blocks[a]
            if not asks[a]:
                held.append((nodes, least, raw, x))
            elif held or block:
                if block is None:
                    block, held = prepare(*(np.concatenate(some) for some in zip(*held, strict=True))), []
                yield ask(block, nodes, raw, x, batch.column("known").to_numpy()[a:b])


def usable(vector: Column) -> Column:
    """Neither null nor zero, and all components present and finite."""
    finite = ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda c: c != 0), F.lit(False))


def nearest(vectors: DataFrame, asks: Column, k: int = 5, curves: int = CURVES, near: int = NEAR, exact: bool = True) -> DataFrame:
    """The k nearest vectors by cosine of each row for which ``asks`` holds: ``query_id, rank, vec_id, score``.

    Takes ``vec_id`` and ``embedding``; other columns are ignored.  Neighbours
    come nearest first, ties by smaller id; a query's own id is no candidate.

    Equal vectors are one node with its k + 1 smallest ids.  Nodes are sorted
    along ``curves`` Hilbert curves of shifted random projections by range
    partitioning; each curve is cut in windows of ``near`` ranks, and a query
    meets its own and both adjacent windows.  The merged, reranked windows give
    each query a k-th score that no answer may fall below; whatever may be among
    the k nearest of a window is scored exactly, and ties go to the node of the
    smaller least id.  With ``exact``, the
    queries then pass all rows in blocks of the first curve, skipping the parts
    whose rows provably lie farther: near queries skip almost everything, and
    queries without near neighbours, which no ordering can serve, stay right.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows of a null id, nor vectors of another length than the most
    frequent one (of equals the smaller).  Repeated rows count once; an id with
    several vectors asks with its first in order and is found by its nearest.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
                          F.coalesce(asks, F.lit(False)).alias("asks")).filter("vec_id is not null").filter(usable(F.col("vector")))
    length = rows.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), "length").first()
    rows = rows.filter(F.size("vector") == (length["length"] if length else 0)).distinct()
    if not length:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    nodes = few.groupBy("vector").agg(F.min("vec_id").alias("least"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    # The smallest id names a node; nodes of one id and several vectors are told apart by order.
    nodes = stored(nodes.select(F.col("least"), "ids", "vector"), "nodes")
    named = nodes.withColumn("node", F.xxhash64("least", "vector"))
    asking = rows.filter("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")).join(
        named.select("vector", "node"), "vector").select(F.col("vec_id").alias("query_id"), "node")
    asking = stored(asking, "queries")
    seeks = asking.select("node").distinct().withColumn("seeks", F.lit(True))
    plain = named.join(seeks, "node", "left").select("node", "least", F.coalesce("seeks", F.lit(False)).alias("seeks"), "vector")
    ranked = _ranked(plain.mapInArrow(lambda it: _order(it, curves, AXES, BITS),
                                      "curve int, key long, node long, least long, seeks boolean, vector array<double>"))

    block = F.floor(F.col("rank") / near)
    put = ranked.select("curve", block.alias("block"), F.lit(False).alias("asks"), "node", "least", "vector")
    sent = ranked.filter("seeks").select("curve", F.explode(F.array(block - 1, block, block + 1)).alias("block"), F.lit(True).alias("asks"),
                                         "node", "least", "vector")
    met = put.unionByName(sent).repartition("curve", "block").sortWithinPartitions("curve", "block")
    answer = "query long, node long, least long, score double"
    best = Window.partitionBy("query").orderBy(F.desc("score"), "least", "node")
    found = met.mapInArrow(lambda it: _windows(it, k), answer).distinct()
    found = stored(found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k), "neighbours")
    if exact:
        known = found.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n")).select(
            F.col("query").alias("node"), F.when(F.col("n") >= k, F.col("score")).otherwise(-2.0).alias("known"))
        base = ranked.filter("curve = 0").select("rank", "seeks", "node", "least", "vector")
        blocks = max(1, -(-base.count() // BLOCK))
        held = base.select(F.floor(F.col("rank") / BLOCK).alias("block"), F.lit(False).alias("asks"), "rank", "node", "least", "vector",
                           F.lit(0.0).alias("known"))
        posed = base.filter("seeks").join(known, "node", "left").select(
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("asks"), "rank", "node", "least", "vector",
            F.coalesce("known", F.lit(-2.0)).alias("known"))
        passed = held.unionByName(posed).repartition("block").sortWithinPartitions("block", "asks", "rank")
        found = found.drop("place").unionByName(passed.mapInArrow(lambda it: _complete(it, k), answer)).distinct()
        found = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    # A node's own ids are neighbours of each other.
    own = asking.select(F.col("node").alias("query")).distinct().select("query", F.col("query").alias("node"))
    pairs = found.select("query", "node").unionByName(own)
    vector = named.select("node", "ids", "vector")
    full = pairs.join(vector, "node").join(vector.select(F.col("node").alias("query"), F.col("vector").alias("mine")), "query")
    dot = F.aggregate(F.zip_with("vector", "mine", lambda a, b: a * b), F.lit(0.0), lambda s, c: s + c)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, c: s + c * c))
    scored = full.select("query", F.explode("ids").alias("vec_id"), (dot / (norm("vector") * norm("mine"))).alias("score"))
    out = asking.join(scored, asking["node"] == scored["query"]).filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
