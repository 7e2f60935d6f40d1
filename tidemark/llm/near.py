"""Near-duplicate groups by one-permutation MinHash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import components, discard, empty, stored
from tidemark.llm.words import U, mix, shingle_sets, slices

#: Bands of rows: a pair at similarity 0.8 shares no band once in 200,000 pairs, at 0.85 once in 40 million.
BANDS, ROWS = 40, 6
#: Classes that hold a rare shingle at most; what is not rare is compared by bounds, so this decides work and no result.
RARE = 16


def signatures(sets, bins: int) -> np.ndarray:
    """One permutation, ``bins`` minima; empty bins copy a full one chosen by a universal hash.

    The densification is the optimal one: the bin probed at each attempt
    depends on the empty bin and the attempt alone, so two sets that have the
    same bin empty look up the same bin.
    """
    n = len(sets.first) - 1
    doc = np.repeat(np.arange(n), np.diff(sets.first))
    place = ((sets.hash >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    new = np.ones(len(doc), bool)  # hashes ascend, so the first of a bin is its minimum
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
    sig, full = np.zeros((n, bins), U), np.zeros((n, bins), bool)
    sig[doc[new], place[new]] = sets.hash[new]
    full[doc[new], place[new]] = True
    row, column = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 0
    while len(row):
        attempt += 1
        if attempt <= 8 * bins:
            probe = (mix(column.astype(U) * U(0x10001) + U(attempt << 20)) % U(bins)).astype(np.int64)
        else:
            probe = (column + attempt) % bins
        hit = full[row, probe]
        sig[row[hit], column[hit]] = sig[row[hit], probe[hit]]
        row, column = row[~hit], column[~hit]
    return sig


def _fingerprints(sets) -> list[np.ndarray]:
    """Two 64-bit sums over each set; equal sets have equal ones."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(sets.hash ^ U(seed)))]) for seed in (0x5BD1E995, 0x1B873593)]
    return [(s[sets.first[1:]] - s[sets.first[:-1]]).view(np.int64) for s in sums]


def _sign(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column("text"), shingle)
            size = np.diff(sets.first)
            sig = signatures(sets, bands * rows).reshape(len(size), bands, rows)
            key = np.broadcast_to(np.arange(bands, dtype=U), (len(size), bands)).copy()
            for r in range(rows):
                key = mix(key * U(0x9E3779B97F4A7C15) ^ sig[:, :, r])
            f1, f2 = _fingerprints(sets)
            flat = pa.array(key.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1) * bands, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(size, pa.int64()), pa.array(f1), pa.array(f2), lists],
                ["doc_id", "n", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The shingle hashes of each text, ascending, with its first fingerprint."""
    for batch in batches:
        for part in slices(batch):
            sets = shingle_sets(part.column("text"), shingle)
            lists = pa.ListArray.from_arrays(pa.array(sets.first, pa.int32()), pa.array(sets.hash.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_fingerprints(sets)[0]), lists], ["rep", "f1", "hashes"])


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that meet the threshold, compared whole and in integers."""
    for batch in batches:
        left, right = (batch.column(c) for c in ("hashes_a", "hashes_b"))
        keep = []
        for d in range(batch.num_rows):
            x, y = left[d].values.to_numpy(), right[d].values.to_numpy()
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _open(bucket: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component."""
    now = bucket.join(label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", "f1", "n", F.coalesce("root", "rep").alias("root"))
    apart = now.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    return stored(now.join(apart, "key", "left_semi"), "open")


def _may_link(n: str, m: str, both, percent: int):
    """Whether sets of ``n`` and ``m`` that share at most ``both`` shingles can meet the threshold."""
    return both * 100 >= (F.col(n) + F.col(m) - both) * percent


def _remaining(now: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, rare: int) -> DataFrame:
    """Pairs ``a, b`` (fingerprints) of members of open buckets that may still be links.

    A shingle is rare here when at most ``rare`` of the classes in open buckets
    hold it.  Two classes either share a rare shingle, and then meet in its
    short list; or they share none, and then no more than the smaller number of
    their common shingles, which for most pairs rules a link out by itself.  So
    near copies whose differences are their own do not become pairs.
    """
    nodes = now.select("f1", "rep", "n", "root").distinct()
    posting = sets.join(nodes.select("f1"), "f1", "left_semi").select("f1", F.explode("hashes").alias("h"))
    few = posting.groupBy("h").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") <= rare)
    scarce = stored(posting.join(few, "h").select("f1", "h", "times"), "rare")
    spare = scarce.groupBy("f1").agg(F.count(F.lit(1)).alias("r"))
    known = stored(nodes.join(spare, "f1", "left").select(
        "f1", "root", "n", (F.col("n") - F.coalesce("r", F.lit(0))).alias("common")), "known")

    def side(x: str) -> list:
        return [F.col(c).alias(f"{c}_{x}") for c in ("f1", "root", "n", "common")]

    # Pairs with a rare shingle: lists of `rare` entries at most.
    lists = scarce.filter("times > 1").join(known, "f1").groupBy("h").agg(
        F.array_sort(F.collect_list(F.struct("f1", "root", "n", "common"))).alias("l"))
    met = lists.select(F.explode(F.expr(
        "flatten(transform(l, (x, i) -> transform(slice(l, i + 2, size(l)), y -> struct(x as x, y as y))))")).alias("p")).filter(
        "p.x.root <> p.y.root").select(*[F.col(f"p.{x}.{c}").alias(f"{c}_{x}") for x in ("x", "y") for c in ("f1", "root", "n", "common")])
    sharing = met.groupBy(*met.columns).agg(F.count(F.lit(1)).alias("shared")).filter(
        _may_link("n_x", "n_y", F.col("shared") + F.least("common_x", "common_y"), percent))

    # Pairs without one: only members whose common shingles could be enough, once for the first bucket they share.
    able = now.select("key", "f1").join(known, "f1").filter(F.col("common") * 100 >= F.col("n") * percent).join(
        classes.select("f1", "bands").dropDuplicates(["f1"]), "f1")
    left, right = (able.select("key", *side(x), F.col("bands").alias(f"bands_{x}")) for x in ("x", "y"))
    plain = left.join(right, "key").filter(
        (F.col("f1_x") < F.col("f1_y")) & (F.col("root_x") != F.col("root_y"))
        & _may_link("n_x", "n_y", F.least("common_x", "common_y"), percent)
        & (F.array_min(F.array_intersect("bands_x", "bands_y")) == F.col("key")))
    return stored(sharing.select(F.col("f1_x").alias("a"), F.col("f1_y").alias("b")).union(
        plain.select(F.col("f1_x").alias("a"), F.col("f1_y").alias("b"))).distinct(), "pairs")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS,
                    rare: int = RARE) -> DataFrame:
    """Groups of documents linked by Jaccard similarity of word n-gram sets.

    Takes ``doc_id`` (long) and ``text``; other columns are ignored.  Returns
    one row per input row: ``doc_id, n_shingles, component_id, kept``.  A text
    is a set of word n-grams (lower-cased A-Z, words between white space); two
    documents are linked when the intersection is at least ``percent`` % of
    the union, and ``component_id`` is the smallest id reachable over links.

    * Documents of equal sets form one class, found by aggregation, so a group
      of copies of any size is one row from then on.
    * Classes meet in banded buckets.  A bucket gives star edges only: its
      members against one centre, twice, with other centres the second time
      and without edges inside a component.
    * Buckets that still hold several components go through bounds that are
      exact (``_remaining``): members become a pair only when they share a rare
      shingle or their other shingles could be enough.  So no link between
      members of a bucket is lost, and members that differ by shingles of
      their own are not paired.
    * Edges are confirmed on whole sets, hashed once for the classes that share
      a bucket with another one.

    Null or empty texts (no words) have an empty set, are linked with nothing
    and stay.  Rows of the same id are one node: repeated rows change nothing,
    and different texts under one id are linked through it.  A null id is
    never linked; its component is null and it is kept.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stored(docs.mapInArrow(lambda it: _sign(it, shingle, bands, rows),
                                 "doc_id long, n long, f1 long, f2 long, bands array<long>"), "signatures")
    real = sig.filter("n > 0 and doc_id is not null")
    classes = stored(real.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "bands")).alias("least"))
                     .select("f1", "f2", "n", F.col("least.doc_id").alias("rep"), F.col("least.bands").alias("bands")),
                     "classes")
    member = real.select("doc_id", "n", "f1", "f2").join(classes.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"])
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z")
    same_id = member.join(twice.select("doc_id", "a"), "doc_id").select("a", F.col("rep").alias("b")).filter("a <> b").distinct()

    row = classes.select("rep", "f1", "n", F.explode("bands").alias("key"))
    crowded = row.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    bucket = stored(row.join(crowded, "key").select("key", "rep", "f1", "n"), "buckets")
    crowd = bucket.select("rep", "f1").distinct()
    texts = docs.join(crowd.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = stored(texts.mapInArrow(lambda it: _sets(it, shingle), "rep long, f1 long, hashes array<long>").join(
        crowd, ["rep", "f1"], "left_semi").groupBy("f1").agg(F.first("rep").alias("rep"), F.first("hashes").alias("hashes")), "sets")

    links = stored(same_id, "confirmed")
    label = empty(spark, "node long, root long")
    if not links.isEmpty():
        label = stored(components(links), "labels")

    def confirm(pairs: DataFrame) -> None:
        nonlocal links, label
        full = pairs.join(sets.select(F.col("f1").alias("a"), F.col("hashes").alias("hashes_a"), F.col("rep").alias("rep_a")), "a").join(
            sets.select(F.col("f1").alias("b"), F.col("hashes").alias("hashes_b"), F.col("rep").alias("rep_b")), "b")
        found = full.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "hashes_a", "hashes_b").mapInArrow(
            lambda it: _confirm(it, percent), "a long, b long")
        more = stored(links.union(found.distinct()), "confirmed")
        discard(pairs, links, *([label] if label.inputFiles() else []))
        links = more
        label = empty(spark, "node long, root long") if links.isEmpty() else stored(components(links), "labels")

    for turn in (F.xxhash64("rep"), F.xxhash64("rep", "key")):
        now = _open(bucket, label)
        centre = now.withColumn("turn", turn).groupBy("key").agg(F.min(F.struct("turn", "f1", "n", "root")).alias("c")).select(
            "key", F.col("c.f1").alias("centre"), F.col("c.n").alias("m"), F.col("c.root").alias("other"))
        pairs = stored(now.join(centre, "key").filter(F.col("root") != F.col("other")).filter(
            F.least("n", "m") * 100 >= F.greatest("n", "m") * percent).select(
            F.least("f1", "centre").alias("a"), F.greatest("f1", "centre").alias("b")).distinct(), "pairs")
        confirm(pairs)
        discard(now)
    now = _open(bucket, label)
    if not now.isEmpty():
        confirm(_remaining(now, classes, sets, percent, rare))
    discard(now, bucket, sets)
    named = classes.select("f1", "f2", "n", "rep").join(
        label.withColumnRenamed("node", "rep"), "rep", "left").select(
        "f1", "f2", "n", F.coalesce("root", "rep").alias("component_id"))
    return sig.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
