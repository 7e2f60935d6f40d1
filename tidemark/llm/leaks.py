"""Benchmark passages in documents, found through a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.store import stored
from tidemark.llm.words import ALNUM, slices, words_of

#: Words of a phrase window, index terms looked up per window, and terms that one scan sends to its tasks (8 bytes each).
WINDOW, ANCHORS, SCAN_TERMS = 10, 2, 1_000_000


def _longs(per_row: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(per_row)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            w = words_of(part.column("text"), ALNUM)
            yield pa.RecordBatch.from_arrays([part.column("item"), _longs(np.diff(w.first), w.hash)], ["item", "words"])


def _term_scans(terms: DataFrame, scan_terms: int) -> Iterator[object]:
    """The sorted terms as broadcasts of at most ``scan_terms`` each; one in all but extreme cases."""
    blocks = max(1, -(-terms.count() // scan_terms))
    for block in range(blocks):
        mine = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block)
        found = mine.toPandas()["term"].to_numpy(np.int64)
        yield terms.sparkSession.sparkContext.broadcast(np.sort(found.view(np.uint64)))


def _find(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words that are terms, and which."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = np.flatnonzero(terms[at] == hashes)
    return hit, at[hit]


def term_counts(docs: DataFrame, terms: DataFrame, scan_terms: int = SCAN_TERMS) -> DataFrame:
    """Occurrences over all documents of each ``term``; a term that never occurs has no row."""
    out = None
    for sent in _term_scans(terms, scan_terms):
        def count(batches, sent=sent):
            total = np.zeros(len(sent.value), np.int64)
            for batch in batches:
                for part in slices(batch):
                    total += np.bincount(_find(words_of(part.column("text"), ALNUM).hash, sent.value)[1], minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(sent.value[seen].view(np.int64)), pa.array(total[seen])], ["term", "n"])

        part = docs.select("text").mapInArrow(count, "term long, n long")
        out = part if out is None else out.union(part)
    return out.groupBy("term").agg(F.sum("n").alias("n"))


def postings(docs: DataFrame, terms: DataFrame, scan_terms: int = SCAN_TERMS) -> DataFrame:
    """Positions of ``terms`` by document: ``doc_id, text_hash, n_words, terms, places``.

    One row per document and scan; ``n_words`` is null in all scans but the
    first.  ``docs`` carries ``text_hash`` beside ``doc_id, text``.
    """
    out = None
    for block, sent in enumerate(_term_scans(terms, scan_terms)):
        def scan(batches, sent=sent, first=block == 0):
            for batch in batches:
                for part in slices(batch):
                    w = words_of(part.column("text"), ALNUM)
                    hit, term = _find(w.hash, sent.value)
                    doc = np.searchsorted(w.first, hit, side="right") - 1
                    per = np.bincount(doc, minlength=part.num_rows)
                    place = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()),
                                                     pa.array((hit - w.first[doc]).astype(np.int32)))
                    n = pa.array(np.diff(w.first)) if first else pa.nulls(part.num_rows, pa.int64())
                    values = sent.value[term] if len(sent.value) else np.zeros(0, np.uint64)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), n, _longs(per, values), place],
                                                     ["doc_id", "text_hash", "n_words", "terms", "places"])

        part = docs.select("doc_id", "text_hash", "text").mapInArrow(
            scan, "doc_id long, text_hash long, n_words long, terms array<long>, places array<int>")
        out = part if out is None else out.union(part)
    return out


def rarest_terms(items: DataFrame, counts: DataFrame, window: int, anchors: int, whole_phrase: bool = True) -> DataFrame:
    """The rarest terms of each phrase window: ``item, pair, slot, need, term, offset``.

    ``items`` has ``item, words``.  Windows in which a term never occurs in the
    corpus have no match as a ``whole_phrase`` and are left out; else the
    rarest of the terms that do occur are taken.  Windows of the same item with
    the same rarest terms share a ``pair``.
    """
    word = items.select("item", F.size("words").alias("n"), F.posexplode("words").alias("offset", "term"))
    frame = Window.partitionBy("item").orderBy("offset").rowsBetween(0, window - 1)
    ranked = word.join(counts.withColumnRenamed("n", "times"), "term", "left").select(
        "item", "n", "offset", F.array_sort(F.collect_list(F.struct(
            F.coalesce("times", F.lit(0)).alias("times"), "term", "offset")).over(frame)).alias("best"))
    whole = ranked.filter(f"offset <= n - {window} or (n < {window} and offset = 0)")
    if not whole_phrase:
        whole = whole.withColumn("best", F.filter("best", lambda t: t["times"] > 0))
    chosen = whole.filter("get(best, 0).times > 0").select("item", F.slice("best", 1, anchors).alias("best")).distinct()
    return chosen.select("item", F.xxhash64("best").alias("pair"), F.size("best").alias("need"),
                         F.posexplode("best").alias("slot", "a")).select(
        "item", "pair", "slot", "need", F.col("a.term").alias("term"), F.col("a.offset").alias("offset"))


def _intersect(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Alignments ``doc_id, text_hash, item, shift`` at which all rarest terms of some window stand."""
    lists = index.select("doc_id", "text_hash", F.explode(F.arrays_zip("terms", "places")).alias("p")).select(
        "doc_id", "text_hash", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))
    met = lists.join(anchors, "term").groupBy(
        "doc_id", "text_hash", "item", "pair", "need", (F.col("place") - F.col("offset")).alias("shift")).agg(
        F.expr("bit_or(shiftleft(1, slot)) as slots"))
    return met.filter(F.bit_count("slots") == F.col("need")).select("doc_id", "text_hash", "item", "shift").distinct()


def _confirm(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Words under phrase windows, and the items of them, of each document with alignments."""
    for batch in batches:
        for part in slices(batch):
            w = words_of(part.column("text"), ALNUM)
            found = part.column("found").to_pylist()
            n_hit, items = [], []
            for d in range(part.num_rows):
                mine = w.hash[w.first[d]:w.first[d + 1]]
                hit, seen = np.zeros(len(mine), bool), set()
                for one in found[d]:
                    item = np.array(one["words"], np.int64).view(np.uint64)
                    size = min(window, len(item))
                    for shift in one["shifts"]:
                        lo, hi = max(0, -shift), min(len(item), len(mine) - shift)
                        if hi - lo < size:
                            continue
                        same = mine[lo + shift:hi + shift] == item[lo:hi]
                        sums = np.concatenate([[0], np.cumsum(same)])
                        at = np.flatnonzero(sums[size:] - sums[:-size] == size)
                        for begin in at:
                            hit[lo + shift + begin:lo + shift + begin + size] = True
                        if len(at):
                            seen.add(one["item"])
                n_hit.append(int(hit.sum()))
                items.append(sorted(seen))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("text_hash"), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_hit", "items"])


def _prepare(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with a text hash, distinct benchmark word lists, and the ids of each list."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
    spelled = rows.mapInArrow(_spell, "item string, words array<long>").filter(F.size("words") > 0)
    spelled = stored(spelled.select("words", F.xxhash64("words").alias("key"), F.col("item").alias("item_id")), "items")
    named = spelled.filter("item_id is not null")
    return docs, spelled.select(F.col("key").alias("item"), "words").distinct(), named.select(
        F.col("key").alias("item"), "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchors: int = ANCHORS,
                  scan_terms: int = SCAN_TERMS) -> DataFrame:
    """Exact phrase matches of benchmark items in documents.

    Takes ``doc_id, text`` and ``item_id, text``; other columns are ignored.
    Returns one row per input row: ``doc_id, text_hash, n_words, n_hit,
    n_items, item_ids, contaminated``.  Every run of ``window`` item words (all words of
    a shorter item) is a phrase; ``n_hit`` counts the document words inside any
    occurrence of a phrase, ``item_ids`` (strings, sorted) are the items that
    have one.

    A first scan counts the benchmark's terms over the corpus, a second one
    stores the positions of the rarest ``anchors`` terms of each phrase.  The
    position lists are intersected after subtracting the terms' offsets, and
    the alignments that remain are read off the texts word by word.  Postings
    meet their terms in a join whose large side can be split; equal windows
    and equal items are looked up once.

    Null or empty texts have no words and no matches.  Rows of equal id and
    text give equal rows; a null id is a document of its own.  Items without
    words match nothing; those without id hit words and contaminate, but are
    in neither ``item_ids`` nor ``n_items``; repeated items count once by id.
    """
    docs, items, ids = _prepare(docs, benchmark)
    terms = items.select(F.explode("words").alias("term")).distinct()
    chosen = stored(rarest_terms(items, term_counts(docs, terms, scan_terms), window, anchors), "anchors")
    index = stored(postings(docs, chosen.select("term").distinct(), scan_terms), "postings")
    shifts = _intersect(index, chosen).groupBy("doc_id", "text_hash", "item").agg(F.collect_list("shift").alias("shifts"))
    found = shifts.join(items, "item").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("item", "shifts", "words")).alias("found"))
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.text_hash") == F.col("f.text_hash"))
    read = docs.alias("d").join(found.alias("f"), same).select("d.doc_id", "d.text_hash", "d.text", "f.found")
    hits = stored(read.mapInArrow(lambda it: _confirm(it, window), "doc_id long, text_hash long, n_hit long, items array<long>")
                  .filter("n_hit > 0").distinct(), "hits")
    named = hits.select("doc_id", "text_hash", "n_hit", F.explode("items").alias("item")).join(ids, "item", "left").groupBy(
        "doc_id", "text_hash", "n_hit").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    same = F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.text_hash") == F.col("h.text_hash"))
    return index.filter("n_words is not null").alias("d").join(named.alias("h"), same, "left").select(
        "d.doc_id", "d.text_hash", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity_matches(docs: DataFrame, benchmark: DataFrame, slop: int = 5, window: int = WINDOW,
                      scan_terms: int = SCAN_TERMS) -> DataFrame:
    """Documents in which the two rarest terms of a phrase stand about as far apart as in the item.

    Returns distinct ``doc_id, item_id``: the distance may differ by up to
    ``slop`` words.  Terms that no document has are passed over; where one
    term of a phrase is left, it matches where it occurs.  Items without id are
    left out; null and empty inputs behave as in ``decontaminate``.
    """
    docs, items, ids = _prepare(docs, benchmark)
    terms = items.select(F.explode("words").alias("term")).distinct()
    chosen = stored(rarest_terms(items, term_counts(docs, terms, scan_terms), window, 2, whole_phrase=False), "anchors")
    index = postings(docs, chosen.select("term").distinct(), scan_terms)
    lists = index.select("doc_id", "text_hash", F.explode(F.arrays_zip("terms", "places")).alias("p")).select(
        "doc_id", "text_hash", F.col("p.terms").alias("term"), F.col("p.places").alias("place"))
    met = lists.join(chosen, "term").withColumn("shift", F.col("place") - F.col("offset"))
    by = Window.partitionBy("doc_id", "text_hash", "item", "pair").orderBy("shift", "slot")
    last = F.last(F.when(F.col("slot") == 0, F.col("shift")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    other = F.last(F.when(F.col("slot") == 1, F.col("shift")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    near = met.withColumn("before", F.when(F.col("slot") == 0, other).otherwise(last)).filter(
        (F.col("need") == 1) | (F.col("shift") - F.col("before") <= slop))
    return near.select("doc_id", "item").distinct().join(ids, "item").select("doc_id", "item_id").distinct()
