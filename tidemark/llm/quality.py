"""Quality scores of documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import linear
from tidemark.llm.words import slices

THRESHOLD = 0.3


def with_score(docs: DataFrame, labels: DataFrame, sample_rows: int = linear.SAMPLE_ROWS, name: str = "score") -> DataFrame:
    """The documents with one more column, the probability that a text would be marked ``quality = 1``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & ~linear.held_out())
    weights = docs.sparkSession.sparkContext.broadcast(linear.fit(rows, 1, sample_rows, marks=marked))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = linear.sigmoid(linear.margins(part.column("text"), weights.value)[0])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = linear.SAMPLE_ROWS,
                  threshold: float = THRESHOLD) -> DataFrame:
    """Quality of every text: ``doc_id, held_out, score, predicted``, one row per input row.

    Takes ``doc_id, text`` and ``doc_id, quality``; other columns are ignored.
    The model learns from labelled rows that are not held out
    (``crc32(doc_id) mod 5 <> 0``), at most ``sample_rows`` of them, and sees
    nothing but texts.

    A null or empty text has no features and scores the model's constant.
    Rows with a null id are scored, never learned from.  Repeated labels count
    as often as they occur; labels other than 0 and 1 are ignored.  Without any
    label every score is 0.5.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(docs, labels, sample_rows).select(
        "doc_id", linear.held_out().alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
