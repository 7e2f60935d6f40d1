"""Figures out of text columns (S13, S14); whole texts, JVM regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import col

AMOUNT = r"[\d,.]+"


def java_quote(text: str) -> str:
    """A label as a literal inside a Java regular expression."""
    return re.sub(r"([\\.^$|?*+(){}\[\]])", r"\\\1", text)


def label_pattern(label: str, n: int) -> str:
    """Label, an optional footnote mark, then one group of n amounts."""
    amounts = r"\s+".join([AMOUNT] * n)
    return rf"(?i){java_quote(label)}(?:\d+|\*+)?\s+({amounts})"


def amount(text: Column) -> Column:
    cleaned = F.replace(text, F.lit(","), F.lit(""))
    return F.when(cleaned != "", cleaned).try_cast("double")


def extract_labelled_amounts(docs: DataFrame, text: str, labels, n: int, out: str = "amounts") -> DataFrame:
    """Array of the n amounts behind the first label that matches, else null.

    Each label is searched once: the amounts come out as one block and are
    split afterwards.
    """
    squeezed = F.regexp_replace(col(text), r"[ \t]+", " ")
    blocks = [
        F.get(F.regexp_extract_all(squeezed, F.lit(label_pattern(label, n)), F.lit(1)), F.lit(0))
        for label in labels
    ]
    return docs.withColumn(out, F.transform(F.split(F.coalesce(*blocks), r"\s+"), amount))


def section(text, start: str, end: str) -> Column:
    """Text between the first start marker and the next end marker, else null."""
    t = col(text)
    first = F.instr(t, start)
    after = F.substring(t, first + len(start), F.length(t))
    stop = F.instr(after, end)
    return F.when((first > 0) & (stop > 0), F.substring(after, F.lit(1), stop - 1))


def extract_sections(docs: DataFrame, text: str, start: str, end: str, block: str, row: str,
                     keys=("doc_id",)) -> DataFrame:
    """Blocks of a bounded section and the row pattern's figures in each.

    ``block`` is the regular expression of a block head with one group (its
    label); a block runs to the next head.  ``row`` has one group, the figure.
    """
    body = docs.withColumn("_section", section(text, start, end)).where("_section is not null")
    # (?s) spans lines; the tail of a block stops before the next head.
    head = re.sub(r"\((?!\?)", "(?:", block)
    pieces = F.regexp_extract_all("_section", F.lit(rf"(?s)({head}.*?)(?={head}|\z)"), F.lit(1))
    blocks = body.select(*keys, F.posexplode(pieces).alias("pos", "piece"))
    return blocks.select(
        *keys, "pos",
        F.regexp_extract("piece", block, 1).alias("block"),
        amount(F.regexp_extract("piece", row, 1)).alias("value"),
    )
