"""Published sheets as grids (sheet_id, row_no, cells[]) to long rows.

A sheet is a published table: a few hundred rows.  Grids of many sheets spread
by sheet; every window below is partitioned by sheet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import clean_double

SKIP_LABELS = r"^(Note|Source)"


def cell(index) -> Column:
    """A cell by position, null beyond the row's end."""
    return F.get("cells", F.lit(index) if isinstance(index, int) else index)


def number(value: Column) -> Column:
    """Typed numbers only: a text cell stays null."""
    return clean_double(value, None, text=True)


def first_row(grid: DataFrame, condition: Column, out: str) -> DataFrame:
    """Per sheet, the cells and number of the first row that qualifies."""
    return grid.where(condition).groupBy("sheet_id").agg(
        F.min_by("cells", "row_no").alias(out), F.min("row_no").alias(f"{out}_row")
    )


def unpivot_grid(grid: DataFrame, header: Column, skip: str = SKIP_LABELS,
                 skip_lower: str | None = None, first_column: int = 1) -> DataFrame:
    """(sheet_id, label, period, value) for rows below the header row.

    ``header`` picks the header row; its cells name the periods.  Rows whose
    label matches ``skip`` (or, lower-cased, ``skip_lower``) are left out, as
    are cells that are not numbers.  ``first_column`` is the header position of
    the first period: 0 when the header row has no label cell.
    """
    heads = first_row(grid, header, "header")
    body = grid.join(heads, "sheet_id").where(F.col("row_no") > F.col("header_row"))
    label = F.trim(cell(0))
    keep = cell(0).isNotNull() & ~cell(0).rlike(skip) & number(cell(0)).isNull()
    if skip_lower is not None:
        keep = keep & ~F.lower(label).rlike(skip_lower)
    cells = body.where(keep).select(
        "sheet_id", "row_no", label.alias("label"), "header",
        F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(1)))).alias("pos", "text"),
    )
    return cells.select(
        "sheet_id", "label", F.get("header", F.col("pos") + first_column).alias("period"),
        number(F.col("text")).alias("value"),
    ).where("value is not null and period is not null")


def grid_columns(grid: DataFrame, key: str, columns: dict[str, int], header_contains: str | None = None,
                 header_rows: int = 4) -> DataFrame:
    """Fixed cell positions of the rows whose first cell matches ``key``.

    ``header_contains`` restricts to sheets whose first rows hold the text.
    """
    rows = grid
    if header_contains is not None:
        sheet = W.partitionBy("sheet_id")
        numbered = grid.withColumn("_n", F.row_number().over(sheet.orderBy("row_no")))
        title = (F.col("_n") <= header_rows) & F.array_join("cells", " ").contains(header_contains)
        rows = numbered.withColumn("_titled", F.max(title).over(sheet)).where("_titled and sheet_id is not null")
    return rows.where(cell(0).rlike(key)).select(
        "sheet_id", F.regexp_extract(cell(0), key, 0).alias("key"),
        *[number(cell(i)).alias(name) for name, i in columns.items()],
    )


def grid_blocks(grid: DataFrame, header: Column, offsets, value_at: int = 2) -> DataFrame:
    """Side-by-side blocks with a carried-forward header.

    ``header`` is an array with one header value per block, null on rows that
    are not headers; each block keeps its last header from above.
    """
    w = W.partitionBy("sheet_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    staged = grid.withColumn("_h", header)
    blocks = F.array(*[
        F.struct(
            F.lit(i).alias("block"),
            F.last(F.get("_h", F.lit(i)), ignorenulls=True).over(w).alias("head"),
            cell(o).alias("label"), number(cell(o + value_at)).alias("value"),
        )
        for i, o in enumerate(offsets)
    ])
    is_header = F.exists("_h", lambda v: v.isNotNull())
    rows = staged.select("sheet_id", "row_no", is_header.alias("_is_header"), blocks.alias("_b"))
    return rows.where(~F.coalesce("_is_header", F.lit(False))).select(
        "sheet_id", "row_no", F.inline("_b")
    ).where("head is not null and label is not null and value is not null")


def grid_label_blocks(grid: DataFrame, is_label: Column, metrics) -> DataFrame:
    """A label row followed by one row per metric.

    Gives (sheet_id, label, metric, pos, value); ``pos`` counts the cells after
    the first, so it joins the header's periods.
    """
    w = W.partitionBy("sheet_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    staged = grid.withColumn("_is", F.coalesce(is_label, F.lit(False))).withColumns({
        "_at": F.last(F.when(F.col("_is"), F.col("row_no")), ignorenulls=True).over(w),
        "label": F.last(F.when(F.col("_is"), F.trim(cell(0))), ignorenulls=True).over(w),
    })
    names = F.array(*[F.lit(m) for m in metrics])
    rows = staged.withColumn("_offset", F.col("row_no") - F.col("_at")).where(
        F.col("_offset").between(1, len(metrics))
    )
    return rows.select(
        "sheet_id", "label", F.get(names, F.col("_offset") - 1).alias("metric"),
        F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(1)))).alias("pos", "text"),
    ).select("sheet_id", "label", "metric", "pos", number(F.col("text")).alias("value")).where(
        "value is not null"
    )


def grid_offsets(grid: DataFrame, header: Column, row: Column, first: int, step: int, per_label: int = 1) -> DataFrame:
    """Values of one row addressed by header arithmetic.

    Header label ``i`` owns the cells ``first + step * i + j`` for
    ``j < per_label``: a quarter's net column is (3, 3, 1), four quarters of a
    year are (1, 4, 4).
    """
    heads = first_row(grid, header, "header")
    values = first_row(grid, row, "cells").drop("cells_row")
    labels = heads.join(values, "sheet_id").select(
        "sheet_id", "cells",
        F.posexplode(F.slice("header", 2, F.greatest(F.size("header") - 1, F.lit(1)))).alias("pos", "label"),
    ).where("label is not null")
    inner = labels.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(per_label - 1))))
    return inner.select(
        "sheet_id", "label", "pos", "sub",
        number(F.get("cells", F.lit(first) + F.col("pos") * step + F.col("sub"))).alias("value"),
    ).where("value is not null")
