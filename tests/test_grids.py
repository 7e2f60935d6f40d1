"""Published sheets as grids."""

from tidemark.sources import grids as gd


def test_titled_sheets_in_one_pass(spark, tmp_path):
    """Only the first rows make a title, sheets without a name have none, and the grid is read once."""
    rows = [("a", 1, ["Year", "Gross Deficit"]), ("a", 2, ["2001-02", "7"]), ("a", 3, ["2001-02", "8"]), ("b", 1, ["Year", "Receipts"]),
            ("b", 2, ["2001-02", "9"]), ("c", 1, ["x"]), ("c", 2, None), ("c", 3, ["2002-03", None]), ("c", 9, ["Gross Deficit"]),
            (None, 1, ["Gross Deficit"]), (None, 2, ["2001-02", "5"]), ("d", 5, ["Gross Deficit"]), ("d", 6, ["2003-04", "1.5"]), ("d", 6, ["2003-04", "x"])]
    spark.createDataFrame(rows, "sheet_id string, row_no int, cells array<string>").write.parquet(f"{tmp_path}/grid")
    out = gd.grid_columns(spark.read.parquet(f"{tmp_path}/grid"), r"^\d{4}-\d{2}$", {"v": 1}, "Gross Deficit", header_rows=2)
    got = sorted(((r.sheet_id, r.key, r.v) for r in out.collect()), key=str)
    assert got == [("a", "2001-02", 7.0), ("a", "2001-02", 8.0), ("d", "2003-04", 1.5), ("d", "2003-04", None)]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1


def test_panel_is_read_once(spark):
    from checks import q_sources  # noqa: F401
    from checks.registry import QUERIES

    for name in ("s15_unpivot_grid", "s16_grid_columns"):
        assert not any("lineitem" in file for file in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles()), name
