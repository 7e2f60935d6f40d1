"""Files written from the tables and scanned back, grids, streams."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.functions.calendar import parse_quarter_label
from tidemark.schema import FLOWS
from tidemark.session import scratch_path, settle
from tidemark.sources import grids as gd
from tidemark.sources import json_sources as js
from tidemark.operators import quality as ql
from tidemark.sources import landing as ld
from tidemark.sources import manifest as mf
from tidemark.sources import publish as pb
from tidemark.sources import sinks as sk
from tidemark.streaming import flows as st


@query("s1_read_price_matrix", "prices_w", "select date, market, price from prices_w")
def _(spark, d):
    p = fx.prices_w(spark, d).withColumn("year", F.year("date"))
    dates = p.groupBy("year").agg(F.sort_array(F.collect_set("date")).alias("days"))
    cells = p.groupBy("year", "market").agg(F.map_from_entries(F.collect_list(F.struct("date", "price"))).alias("m"))
    columns = cells.join(dates, "year").select("year", "days", "market", F.transform("days", lambda x: F.try_element_at("m", x)).alias("column"))
    files = columns.groupBy("year").agg(
        F.transform(F.first("days"), lambda x: x.cast("string")).alias("dates"),
        F.map_from_entries(F.collect_list(F.struct("market", "column"))).alias("values"))
    path = scratch_path(spark, "matrix")
    files.select("year", F.to_json(F.struct("dates", "values"), {"ignoreNullFields": "false"}).alias("value")).write.partitionBy("year").text(path)
    return js.read_price_matrix(spark, f"{path}/*/").select("date", "market", "price")


OBS = T.StructType([T.StructField("date", T.DateType()), T.StructField("tri", T.DoubleType())])


def land(df, path, day):
    """One envelope per market and landing day."""
    env = df.groupBy(F.col("market").alias("key"), F.year("date").alias("y")).agg(
        F.sort_array(F.collect_list(F.struct("date", F.col("price").alias("tri")))).alias("observations"))
    env.select("key", F.lit(day).alias("retrieved_at"), "observations").write.json(f"{path}/{day}")


@query("s2_read_landed", "prices_w", "select market as key, date, price as tri, true as has_path from prices_w")
def _(spark, d):
    path = scratch_path(spark, "landed")
    land(fx.prices_w(spark, d), path, "2024-01-01")
    rows = js.read_landed(spark, f"{path}/*/", OBS)
    return rows.select("key", "date", "tri", F.col("file_path").contains("2024-01-01").alias("has_path"))


@query("s3_latest_landing", "prices_w", "select market as key, date, CASE WHEN market in ('ASIA','EUROPE') THEN price * 2 ELSE price END as tri from prices_w")
def _(spark, d):
    path, p = scratch_path(spark, "landed"), fx.prices_w(spark, d)
    land(p, path, "2024-01-01")
    land(p.where("market in ('ASIA','EUROPE')").withColumn("price", F.col("price") * 2), path, "2024-02-01")
    rows = js.read_landed(spark, f"{path}/*/", OBS)
    rows = rows.withColumn("date_dir", F.col("retrieved_at"))
    newest = ld.latest_landing(rows, ["key"])
    return newest.select("key", "date", "tri")


def reference_doc(spark, d):
    annual = fx.country_year(spark, d).select(F.col("entity").alias("series"), F.concat((F.col("year") - 1).cast("string"), F.lit("-"), F.substring(F.col("year").cast("string"), 3, 2)).alias("period"), "value")
    series = annual.groupBy("series").agg(F.struct(
        F.lit("actual").alias("status"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("period", F.col("value").cast("string"))))).alias("observations")).alias("s"))
    doc = series.groupBy(F.lit("allocation").alias("dataset")).agg(F.struct(F.map_from_entries(F.collect_list(F.struct("series", "s"))).alias("series")).alias("body"))
    path = scratch_path(spark, "reference")
    doc.select(F.to_json(F.create_map("dataset", "body")).alias("value")).write.text(path)
    return js.read_annual_reference(spark, path)


@query("s4_read_annual_reference", "country_year", "select 'allocation' as dataset, entity as series, year as fy, value, 'actual' as status from country_year")
def _(spark, d):
    return reference_doc(spark, d).select("dataset", "series", "fy", "value", "status")


@query("s4_reference_violations", "country_year", "select entity as series, year as fy, CASE WHEN year = 1997 THEN 'value' ELSE 'status' END as problem from country_year where year in (1997, 1999)")
def _(spark, d):
    rows = reference_doc(spark, d)
    broken = rows.withColumns({"value": F.when(F.col("fy") != 1997, F.col("value")), "status": F.when(F.col("fy") == 1999, "guess").otherwise(F.col("status"))})
    return js.annual_reference_violations(broken).select("series", "fy", "problem")


def payloads(spark, d):
    item = F.struct(F.col("entity").alias("country"), F.lit("NY.X").alias("indicator"), F.col("year").cast("string").alias("date"), F.when(F.col("year") != 1998, F.col("value")).alias("value"))
    rows = fx.country_year(spark, d).groupBy("entity").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    return js.parse_payload(rows.select(F.concat(F.lit('[{"page":1},'), F.to_json("rows"), F.lit("]")).alias("payload")))


@query("s5_normalize_country_payload", "country_year", "select make_date(year, 12, 31) as date, entity, 'NY.X' as indicator, year, value from country_year where year <> 1998")
def _(spark, d):
    return js.normalize_country_payload(payloads(spark, d))


@query("s6_year_values", "country_year", "select entity, year, value from country_year where year <> 1998")
def _(spark, d):
    return js.year_values(js.normalize_country_payload(payloads(spark, d)))


@query("s8_land_new", sql="select o_orderkey, o_custkey, o_totalprice, DATE '2024-01-01' + CASE WHEN o_orderstatus='F' THEN 0 ELSE 1 END as retrieved_date from orders")
def _(spark, d):
    path, hashes = scratch_path(spark, "landing"), scratch_path(spark, "hashes")
    o = fx.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    # The second delivery repeats the first and repeats itself.
    for batch, (rows, at) in enumerate(((o.where("o_orderstatus = 'F'"), "2024-01-01"), (o.unionByName(o), "2024-01-02"))):
        new = settle(mf.unseen(rows, hashes, "orders", str(batch), "o_orderdate"))
        mf.record(new, hashes, "orders", str(batch))
        ld.append_landing(new.drop("shard").withColumn("retrieved_at", F.lit(at).cast("timestamp")), path)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_totalprice", "retrieved_date")


@query("s9_with_snapshot_fallback", "country_year", "select entity, year, CASE WHEN entity < 'NATION_2' THEN value ELSE value * 3 END as value, entity >= 'NATION_2' as fallback from country_year")
def _(spark, d):
    cy = settle(fx.country_year(spark, d))
    fresh = cy.where("entity < 'NATION_2'").withColumn("retrieved_at", F.lit("2024-03-01"))
    landed = cy.withColumns({"value": F.col("value") * 2, "retrieved_at": F.lit("2024-01-01")}).unionByName(
        cy.withColumns({"value": F.col("value") * 3, "retrieved_at": F.lit("2024-02-01")}))
    return ld.with_snapshot_fallback(fresh, landed, ["entity"]).select("entity", "year", "value", "fallback")


def written(spark, d):
    root = scratch_path(spark, "outputs")
    outputs = {"records": fx.records(spark, d), "volume": fx.monthly_volume(spark, d)}
    names = sk.write_outputs(outputs, [f"{root}/a", f"{root}/b"], target="records")
    return root, names


@query("s10_write_outputs", "records", "select date, entity, indicator, value, status from records")
def _(spark, d):
    root, _names = written(spark, d)
    return spark.read.parquet(f"{root}/b/records")


@query("s10_gated_publication", "records monthly_volume", "select 'records' as name, 0::BIGINT as version, count(*) as rows, true as same from records union all select 'volume', 0, count(*), true from monthly_volume")
def _(spark, d):
    root = scratch_path(spark, "published")
    records, volume = fx.records(spark, d), fx.monthly_volume(spark, d)
    checks = {"repeated keys": lambda s: ql.check_unique(s["records"], ["date", "entity", "indicator"]),
              "not finite": lambda s: ql.check_finite(s["records"]), "too few rows": lambda s: ql.check_min_rows(s["volume"], 2)}
    pb.publish({"records": records, "volume": volume}, checks, root)
    try:  # repeats every key, with other values
        pb.publish({"records": records.unionByName(records.withColumn("value", F.col("value") + 1)), "volume": volume.limit(0)}, checks, root)
    except ql.DataQualityError:
        pass
    return pb.published_set(spark, root).select("name", "version").join(pb.verify_published(spark, root), "name")


@query("s11_verify_copies", "records", "select count(*) as rows, true as same from records")
def _(spark, d):
    root, _names = written(spark, d)
    return sk.verify_copies(spark, f"{root}/a/records", f"{root}/b/records")


FIVE = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("s12_write_csv", "prices_m", "select date, " + ", ".join(f"max(price) filter (where market='{m}') as \"{m}\"" for m in FIVE) + " from prices_m group by 1")
def _(spark, d):
    wide = fx.prices_m(spark, d).groupBy("date").pivot("market", list(FIVE)).agg(F.first("price"))
    path = scratch_path(spark, "csv")
    sk.write_csv(wide, path)
    return spark.read.schema(wide.schema).option("header", True).csv(path)


@query("s20_dedupe_consistent", "flows", "select date, category, buy, sell, net from flows")
def _(spark, d):
    f = fx.flows(spark, d)
    return ld.dedupe_consistent(f.unionByName(f), ["date", "category"])


@query("s20_conflicting_duplicates", "flows", "select date, category, CAST(2 AS BIGINT) as versions from flows where category='DII'")
def _(spark, d):
    f = fx.flows(spark, d)
    other = f.withColumn("net", F.when(F.col("category") == "DII", F.col("net") + 1).otherwise(F.col("net")))
    return ld.conflicting_duplicates(f.unionByName(other), ["date", "category"])


# --- grids ---------------------------------------------------------------------

FYS = list(range(1995, 2003))


def text(c):
    return F.col(c).cast("string")


def gsdp_grid(spark, d):
    """Two sheets of states by fiscal year, with notes and an aggregate row."""
    p = settle(fx.panel(spark, d)).withColumn("sheet_id", F.concat(F.lit("t"), F.pmod(F.crc32("state"), F.lit(2)).cast("string")))
    wide = p.groupBy("sheet_id", "state").pivot("fy", FYS).agg(F.first("current_value"))
    values = [F.col(f"`{y}`").cast("string") for y in FYS]
    rows = wide.select("sheet_id", (F.row_number().over(_w("sheet_id", "state")) + 1).alias("row_no"), F.array("state", *values).alias("cells"))
    sheets = wide.select("sheet_id").distinct()
    labels = [F.lit(f"{y}-{(y + 1) % 100:02d}") for y in FYS]
    heads = sheets.select("sheet_id", F.lit(1).alias("row_no"), F.array(F.lit("State"), *labels).alias("cells"))
    notes = sheets.select("sheet_id", F.explode(F.array(
        F.struct(F.lit(900).alias("row_no"), F.array(F.lit("All India"), F.lit("1.0")).alias("cells")),
        F.struct(F.lit(901).alias("row_no"), F.array(F.lit("Note: provisional"), F.lit("2.0")).alias("cells")))).alias("e")).select("sheet_id", "e.*")
    return heads.unionByName(rows).unionByName(notes)


def _w(part, order):
    from pyspark.sql import Window as W
    return W.partitionBy(part).orderBy(order)


@query("s15_unpivot_grid", "panel", "select state as label, CAST(fy AS VARCHAR) || '-' || right(CAST(fy + 1 AS VARCHAR), 2) as period, current_value as value from panel where fy between 1995 and 2002")
def _(spark, d):
    out = gd.unpivot_grid(gsdp_grid(spark, d), F.col("cells")[0] == "State", skip_lower="^(all india|states|union territories)")
    return out.select("label", "period", "value")


@query("s16_grid_columns", "panel", "select CAST(fy AS VARCHAR) || '-' || right(CAST(fy + 1 AS VARCHAR), 2) as key, state as sheet_id, constant_value as constant, outlay from panel where right(state, 1) in ('1','3')")
def _(spark, d):
    p = settle(fx.panel(spark, d))  # heads and body, each read by every pass over the grid
    key = F.concat(text("fy"), F.lit("-"), F.substring((F.col("fy") + 1).cast("string"), 3, 2))
    body = p.select(F.col("state").alias("sheet_id"), (F.col("fy") - 1900).alias("row_no"), F.array(key, text("current_value"), F.lit("-"), text("constant_value"), F.lit(None).cast("string"), text("outlay")).alias("cells"))
    title = F.when(F.substring("state", -1, 1).isin("1", "3"), "Gross Primary Deficit").otherwise("Revenue Receipts")
    heads = p.select("state", title.alias("t")).distinct().select(F.col("state").alias("sheet_id"), F.lit(1).alias("row_no"), F.array(F.lit("Year"), F.col("t")).alias("cells"))
    return gd.grid_columns(heads.unionByName(body), r"^\d{4}-\d{2}$", {"constant": 3, "outlay": 5}, "Gross Primary Deficit").select("sheet_id", "key", "constant", "outlay")


@query("s17_grid_blocks", "monthly_volume", "select CAST(y AS VARCHAR) as head, strftime(make_date(y, m, 1), '%b') as label, CAST(volume AS DOUBLE) as value from monthly_volume")
def _(spark, d):
    v = fx.monthly_volume(spark, d).withColumn("pair", F.floor((F.col("y") - 1995) / 2)).withColumn("odd", F.pmod(F.col("y") - 1995, F.lit(2)))
    months = v.groupBy("pair", "m").pivot("odd", [0, 1]).agg(F.first("volume"))
    name = F.date_format(F.make_date(F.lit(2000), "m", F.lit(1)), "MMM")
    none = F.lit(None).cast("string")
    rows = months.select(F.lit("reer").alias("sheet_id"), (F.col("pair") * 20 + F.col("m") + 1).cast("int").alias("row_no"),
                         F.array(name, none, text("`0`"), none, none, name, none, text("`1`")).alias("cells"))
    heads = months.select("pair").distinct().select(F.lit("reer").alias("sheet_id"), (F.col("pair") * 20).cast("int").alias("row_no"), F.array(
        (F.col("pair") * 2 + 1995).cast("string"), none, none, none, none, (F.col("pair") * 2 + 1996).cast("string")).alias("cells"))
    year = r"^(19|20)\d{2}$"
    header = F.array(*[F.when(gd.cell(i).rlike(year), gd.cell(i)) for i in (0, 5)])
    return gd.grid_blocks(heads.unionByName(rows), header, (0, 5)).select("head", "label", "value")


PROJ = ("on_schedule", "delayed_n", "undated")


@query("s18_grid_label_blocks", "projects", "select sector, year, metric, CAST(value AS DOUBLE) as value from (unpivot (select sector, year, on_schedule, delayed_n, undated from projects) on on_schedule, delayed_n, undated into name metric value value)")
def _(spark, d):
    years = list(range(1995, 2002))
    long = fx.projects(spark, d).unpivot(["sector", "year"], list(PROJ), "metric", "v")
    wide = long.groupBy("sector", "metric").pivot("year", years).agg(F.first("v"))
    base = F.dense_rank().over(_w(F.lit(1), "sector")) * 10
    offset = F.array_position(F.array(*[F.lit(m) for m in PROJ]), F.col("metric")).cast("int")
    rows = wide.select(F.lit("status").alias("sheet_id"), (base + offset).cast("int").alias("row_no"), F.array("metric", *[text(f"`{y}`") for y in years]).alias("cells"))
    labels = fx.projects(spark, d).select("sector").distinct()
    labels = labels.select(F.lit("status").alias("sheet_id"), (F.dense_rank().over(_w(F.lit(1), "sector")) * 10).cast("int").alias("row_no"), F.array(F.concat(F.lit("1. "), "sector")).alias("cells"))
    out = gd.grid_label_blocks(labels.unionByName(rows), gd.cell(0).rlike(r"^\d+\. "), PROJ)
    return out.select(F.substring("label", 4, 100).alias("sector"), (F.col("pos") + 1995).cast("int").alias("year"), "metric", "value")


@query("s19_grid_offsets", "monthly_volume", "select last_day(make_date(y, CAST(ceil(m / 3.0) * 3 AS INT), 1)) as date, CAST(sum(volume) AS DOUBLE) as value from monthly_volume group by 1")
def _(spark, d):
    q = fx.monthly_volume(spark, d).groupBy("y", F.ceil(F.col("m") / 3).cast("int").alias("q")).agg(F.sum("volume").alias("n"))
    wide = q.groupBy("y").pivot("q", [1, 2, 3, 4]).agg(F.first("n"))
    names = ("January-March", "April-June", "July-September", "October-December")
    labels = [F.concat(F.lit(n + " "), text("y")) for n in names]
    # Credit and debit columns stand before each net column.
    triples = [c for k in (1, 2, 3, 4) for c in (F.lit("0"), F.lit("0"), text(f"`{k}`"))]
    sheet = F.concat(F.lit("b"), text("y")).alias("sheet_id")
    heads = wide.select(sheet, F.lit(1).alias("row_no"), F.array(F.lit("Item/Year"), *labels).alias("cells"))
    body = wide.select(sheet, F.lit(5).alias("row_no"), F.array(F.lit("1. Merchandise"), *triples).alias("cells"))
    out = gd.grid_offsets(heads.unionByName(body), gd.cell(0) == "Item/Year", gd.cell(0) == "1. Merchandise", 3, 3)
    return out.select(parse_quarter_label("label").alias("date"), "value")


@query("s19_grid_offsets_quarters", "monthly_volume", "select y, CAST(ceil(m / 3.0) AS INT) as q, CAST(sum(volume) AS DOUBLE) as value from monthly_volume group by 1,2")
def _(spark, d):
    q = fx.monthly_volume(spark, d).groupBy("y", F.ceil(F.col("m") / 3).cast("int").alias("q")).agg(F.sum("volume").alias("n"))
    years = list(range(1995, 2002))
    wide = q.withColumn("k", F.concat_ws("_", "y", "q")).groupBy(F.lit("gdp").alias("sheet_id")).pivot("k", [f"{y}_{k}" for y in years for k in (1, 2, 3, 4)]).agg(F.first("n"))
    heads = wide.select("sheet_id", F.lit(1).alias("row_no"), F.array(F.lit("Item / Year"), *[F.lit(str(y)) for y in years]).alias("cells"))
    body = wide.select("sheet_id", F.lit(2).alias("row_no"), F.array(F.lit("9. Gross Domestic Product"), *[text(f"`{y}_{k}`") for y in years for k in (1, 2, 3, 4)]).alias("cells"))
    out = gd.grid_offsets(heads.unionByName(body), gd.cell(0).startswith("Item"), gd.cell(0).startswith("9."), 1, 4, 4)
    return out.select(F.col("label").cast("int").alias("y"), (F.col("sub") + 1).cast("int").alias("q"), "value")


# --- streams --------------------------------------------------------------------

def landed_flows(spark, d, revise: bool):
    """Daily flow files; with revisions, later files replace earlier figures."""
    path = scratch_path(spark, "flows")
    f = fx.flows(spark, d).select(*FLOWS.names)
    # Many files in no order of dates, so that every trigger brings late rows.
    f.withColumn("retrieved_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).repartition(6, F.xxhash64("date")).write.json(f"{path}/a")
    second = f.where("category = 'DII' and date >= date'1998-01-01'") if revise else f
    factor = 2 if revise else 1
    moment = "2024-01-03 00:00:00" if revise else "2024-01-01 00:00:00"
    second.withColumns({"net": F.col("net") * factor, "retrieved_at": F.lit(moment).cast("timestamp")}).repartition(3, F.xxhash64("category", "date")).write.json(f"{path}/b")
    return path


@query("x1_stream_landed", "flows", "select date, category, buy, sell, net from flows")
def _(spark, d):
    source = st.read_stream(spark, f"{landed_flows(spark, d, False)}/*", files_per_trigger=4)
    out = scratch_path(spark, "ingested")
    st.stream_landed(source, out, f"{out}-state").awaitTermination()
    return st.landed_rows(spark, out).select(*FLOWS.names)


@query("x2_stream_upsert", "flows", "select date, category, CASE WHEN category='DII' and date >= DATE '1998-01-01' THEN net * 2 ELSE net END as net from flows")
def _(spark, d):
    path, table = landed_flows(spark, d, True), scratch_path(spark, "archive")
    for name in ("a", "b"):  # each part is a stream of its own, with a new checkpoint
        source = st.read_stream(spark, f"{path}/{name}", files_per_trigger=3)
        st.stream_upsert(source, table, ("date", "category"), "retrieved_at", f"{table}-state-{name}").awaitTermination()
    return st.current_rows(spark, table, st.LANDED_FLOWS).select("date", "category", "net")


@query("x3_stream_monthly_flows", "flows", f"select CAST(date_trunc('month', date) AS DATE) as month, category, {rd('sum(net)', 3)} as net, max(date) as date from flows group by 1,2")
def _(spark, d):
    path = scratch_path(spark, "flows")
    fx.flows(spark, d).withColumn("retrieved_at", F.lit("2024-01-01").cast("timestamp")).repartition(6, F.xxhash64("date")).write.json(path)
    table = scratch_path(spark, "monthly")
    st.stream_monthly_flows(st.read_stream(spark, path, files_per_trigger=2), table, f"{table}-state").awaitTermination()
    return st.monthly_flows(spark, table).select("month", "category", r("net", 3), "date")


@query("x3_compacted_flows", "flows", f"select CAST(date_trunc('month', date) AS DATE) as month, category, {rd('sum(net)', 3)} as net, max(date) as date from flows group by 1,2")
def _(spark, d):
    path, table = scratch_path(spark, "flows"), scratch_path(spark, "monthly")
    fx.flows(spark, d).withColumn("retrieved_at", F.lit("2024-01-01").cast("timestamp")).repartition(6, F.xxhash64("date")).write.json(path)
    st.stream_monthly_flows(st.read_stream(spark, path, files_per_trigger=2), table, f"{table}-state").awaitTermination()
    st.compact_monthly_flows(spark, table)
    st.vacuum_monthly_flows(spark, table)
    return st.monthly_flows(spark, table).select("month", "category", r("net", 3), "date")
