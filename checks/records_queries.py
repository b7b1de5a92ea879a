"""Record cleaning, grid placement and map algebra."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import functions as F

from aquagrid.constants import GridSpec
from aquagrid.functions import numeric as N, projection as PJ, units as U
from aquagrid.operators import algebra as A, grid as G, records as R
from checks.registry import query, rounded

WELL_GRID = GridSpec(-120.0, 45.0, 1.0, 15, 10)


def well_grid(v):
    """WELL_GRID, lengthened until every well of the registry lies on it."""
    lat, = v.well_registry.agg(F.min("lat")).first()
    rows = WELL_GRID.nrows if lat is None else math.floor(WELL_GRID.ymax - lat) + 1
    return dataclasses.replace(WELL_GRID, nrows=max(WELL_GRID.nrows, rows))


@query("r1_category_filter", """
  select l_orderkey, l_linenumber, well_id, year, af from wells
  where right_type in ('A', 'N') and water_type = 'F'""")
def _(v):
    return R.filter_categories(v.wells, ["A", "N"], "F").select(
        "l_orderkey", "l_linenumber", "well_id", "year", "af")


@query("r2_id_padding", """
  select case when length(well_id) = 5 then '0' || well_id else well_id end as well_id,
    case when length(well_id) < 7 then lpad(well_id, 7, '0') else well_id end as wdid,
    count(*) as n from wells group by 1, 2""")
def _(v):
    both = v.wells.withColumn("wdid", F.col("well_id"))
    padded = R.pad_ids(R.pad_short_ids(both), "wdid", 7)
    return padded.groupBy("well_id", "wdid").agg(F.count("*").alias("n"))


@query("r3_attach_coordinates", """
  with reg as (select well_id, arg_max(lon, load_order) as lon, arg_max(lat, load_order) as lat
    from well_registry group by 1)
  select l_orderkey, l_linenumber, w.well_id, w.year, w.af, round(lon, 6) as lon,
    round(lat, 6) as lat
  from (select * replace (case when length(well_id) = 5 then '0' || well_id else well_id end
    as well_id) from wells) w left join reg using (well_id)""")
def _(v):
    wells = R.pad_short_ids(v.wells)
    out = R.attach_coordinates(wells, v.well_registry.drop("basin_id"))
    return rounded(out.select("l_orderkey", "l_linenumber", "well_id", "year", "af", "lon",
                              "lat"), 6, "lon", "lat")


@query("r4_well_join_cap", """
  with t as (select l_suppkey as k, l_orderkey, l_linenumber, case when l_tax = 0 then null
    else l_extendedprice end as af_pumped from lineitem),
  w as (select s_suppkey as k, s_name from supplier where s_acctbal > 0
    union all select s_suppkey as k, s_name || '#2' from supplier where s_acctbal > 7000)
  select l_orderkey, l_linenumber, k, af_pumped, s_name from t left join w using (k)
  where af_pumped <= 50000""")
def _(v):
    records = v.lineitem.select(
        F.col("l_suppkey").alias("k"), "l_orderkey", "l_linenumber",
        F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("af_pumped"))
    s = v.supplier.select(F.col("s_suppkey").alias("k"), "s_name", "s_acctbal")
    wells = s.filter("s_acctbal > 0").unionByName(s.filter("s_acctbal > 7000").withColumn(
        "s_name", F.concat("s_name", F.lit("#2")))).drop("s_acctbal")
    return R.join_well_table(records, wells, "k", cap=50000.0)


@query("r5_name_mapping", """
  select c_custkey, case c_mktsegment when 'BUILDING' then 'BUILDING AREA'
    when 'MACHINERY' then 'MACHINERY AREA' end as area from customer""")
def _(v):
    names = {"BUILDING": "BUILDING AREA", "MACHINERY": "MACHINERY AREA"}
    return R.map_names(v.customer, "c_mktsegment", names, "area").select("c_custkey", "area")


@query("r6_wide_to_long", """
  select site, y.year as year, case y.year when 1995 then AF_USED_1995
    when 1996 then AF_USED_1996 else AF_USED_1997 end as af,
    case y.year when 1995 then ACRES_1995 when 1997 then ACRES_1997 end as acres
  from wide_use, (values (1995), (1996), (1997)) y(year)""")
def _(v):
    return R.wide_years_to_long(v.wide_use, ["site"], {"af": "AF_USED_", "acres": "ACRES_"})


_SPLIT = """m as (select l_orderkey, l_linenumber, l_partkey, year,
    af / len(string_split(all_app, '_')) as af, unnest(string_split(all_app, '_')) as app
    from members)"""


@query("r7_split_members", f"""
  with {_SPLIT} select l_orderkey, l_linenumber, l_partkey, year, round(af, 6) as af, app
  from m""")
def _(v):
    out = R.split_members(v.members.drop("l_suppkey"), "all_app", "af", "app")
    return rounded(out, 6, "af")


@query("r8_member_locations", f"""
  with {_SPLIT} select l_orderkey, l_linenumber, year, round(af, 6) as af, app, p_size
  from m join part on app = cast(p_partkey as varchar)""")
def _(v):
    members = R.split_members(v.members.drop("l_suppkey", "l_partkey"), "all_app", "af", "app")
    places = v.part.select(F.col("p_partkey").cast("string").alias("app"), "p_size")
    return rounded(R.join_locations(members, places, "app"), 6, "af")


def _series(coefficients, term):
    return " + ".join(f"({c:.17e}) * {term.format(k=2 * (i + 1))}" for i, c in enumerate(coefficients))


@query("r9_utm_to_lonlat", f"""
  with u as (select c_custkey, 300000e0 + c_custkey % 4000 * 100 as utm_x,
    3500000e0 + c_acctbal * 20 as utm_y from customer),
  k as (select *, utm_y / ({PJ._SCALE * PJ._RADIUS:.17e}) as xi,
    (utm_x - 500000e0) / ({PJ._SCALE * PJ._RADIUS:.17e}) as eta from u),
  s as (select *, xi - ({_series(PJ._BETA, 'sin({k} * xi) * (exp({k} * eta) + exp(-{k} * eta)) / 2')}) as a,
    eta - ({_series(PJ._BETA, 'cos({k} * xi) * (exp({k} * eta) - exp(-{k} * eta)) / 2')}) as b from k),
  t as (select *, asin(sin(a) / ((exp(b) + exp(-b)) / 2)) as chi from s)
  select c_custkey, utm_x, utm_y, round(degrees(radians(-111e0) + atan2((exp(b) - exp(-b)) / 2, cos(a))), 7)
    as lon, round(degrees(chi + {_series(PJ._DELTA, 'sin({k} * chi)')}), 7) as lat from t""")
def _(v):
    utm = v.customer.select("c_custkey", (F.lit(300000.0) + F.col("c_custkey") % 4000 * 100)
                            .alias("utm_x"), (F.lit(3500000.0) + F.col("c_acctbal") * 20)
                            .alias("utm_y"))
    return rounded(R.with_lonlat(utm), 7, "lon", "lat")


@query("r10_available_years", """
  select right_type, year, count(*) as n from wells where year between 1996 and 2000
    and not (right_type = 'A' and year = 1997) and not (right_type = 'R' and year = 1999)
  group by 1, 2""")
def _(v):
    gaps = v.spark.createDataFrame([("A", 1997), ("R", 1999)], "right_type string, year int")
    kept = R.drop_unavailable(R.within_years(v.wells, 1996, 2000), gaps, ["right_type", "year"])
    return kept.groupBy("right_type", "year").agg(F.count("*").alias("n"))


@query("r11_state_fold", """
  select p_partkey, case when p_size in (3, 1) then 12 else p_size end as p_size from part""")
def _(v):
    return R.fold_states(v.part, "p_size").select("p_partkey", "p_size")


@query("r12_missing_rows", """
  select 'complete' as kind, count(*) as n, round(sum(value), 2) as total from cell
    where value is not null
  union all select 'filled', count(*), round(sum(coalesce(value, 0)), 2) from cell""")
def _(v):
    def summary(kind, df):
        return df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"),
                      F.round(F.sum("value"), 2).alias("total"))
    return summary("complete", R.complete_rows(v.cell, ["value"])).unionByName(
        summary("filled", R.fill_missing(v.cell, ["value"])))


@query("r13_zeros_to_missing", """
  select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount,
    nullif(l_tax, 0) as l_tax from lineitem""")
def _(v):
    return R.zeros_to_missing(v.lineitem, ["l_discount", "l_tax"]).select(
        "l_orderkey", "l_linenumber", "l_discount", "l_tax")


@query("r14_unit_mean_fill", """
  with s as (select cell_id, year, case when year % 3 = 0 then 0 else value2 end as value
    from cell_year where year <= 2000),
  f as (select cell_id, year, coalesce(nullif(value, 0),
    avg(nullif(value, 0)) over (partition by cell_id)) as value from s)
  select cell_id, year, round(value, 6) as value from f
  union all select cell_id, year + k, round(value, 6) from f, (values (1), (2)) t(k)
    where year = 2000""")
def _(v):
    s = v.cell_year.filter("year <= 2000").selectExpr(
        "cell_id", "year", "case when year % 3 = 0 then 0 else value2 end value")
    return rounded(R.fill_with_unit_mean(s, "cell_id", "value", 2000, 2002), 6, "value")


@query("r14_unit_mean_fill_all_years", """
  with s as (select cell_id, year, case when year % 3 = 0 then 0 else value2 end as value
    from cell_year),
  f as (select cell_id, year, coalesce(nullif(value, 0),
    avg(nullif(value, 0)) over (partition by cell_id)) as value from s)
  select cell_id, year, round(value, 6) as value from f
  union all select cell_id, year + k, round(value, 6) from f, (values (1), (2)) t(k)
    where year = (select max(year) from cell_year)""")
def _(v):
    last = v.cell_year.agg(F.max("year")).first()[0]
    s = v.cell_year.selectExpr("cell_id", "year", "case when year % 3 = 0 then 0 else value2 end value")
    return rounded(R.fill_with_unit_mean(s, "cell_id", "value", last, last + 2), 6, "value")


@query("r15_sorted_columns", """
  select p_partkey, p_brand, p_name, p_retailprice, p_size, p_type from part""")
def _(v):
    return R.sort_columns(v.part, first=["p_partkey"])


@query("r16_deduplicate", """
  select l_orderkey, l_linenumber, l_partkey, l_quantity from (
    select *, row_number() over (partition by l_orderkey, l_linenumber
      order by l_partkey, l_quantity) as rn
    from lineitem) where rn = 1""")
def _(v):
    rows = v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.deduplicate(rows, ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("g1_points_to_cells", """
  select well_id, cast(floor(45 - lat) as int) as "row", cast(floor(lon + 120) as int) as col
  from well_registry where floor(45 - lat) >= 0 and floor(lon + 120) between 0 and 9""")
def _(v):
    return G.points_to_cells(v.well_registry, well_grid(v)).select("well_id", "row", "col")


@query("g2_cell_centres", """
  select cell_id, col_i + 0.5e0 as lon, -(row_i + 0.5e0) as lat from cell""")
def _(v):
    return G.with_centres(v.cell, GridSpec(0.0, 0.0, 1.0, 1, 50)).select("cell_id", "lon", "lat")


@query("g3_dense_pixel_id", """
  select row_i as "row", col_i as col, row_number() over (order by row_i, col_i) as pixel_id
  from cell where value is not null""")
def _(v):
    return G.dense_pixel_id(A.reference_cells(v.cell))


@query("g4_sum_points", """
  select w.year, cast(floor(45 - lat) as int) as "row", cast(floor(lon + 120) as int) as col,
    nullif(sum(af), 0) as af
  from wells w join well_registry r on r.well_id = '0' || w.well_id
  where floor(45 - lat) >= 0 and floor(lon + 120) between 0 and 9 group by 1, 2, 3""")
def _(v):
    placed = G.points_to_cells(R.attach_coordinates(
        R.pad_short_ids(v.wells), v.well_registry.drop("basin_id")), well_grid(v))
    return G.sum_points(placed, ["year", "row", "col"], "af")


@query("g12_fishnet", """
  with e as (select p_brand, min(p_partkey % 50) * 1e0 as xmin, max(p_partkey % 50) * 1e0 + 1 as xmax,
    min(p_size) * 1e0 as ymin, max(p_size) * 1e0 + 1 as ymax from part group by 1),
  d as (select *, greatest(cast(ceil((xmax - xmin) / 7e0) as bigint), 1) as w,
    greatest(cast(ceil((ymax - ymin) / 9e0) as bigint), 1) as h from e),
  x as (select *, unnest(range(0, w)) as i from d), y as (select *, unnest(range(0, h)) as j from x)
  select p_brand, i * h + j + 1 as box_id, xmin + i * 7 as x0, ymin + j * 9 as y0,
    xmin + i * 7 + 7 as x1, ymin + j * 9 + 9 as y1 from y""")
def _(v):
    extents = v.part.groupBy("p_brand").agg(
        F.min(F.col("p_partkey") % 50).cast("double").alias("xmin"),
        (F.max(F.col("p_partkey") % 50) + 1).cast("double").alias("xmax"),
        F.min("p_size").cast("double").alias("ymin"),
        (F.max("p_size") + 1).cast("double").alias("ymax"))
    return G.fishnet(extents, 7.0, 9.0)


@query("g13_cell_boxes", """
  select cell_id, row_i * 50 + col_i + 1 as box_id, col_i * 1e0 as x0, -(row_i + 1) * 1e0 as y0,
    (col_i + 1) * 1e0 as x1, row_i * -1e0 as y1 from cell""")
def _(v):
    boxes = G.with_boxes(v.cell, GridSpec(0.0, 0.0, 1.0, 1, 50))
    return boxes.select("cell_id", "box_id", "x0", "y0", "x1", (F.col("y1") + 0.0).alias("y1"))


@query("g14_window_assign", """
  select cell_id, case when col_i + 0.5e0 between 10 and 20 and -(row_i + 0.5e0) between -30 and -5
    then 1e0 else value end as value from cell""")
def _(v):
    return G.window_assign(v.cell, GridSpec(0.0, 0.0, 1.0, 1, 50), (10, 20), (-30, -5),
                           "value", 1.0).select("cell_id", "value")


@query("a1_af_to_mm", """
  select l_orderkey, l_linenumber,
    round(af * 1233481837548e0 / ((2199.59e0 * 1000) * (1746.53e0 * 1000)), 6) as mm from wells""")
def _(v):
    return v.wells.select("l_orderkey", "l_linenumber",
                          F.round(U.af_to_mm("af"), 6).alias("mm"))


def _layer(v, rest, value="value"):
    return v.cell_year.filter(F.col("cell_id") % 4 == rest).select(
        "year", "row", "col", F.col(value).alias("value"))


@query("a2_sum_layers", """
  with t as (select year, row_i, col_i, value from cell_year
    union all select year, row_i, col_i, value2 from cell_year)
  select year, row_i as "row", col_i as col, round(coalesce(sum(t.value), 0), 2) as value from t
  semi join (select row_i, col_i from cell where value is not null) r using (row_i, col_i)
  group by 1, 2, 3""")
def _(v):
    cy = v.cell_year.select("year", "row", "col", "value", "value2")
    layers = [cy.drop("value2"), cy.drop("value").withColumnRenamed("value2", "value")]
    return rounded(A.sum_layers(layers, ["year", "row", "col"], A.reference_cells(v.cell)),
                   2, "value")


@query("a3_mean_layers", """
  with t as (select row_i, col_i, value from cell_year where year = 1997
    union all select row_i, col_i, value from cell_year where year = 1998
    union all select row_i, col_i, value2 from cell_year where year = 1999)
  select row_i as "row", col_i as col, round(case when count(value) = 3 then sum(value) / 3 end, 6)
    as value from t group by 1, 2""")
def _(v):
    def year(y, c):
        return v.cell_year.filter(F.col("year") == y).select("row", "col", F.col(c).alias("value"))
    return rounded(A.mean_layers([year(1997, "value"), year(1998, "value"), year(1999, "value2")],
                                 ["row", "col"]), 6, "value")


@query("a3_mean_layers_all_years", """
  select row_i as "row", col_i as col, round(case when count(value) =
    (select count(distinct year) from cell_year) then avg(value) end, 6) as value
  from cell_year group by 1, 2""")
def _(v):
    return rounded(A.mean_of_all(v.cell_year, ["row", "col"], "year"), 6, "value")


@query("a4_threshold", """
  select cell_id, case when value >= 1000 then value else 0 end as keep_low,
    case when value between 1000 and 1050 then value else 0 end as keep_band,
    case when value >= 1000 then 7e0 else 0 end as set_low,
    case when value between 1000 and 1050 then 7e0 else 0 end as set_band from cell""")
def _(v):
    c = v.cell.select("cell_id", *[F.col("value").alias(n) for n in
                                   ("keep_low", "keep_band", "set_low", "set_band")])
    c = A.threshold(c, 1000, value="keep_low")
    c = A.threshold(c, 1000, 1050, value="keep_band")
    c = A.threshold(c, 1000, assign=7, value="set_low")
    return A.threshold(c, 1000, 1050, 7, "set_band")


@query("a5_mosaic", """
  with t as (select cell_id % 500 as cell, year, cell_id % 4 * 100000 + cell_id as priority, value
    from cell_year)
  select cell, year, round(arg_min(value, priority), 2) as first_value, round(min(value), 2) as min_value,
    round(max(value), 2) as max_value from t group by 1, 2""")
def _(v):
    tiles = v.cell_year.select(
        (F.col("cell_id") % 500).alias("cell"), "year",
        (F.col("cell_id") % 4 * 100000 + F.col("cell_id")).alias("priority"), "value")
    keys = ["cell", "year"]
    out = A.mosaic(tiles, keys, "first").withColumnRenamed("value", "first_value")
    for how in ("min", "max"):
        out = out.join(A.mosaic(tiles, keys, how).withColumnRenamed("value", f"{how}_value"), keys)
    return rounded(out, 2, "first_value", "min_value", "max_value")


@query("a6_overlay", """
  with b as (select year, row_i, col_i, case when cell_id % 5 = 0 then 0 else value end as base
    from cell_year where value2 > 20),
  p as (select year, row_i, col_i, case when cell_id % 7 = 0 then 0 else value2 end as patch
    from cell_year where value2 < 100)
  select year, row_i as "row", col_i as col, round(coalesce(nullif(patch, 0), nullif(base, 0)), 2) as value
  from b full join p using (year, row_i, col_i)""")
def _(v):
    cols = ["year", "row", "col"]
    base = v.cell_year.filter("value2 > 20").select(
        *cols, F.expr("case when cell_id % 5 = 0 then 0 else value end").alias("value"))
    patch = v.cell_year.filter("value2 < 100").select(
        *cols, F.expr("case when cell_id % 7 = 0 then 0 else value2 end").alias("value"))
    return rounded(A.overlay(base, patch, cols), 2, "value")


@query("a7_water_balance_filter", """
  with j as (select y.cell_id, y.year, y.value2 * 1000 as pump, y.value as et, c.value as peff,
    y.value2 * 10 as sw from cell_year y join cell c using (cell_id)),
  w as (select *, peff + pump + case when year <= 1999 then sw else 0 end as water from j)
  select cell_id, year, case when water > 0 and et > 1e-6
    and water / et between 0.5e0 and 0.9e0 then nullif(pump, 0) end as pump from w""")
def _(v):
    j = v.cell_year.join(v.cell.select("cell_id", F.col("value").alias("peff")), "cell_id").select(
        "cell_id", "year", (F.col("value2") * 1000).alias("pump"), F.col("value").alias("et"),
        "peff", (F.col("value2") * 10).alias("sw"))
    return A.water_balance_filter(j, sw="sw", low=0.5, high=0.9, sw_last_year=1999).select(
        "cell_id", "year", "pump")


@query("a8_range_filter", """
  select cell_id, year, case when value2 between 50 and 120 then value2 end as value2
  from cell_year""")
def _(v):
    return A.range_filter(v.cell_year, 50, 120, "value2").select("cell_id", "year", "value2")


@query("a9_priority_combine", """
  with t as (select cell_id % 500 as cell, year, cell_id % 4 as r, max(value2 - 60) as value
    from cell_year group by 1, 2, 3)
  select cell, year, arg_min(value, r) as value from t
  where value > 0 and not (r = 1 and year = 1998) group by 1, 2""")
def _(v):
    t = v.cell_year.groupBy((F.col("cell_id") % 500).alias("cell"), "year",
                            (F.col("cell_id") % 4).alias("r")).agg(
        F.max(F.col("value2") - 60).alias("value"))
    layers = {n: t.filter(F.col("r") == i).drop("r")
              for i, n in enumerate(("NV", "AZ", "CO", "KS"))}
    gaps = v.spark.createDataFrame([("AZ", 1998)], "region string, year int")
    return A.combine_by_priority(layers, ["cell", "year"], gaps)


@query("a11_product_and_ratio", """
  select y.row_i as "row", y.col_i as col, y.year, round(y.value2 * y.disc, 9) as use,
    round(y.value2 / (cell_id % 7), 6) as pumping from cell_year y
  where cell_id % 7 > 0""")
def _(v):
    keys = ["row", "col", "year"]
    cy = v.cell_year
    a, b = cy.select(*keys, F.col("value2").alias("value")), cy.select(*keys, F.col("disc").alias("value"))
    use = A.product(a, b, keys).withColumnRenamed("value", "use")
    c = cy.select(*keys, (F.col("cell_id") % 7).alias("value"))
    pump = A.quotient(a, c, keys).withColumnRenamed("value", "pumping")
    return rounded(rounded(use.join(pump, keys), 6, "pumping"), 9, "use")


@query("a12_difference", """
  select row_i as "row", col_i as col, year, value2 - 60 as balance,
    greatest(value2 - 60, 0) as consumptive from cell_year""")
def _(v):
    keys = ["row", "col", "year"]
    a = v.cell_year.select(*keys, F.col("value2").alias("value"))
    b = v.cell_year.select(*keys, F.lit(60.0).alias("value"))
    free = A.difference(a, b, keys).withColumnRenamed("value", "balance")
    held = A.difference(a, b, keys, floor=0.0).withColumnRenamed("value", "consumptive")
    return free.join(held, keys)


_GROUPS = """case when zone in (4, 5, 6) then 1 when zone in (7, 8, 9, 10) then 2
    when zone in (14, 15, 16, 21, 25) then 3 when zone in (17, 18, 19, 22, 26, 27) then 4 end"""


@query("a13_reclassify", f"select cell_id, {_GROUPS} as group_id from cell")
def _(v):
    return A.reclassify(v.cell, "zone").select("cell_id", "group_id")


@query("a14_one_hot", """
  select cell_id, cast(zone in (4, 5, 6) as int) as arid,
    cast(zone in (7, 8, 9, 10) as int) as temperate_dry_summer,
    cast(zone in (14, 15, 16, 21, 25) as int) as temperate_no_dry_summer,
    cast(zone in (17, 18, 19, 22, 26, 27) as int) as cold from cell""")
def _(v):
    return A.one_hot(v.cell, "zone").select(
        "cell_id", "arid", "temperate_dry_summer", "temperate_no_dry_summer", "cold")


@query("a15_zone_threshold", """
  select cell_id, year, case when value2 / 2000 > case when c.zone <= 10 then 0.01e0 else 0.05e0 end then 1
    end as value from cell_year y join cell c using (cell_id)""")
def _(v):
    cells = v.cell_year.select("cell_id", "year", (F.col("value2") / 2000).alias("value"))
    return A.classify_irrigated(cells, v.cell.filter("zone <= 10"), ["cell_id"], outside=0.05)


@query("a16_fill_on_grid", """
  select r.row_i as "row", r.col_i as col, round(coalesce(y.value, 0), 2) as value
  from (select row_i, col_i from cell where value is not null) r
  left join (select row_i, col_i, value from cell_year where year = 1998) y using (row_i, col_i)""")
def _(v):
    layer = v.cell_year.filter("year = 1998").select("row", "col", "value")
    return rounded(A.fill_on_grid(A.reference_cells(v.cell), layer), 2, "value")


@query("a16_fill_on_grid_all_years", """
  select t.year, r.row_i as "row", r.col_i as col, round(coalesce(y.value, 0), 2) as value
  from (select row_i, col_i from cell where value is not null) r
  cross join (select distinct year from cell_year) t left join cell_year y
    on y.row_i = r.row_i and y.col_i = r.col_i and y.year = t.year""")
def _(v):
    keys = ["year", "row", "col"]
    years = v.cell_year.agg(F.collect_set("year")).scalar()
    every = A.reference_cells(v.cell).withColumn("year", F.explode(years))
    return rounded(A.fill_on_grid(every, v.cell_year.select(*keys, "value"), keys), 2, "value")


@query("a17_normalise", """
  select cell_id, year, round((value - min(value) over (partition by year)) / nullif(
    max(value) over (partition by year) - min(value) over (partition by year), 0), 6) as value
  from cell_year""")
def _(v):
    return rounded(A.normalise(v.cell_year.select("cell_id", "year", "value"), ["year"]), 6, "value")


@query("a18_dominated_class", """
  select cell_id, case when c.zone * 2 >= 70 then 1 else 0 end as value from cell c
  where exists (select 1 from cell_year y where y.cell_id = c.cell_id and y.value2 > 100)""")
def _(v):
    share = v.cell.select("cell_id", (F.col("zone") * 2).alias("value"))
    pred = v.cell_year.select("cell_id", F.when(F.col("value2") > 100, F.col("value2")).alias("value"))
    return A.dominated_class(share, pred, ["cell_id"])


@query("a19_reference_cells", """
  select row_i as "row", col_i as col from cell where value is not null""")
def _(v):
    return A.reference_cells(v.cell)


@query("a20_blank_unmasked", """
  select y.cell_id, y.year, case when c.zone < 25 then round(y.value, 2) end as predicted
  from cell_year y join cell c using (cell_id)""")
def _(v):
    pred = v.cell_year.select("cell_id", "year", F.col("value").alias("predicted"))
    return rounded(A.blank_unmasked(pred, v.cell.filter("zone < 25"), ["cell_id"]), 2, "predicted")


@query("a21_clamp_negative", """
  select cell_id, case when value is not null then greatest(value - 1000, 0) end as predicted
  from cell""")
def _(v):
    return A.clamp_negative(v.cell.select("cell_id", (F.col("value") - 1000).alias("predicted")))


@query("s8_nodata_round_trip", """
  select cell_id, value, coalesce(value, -9999) as stored from cell""")
def _(v):
    from aquagrid.sources.rasters import encode_layer
    stored = encode_layer(v.cell.select("cell_id", "value"))
    return stored.select("cell_id", N.decode_nodata("value").alias("value"),
                         F.col("value").alias("stored"))
