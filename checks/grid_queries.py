"""Polygons, neighbourhoods, time and band arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from aquagrid.constants import GridSpec
from aquagrid.functions import indices as I, units as U
from aquagrid.operators import focal as FO, grid as G, polygons as P, temporal as T
from checks.registry import query, rounded

# The least height of the test grid; the polygons, not the grid, bound the work.
GRID = GridSpec(0.0, 0.0, 1.0, 10_000_000, 50)
# survey points lie within 44 degrees of the top at every scale
TILES = GridSpec(0.0, 0.0, 4.0, 2_500_000, 13)


def tall_grid(v, res=1.0):
    """GRID, lengthened where the cells or the polygons reach below it."""
    last = v.part.agg(F.max("p_partkey")).first()[0] or 0
    depth = v.edges.agg(F.min(F.least("y1", "y2"))).first()[0] or 0.0
    rows = max(GRID.nrows, last // 50 + 1, math.ceil(-depth))
    return GridSpec(0.0, 0.0, res, math.ceil(rows / res), int(GRID.ncols / res))

_IN = """hits as (select e.poly_id, c.row_i, c.col_i from cell c join edges e
    on (e.y1 > -(c.row_i + 0.5e0)) <> (e.y2 > -(c.row_i + 0.5e0))
    and c.col_i + 0.5e0 < (e.x2 - e.x1) * (-(c.row_i + 0.5e0) - e.y1) / (e.y2 - e.y1) + e.x1
    group by 1, 2, 3 having count(*) % 2 = 1)"""


@query("g7_cells_in_polygons", f"""
  with {_IN} select poly_id, cell_id, value from cell join hits using (row_i, col_i)""")
def _(v):
    return P.clip_cells(v.cell, v.edges, tall_grid(v)).select("poly_id", "cell_id", "value")


@query("g8_cells_outside", f"""
  with {_IN} select cell_id, value from cell anti join hits using (row_i, col_i)""")
def _(v):
    return P.erase_cells(v.cell, v.edges, tall_grid(v)).select("cell_id", "value")


@query("a10_exclude_basins", f"""
  with {_IN} select y.cell_id, y.year, round(y.value, 2) as value from cell_year y anti join (
    select * from hits where poly_id % 10 in (0, 3)) h using (row_i, col_i)""")
def _(v):
    basins = v.edges.filter(F.col("poly_id") % 10 == 0).unionByName(
        v.edges.filter(F.col("poly_id") % 10 == 3))
    return rounded(P.erase_cells(v.cell_year, basins, tall_grid(v)).select("cell_id", "year", "value"),
                   2, "value")


@query("g9_points_in_polygons", """
  select p.point_id, e.poly_id from survey_points p join edges e
    on (e.y1 > lat) <> (e.y2 > lat)
    and lon < (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1
  group by 1, 2 having count(*) % 2 = 1""")
def _(v):
    return P.points_in_polygons(v.survey_points, v.edges, TILES, "point_id")


@query("g5_burn_attribute", f"""
  with {_IN}, b as (select h.row_i, h.col_i, s_acctbal, row_number() over (
      partition by row_i, col_i order by s_nationkey desc, poly_id desc) as rn
    from hits h join supplier on poly_id = s_suppkey)
  select c.cell_id, s_acctbal as attr from cell c join b using (row_i, col_i) where rn = 1""")
def _(v):
    attrs = v.supplier.selectExpr("s_suppkey as poly_id", "s_nationkey", "s_acctbal")
    burned = P.burn_attribute(v.edges, attrs, tall_grid(v), "s_acctbal", "s_nationkey")
    return v.cell.join(burned, ["row", "col"]).select("cell_id", F.col("s_acctbal").alias("attr"))


@query("g6_burn_constant", f"""
  with {_IN} select cell_id, case when h.row_i is null then 0 else 1 end as value
  from cell c left join (select distinct row_i, col_i from hits) h using (row_i, col_i)""")
def _(v):
    return P.burn_constant(v.cell.select("row", "col", "cell_id"), v.edges, tall_grid(v)).select(
        "cell_id", "value")


@query("g15_dissolve", f"""
  with {_IN} select distinct cast(poly_id % 10 as int) as group_id, row_i as "row", col_i as col
  from hits""")
def _(v):
    groups = v.supplier.selectExpr("s_suppkey as poly_id", "cast(s_suppkey % 10 as int) group_id")
    cells = P.dissolve_cells(v.edges, groups, tall_grid(v))
    return cells.join(v.cell.select("row", "col"), ["row", "col"])


@query("g16_polygon_measures", """
  with s as (select poly_id, sum(x1 * y2 - x2 * y1) as a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) as sx,
    sum((y1 + y2) * (x1 * y2 - x2 * y1)) as sy from edges group by 1)
  select poly_id, round(abs(a) / 2, 5) as area, round(sx / (3 * a), 5) as cx,
    round(sy / (3 * a), 5) as cy from s""")
def _(v):
    return rounded(P.polygon_measures(v.edges), 5, "area", "cx", "cy")


_TOUCH = """touch as (select s.line_id, c.row_i, c.col_i from cell c join segments s
    on c.col_i <= greatest(x1, x2) and c.col_i + 1 >= least(x1, x2)
    and -c.row_i >= least(y1, y2) and -(c.row_i + 1) <= greatest(y1, y2)
    and greatest((x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i-x1),
      (x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i+1-x1),
      (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i-x1),
      (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i+1-x1)) >= 0
    and least((x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i-x1),
      (x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i+1-x1),
      (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i-x1),
      (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i+1-x1)) <= 0)"""


@query("g10_cells_on_lines", f"""
  with {_TOUCH} select line_id, row_i as "row", col_i as col from touch""")
def _(v):
    touched = G.cells_on_lines(v.segments, tall_grid(v))
    return touched.join(v.cell.select("row", "col"), ["row", "col"])


@query("g11_within_distance", """
  with d as (select p.point_id, e.poly_id, count(case when (e.y1 > lat) <> (e.y2 > lat)
      and lon < (e.x2 - e.x1) * (lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 then 1 end) as k,
    min((lon - x1 - greatest(0, least(1, ((lon-x1)*(x2-x1) + (lat-y1)*(y2-y1))
        / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) * (x2-x1)) ** 2
      + (lat - y1 - greatest(0, least(1, ((lon-x1)*(x2-x1) + (lat-y1)*(y2-y1))
        / ((x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)))) * (y2-y1)) ** 2) as d2
    from survey_points p join edges e
      on lat between least(y1, y2) - 12 and greatest(y1, y2) + 12 group by 1, 2)
  select point_id, poly_id from d where k % 2 = 1 or d2 <= 0.75e0 * 0.75e0""")
def _(v):
    return P.points_within_distance(v.survey_points, v.edges, 0.75, TILES, "point_id")


@query("g12_boxes_over_region", f"""
  with {_IN}, f as (select row_i, col_i from hits union select row_i, col_i from (
      select c.row_i, c.col_i from cell c join edges s
      on c.col_i <= greatest(x1, x2) and c.col_i + 1 >= least(x1, x2)
      and -c.row_i >= least(y1, y2) and -(c.row_i + 1) <= greatest(y1, y2)
      and greatest((x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i-x1),
        (x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i+1-x1),
        (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i-x1),
        (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i+1-x1)) >= 0
      and least((x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i-x1),
        (x2-x1)*(-c.row_i-y1) - (y2-y1)*(c.col_i+1-x1),
        (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i-x1),
        (x2-x1)*(-c.row_i-1-y1) - (y2-y1)*(c.col_i+1-x1)) <= 0))
  select row_i * 50 + col_i + 1 as box_id from f""")
def _(v):
    boxes = G.with_boxes(v.cell, tall_grid(v))
    return P.boxes_over_polygons(boxes, v.edges, tall_grid(v)).select("box_id")


def _coarse(v):
    return v.cell.groupBy(F.expr("cast(floor(row / 5) as int)").alias("row"),
                          F.expr("cast(floor(col / 5) as int)").alias("col")).agg(
        F.max("value").alias("value"))


@query("n1_resample_nearest", """
  with s as (select floor(row_i / 5) as r, floor(col_i / 5) as c, max(value) as value from cell
    group by 1, 2)
  select cell_id, s.value from cell left join s on r = floor(row_i / 5) and c = floor(col_i / 5)""")
def _(v):
    return FO.resample_nearest(_coarse(v), tall_grid(v, 5.0), v.cell.select("cell_id", "row", "col"),
                               tall_grid(v)).select("cell_id", "value")


@query("n2_resample_aggregate", """
  with m as (select r, c, arg_min(value, (-n, value)) as mode from (
    select cast(floor(row_i / 5) as int) as r, cast(floor(col_i / 5) as int) as c, zone as value,
      count(*) as n from cell group by 1, 2, 3) group by 1, 2)
  select cast(floor(row_i / 5) as int) as coarse_row, cast(floor(col_i / 5) as int) as coarse_col,
    round(avg(zone), 6) as average, max(zone) as highest, min(zone) as lowest, any_value(mode) as mode
  from cell join m on r = floor(row_i / 5) and c = floor(col_i / 5) group by 1, 2""")
def _(v):
    cells = v.cell.select("row", "col", F.col("zone").alias("value"))
    out = None
    for how, name in (("average", "average"), ("max", "highest"), ("min", "lowest"), ("mode", "mode")):
        part = FO.resample_aggregate(cells, 5, how).withColumnRenamed("value", name)
        out = part if out is None else out.join(part, ["coarse_row", "coarse_col"])
    return rounded(out, 6, "average")


@query("n2_resample_bilinear", """
  with s as (select floor(row_i / 5) as r, floor(col_i / 5) as c, max(value) as value from cell
    group by 1, 2),
  t as (select cell_id, (col_i + 0.5e0) / 5 - 0.5e0 as u, (row_i + 0.5e0) / 5 - 0.5e0 as v from cell),
  w as (select cell_id, floor(v) + dr as r, floor(u) + dc as c,
    (1 - abs(v - floor(v) - dr)) * (1 - abs(u - floor(u) - dc)) as w
    from t, (values (0, 0), (0, 1), (1, 0), (1, 1)) o(dr, dc))
  select cell_id, round(sum(w * value) / nullif(sum(case when value is not null then w end), 0), 6)
    as value from w left join s using (r, c) group by 1""")
def _(v):
    target = v.cell.select("cell_id", "row", "col")
    out = FO.resample_bilinear(_coarse(v), tall_grid(v, 5.0), target, tall_grid(v))
    return rounded(out.select("cell_id", "value"), 6, "value")


@query("n3_clip_and_resample", f"""
  with {_IN}, k as (select distinct c.row_i, c.col_i, c.value from cell c join hits using (row_i, col_i))
  select a.cell_id, k.value from cell a left join k on k.row_i = floor((a.row_i * 2 + 1) / 2 * 0.5e0)
    and k.col_i = floor((a.col_i + 0.5e0) * 0.5e0)""")
def _(v):
    source = v.cell.select("row", "col", "value")
    return FO.clip_and_resample(source, tall_grid(v), v.edges, v.cell.select("cell_id", "row", "col"),
                                tall_grid(v, 0.5)).select("cell_id", "value")


@query("n4_flagged_fraction", """
  select year, cast(floor(row_i / 5) as int) as coarse_row, cast(floor(col_i / 5) as int) as coarse_col,
    round(count(case when value2 > 60 then 1 end) / count(*), 6) as fraction
  from cell_year group by 1, 2, 3""")
def _(v):
    return rounded(FO.flagged_fraction(v.cell_year, F.col("value2") > 60, 5, ["year"]), 6,
                   "fraction")


@query("n5_merge_presence", """
  select cell_id, year, max(value) as value from (
    select cell_id, year, case when value2 > 60 then 1 end as value from cell_year where value2 < 100
    union all select cell_id, year, case when value2 > 90 then 1 end from cell_year
      where value2 > 30) group by 1, 2""")
def _(v):
    a = v.cell_year.filter("value2 < 100").selectExpr(
        "cell_id", "year", "case when value2 > 60 then 1 end value")
    b = v.cell_year.filter("value2 > 30").selectExpr(
        "cell_id", "year", "case when value2 > 90 then 1 end value")
    return FO.merge_presence(a, b, ["cell_id", "year"])


def _extent(v):
    """The smallest grid of 50 columns that holds the layer."""
    rows = v.part.agg(F.max("p_partkey")).first()[0] // 50 + 1  # one number
    return GridSpec(0.0, 0.0, 1.0, int(rows), 50)


def _smooth_sql(sigma, half):
    weight = " + ".join(f"exp(-0.5e0 * ({d} / {sigma}e0) ** 2)" for d in range(-half, half + 1))
    return f"""
  with w as (select a.cell_id, a.value as centre, b.value as v,
      exp(-0.5e0 * ((a.row_i - b.row_i) / {sigma}e0) ** 2) * exp(-0.5e0 * ((a.col_i - b.col_i) / {sigma}e0) ** 2)
      / (({weight}) ** 2) as k
    from cell a join cell b on b.row_i between a.row_i - {half} and a.row_i + {half}
      and b.col_i between a.col_i - {half} and a.col_i + {half})
  select cell_id, round(case when any_value(centre) is not null then
    sum(case when v is not null then k * v end) / (1 - coalesce(sum(case when v is null then k end), 0))
    end, 6) as value from w group by 1"""


@query("n6_gaussian_smooth", _smooth_sql(1, 1))
def _(v):
    smooth = FO.gaussian_smooth(v.cell.select("row", "col", "value"), _extent(v), sigma=1.0)
    return rounded(smooth.join(v.cell.select("row", "col", "cell_id"), ["row", "col"]).select(
        "cell_id", "value"), 6, "value")


@query("n7_distance_to_target", """
  select a.cell_id, round(min(sqrt((a.row_i - b.row_i) ** 2 + (a.col_i - b.col_i) ** 2)) * 0.02e0, 6)
    as distance from cell a, (select row_i, col_i from cell where zone = 1) b group by 1""")
def _(v):
    grid = GridSpec(0.0, 0.0, 0.02, 1, 50)
    out = FO.distance_to_target(v.cell.select("row", "col", "zone"), "zone = 1", grid)
    return rounded(out.join(v.cell.select("row", "col", "cell_id"), ["row", "col"]).select(
        "cell_id", "distance"), 6, "distance")


@query("n8_sample_at_points", """
  select point_id, y.year, round(y.value, 2) as value from survey_points p join cell_year y
    on y.col_i = floor(lon) and y.row_i = floor(-lat)""")
def _(v):
    layers = v.cell_year.select("row", "col", "year", "value")
    out = FO.sample_at_points(v.survey_points, layers, tall_grid(v))
    return rounded(out.select("point_id", "year", "value"), 2, "value")


_EVENT_LAYERS = [("click", "sum", 2.0, "2024-01-01", "2024-02-01"),
                 ("view", "mean", 0.1, "2024-01-01", "2024-02-01"),
                 ("purchase", "first", 1.0, "2024-01-01", "2024-02-01"),
                 ("error", "sum", 1.0, "2024-01-05", "2024-02-01")]


@query("m1_monthly_reduce", """
  select var, cell_id, cast(year(ts) as int) as year, cast(month(ts) as int) as month,
    round(case var when 'click' then sum(value) * 2 when 'view' then avg(value) * 0.1e0
      else arg_min(value, (ts, value)) end, 6) as value
  from daily_obs where var in ('click', 'view', 'purchase')
  group by var, cell_id, 3, 4""")
def _(v):
    return rounded(T.monthly_reduce(v.daily_obs, _EVENT_LAYERS), 6, "value")


@query("m2_yearly_reduce", """
  select cell_id, year, round(sum(value), 2) as value from dense_month
  where month between 4 and 9 group by 1, 2""")
def _(v):
    return rounded(T.yearly_reduce(v.dense_month, 4, 9, ["cell_id"]), 2, "value")


@query("m3_bias_and_units", """
  select event_id, round(value * 0.85e0, 6) as ret, round(value / 3600, 9) as hours from daily_obs""")
def _(v):
    return v.daily_obs.select("event_id", F.round(U.correct_ret("value"), 6).alias("ret"),
                              F.round(U.seconds_to_hours("value"), 9).alias("hours"))


@query("m4_dated_snapshot", """
  select var, cell_id, cast(year(ts) as int) as year, round(avg(value), 6) as value from daily_obs
  where strftime(ts, '%m-%d') >= '01-24' and strftime(ts, '%m-%d') < '01-30' group by 1, 2, 3""")
def _(v):
    return rounded(T.dated_snapshot(v.daily_obs, ["var", "cell_id"], "01-24", "01-30"), 6, "value")


@query("m5_mean_over_bands", """
  select l_partkey as cell_id, round(avg(band), 10) as by_rows, round(avg(mean3), 10) as by_columns
  from (select l_partkey, unnest([l_tax, l_discount, l_quantity]) as band,
    (l_tax + l_discount + l_quantity) / 3 as mean3 from lineitem) group by 1""")
def _(v):
    rows = T.mean_of_columns(v.lineitem, ["l_tax", "l_discount", "l_quantity"], "mean3")
    long = rows.select(F.col("l_partkey").alias("cell_id"), F.explode(
        F.array("l_tax", "l_discount", "l_quantity")).alias("value"))
    a = T.mean_over_bands(long, ["cell_id"]).withColumnRenamed("value", "by_rows")
    b = T.mean_over_bands(rows.select(F.col("l_partkey").alias("cell_id"), F.col("mean3").alias(
        "value")), ["cell_id"]).withColumnRenamed("value", "by_columns")
    return rounded(a.join(b, "cell_id"), 10, "by_rows", "by_columns")


@query("m6_doy_to_month", """
  select l_orderkey, l_linenumber, l_partkey, cast(dayofyear(l_shipdate) as int) as doy,
    cast(month(l_shipdate) as int) as month from lineitem""")
def _(v):
    return v.lineitem.withColumn("doy", F.dayofyear("l_shipdate")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "doy",
        U.doy_to_month(F.year("l_shipdate"), "doy").alias("month"))


def _season_sql(pick):
    return f"""
  with g as (select m.cell_id, m.year, coalesce(sum(case when month between start_month and end_month
      then value2 end), 0) as total, count(value2) as n, coalesce(greatest(any_value(end_month)
      - any_value(start_month) + 1, 0), 0) as len,
      any_value(start_month) is null or any_value(end_month) is null as none
    from dense_month m left join season s using (cell_id) group by 1, 2)
  select cell_id, year, round({pick}, 6) as value from g"""


@query("m7_season_sum", _season_sql("case when n = 12 then total end"))
def _(v):
    return rounded(T.season_sum(v.dense_month.select("cell_id", "year", "month",
        F.col("value2").alias("value")), v.season, ["cell_id"]), 6, "value")


@query("m8_season_mean", _season_sql(
    "case when n = 12 and not none then total / nullif(len, 0) end"))
def _(v):
    return rounded(T.season_mean(v.dense_month.select("cell_id", "year", "month",
        F.col("value2").alias("value")), v.season, ["cell_id"]), 6, "value")


@query("i1_normalised_difference", """
  select l_orderkey, l_linenumber, l_partkey, round((a - b) / nullif(a + b, 0), 6) as nd from (
    select *, l_tax * 2.75e-1 - 0.02e0 as a, l_discount * 2.75e-1 - 0.02e0 as b from lineitem)""")
def _(v):
    a, b = I.scaled("l_tax", 0.275, -0.02), I.scaled("l_discount", 0.275, -0.02)
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.round(I.normalised_difference(a, b), 6).alias("nd"))


@query("i2_osavi_gcvi", """
  select l_orderkey, l_linenumber, l_partkey,
    round((l_tax - l_discount) / (l_tax + l_discount + 0.16e0), 6) as osavi,
    round(l_tax / nullif(l_discount, 0) - 1, 6) as gcvi from lineitem""")
def _(v):
    return v.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             F.round(I.osavi("l_tax", "l_discount"), 6).alias("osavi"),
                             F.round(I.gcvi("l_tax", "l_discount"), 6).alias("gcvi"))


@query("i3_bit_field_mask", """
  select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem
  where ((l_partkey >> 2) & 7) <= 1""")
def _(v):
    return v.lineitem.filter(I.bit_field_clear("l_partkey", 2, 4)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("i4_bits_unset", """
  select l_orderkey, l_linenumber, l_partkey from lineitem
  where (l_partkey & 8) = 0 and (l_partkey & 16) = 0""")
def _(v):
    return v.lineitem.filter(I.bits_unset("l_partkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey")


@query("i5_crop_mask", """
  select l_orderkey, l_linenumber, l_partkey from lineitem where l_partkey % 200 not in
    (60, 61, 63, 64, 65, 81, 82, 83, 87, 88, 111, 112, 121, 122, 123, 124, 131, 141, 142, 143,
     152, 190, 195)""")
def _(v):
    return v.lineitem.filter(I.is_crop(F.col("l_partkey") % 200)).select(
        "l_orderkey", "l_linenumber", "l_partkey")
