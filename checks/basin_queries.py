"""Basin summaries and water balances."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.operators import balance as B, polygons as P, zonal as Z
from checks.grid_queries import _IN, tall_grid
from checks.registry import query, rounded

_AREA = "((2199.59e0 * 1000) * (1746.53e0 * 1000))"


def _totals_sql(column, name):
    m3 = f"coalesce(sum({column}), 0) * {_AREA} / 1e9"
    return (f"coalesce(sum({column}), 0) as {name}_mm, {m3} as {name}_m3, "
            f"{m3} / 1233.48e0 as {name}_AF, {m3} / 1233.48e0 * 1233481837547.5e0 "
            f"/ (any_value(area_m2) * 1e6) as mean_{name}_mm")


_PIX = """pix as (select basin_code, y.year, y.cell_id, y.row_i, y.col_i,
    case when coalesce(p.value2, 0) * 20 > 2000 then 0 else coalesce(p.value2, 0) * 20 end
      as pred_pumping_mm, coalesce(a.value2 * 3, 0) as actual_pumping_mm
  from cell_year y left join (select * from cell_year where value2 > 30) p
      on p.cell_id = y.cell_id and p.year = y.year
    left join (select * from cell_year where value2 < 150) a
      on a.cell_id = y.cell_id and a.year = y.year
    join cell_basin b on b.cell_id = y.cell_id
  where y.value2 > 30 or y.value2 < 150)"""


def _pixels(v):
    cy = v.cell_year.select("row", "col", "year", "cell_id", "value", "value2")
    keys = ["row", "col", "year"]
    pred = cy.filter("value2 > 30").select(*keys, (F.col("value2") * 20).alias("value"))
    actual = cy.filter("value2 < 150").select(*keys, (F.col("value2") * 3).alias("value"))
    return Z.compare_pixels(pred, actual, v.cell_basin)


@query("z1_clip_to_basins", f"""
  with {_IN} select poly_id as basin_code, y.cell_id, y.year, round(y.value, 2) as value
  from cell_year y join hits using (row_i, col_i)""")
def _(v):
    edges = v.edges.withColumnRenamed("poly_id", "basin_code")
    out = Z.clip_to_basins(v.cell_year, edges, tall_grid(v))
    return rounded(out.select("basin_code", "cell_id", "year", "value"), 2, "value")


@query("z2_compare_pixels", f"""
  with {_PIX} select basin_code, year, row_i as "row", col_i as col, round(pred_pumping_mm, 6) as
    pred_pumping_mm, round(actual_pumping_mm, 6) as actual_pumping_mm from pix""")
def _(v):
    return rounded(_pixels(v), 6, "pred_pumping_mm", "actual_pumping_mm")


_TOTALS = f"""tot as (select basin_code, year, {_totals_sql('pred_pumping_mm', 'pred_pumping')},
    {_totals_sql('actual_pumping_mm', 'actual_pumping')}
  from pix join basin_dim using (basin_code) group by 1, 2)"""
_MEASURES = [f"{n}_{u}" for n in ("pred_pumping", "actual_pumping") for u in ("mm", "m3", "AF")] + [
    "mean_pred_pumping_mm", "mean_actual_pumping_mm"]
_ROUNDED = ", ".join(f"round({m}, 3) as {m}" for m in _MEASURES)


def _totals(v):
    return Z.annual_totals(_pixels(v), v.basin_dim)


@query("z3_annual_totals", f"""
  with {_PIX}, {_TOTALS} select basin_code, year, {_ROUNDED} from tot""")
def _(v):
    return rounded(_totals(v), 3, *_MEASURES)


def _reported(v):
    return v.orders.join(v.customer, F.col("o_custkey") == F.col("c_custkey")).join(
        v.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("basin_code"), F.year("o_orderdate").alias("year"),
        F.col("o_totalprice").alias("pumping_AF"))


_REPORTED = """rep as (select n_name as basin_code, cast(year(o_orderdate) as int) as year,
    coalesce(sum(o_totalprice), 0) as Irrigation_AF from orders join customer on o_custkey = c_custkey
    join nation on c_nationkey = n_nationkey group by 1, 2)"""


@query("z5_field_totals", f"""
  with {_REPORTED} select basin_code, year, round(Irrigation_AF, 2) as Irrigation_AF from rep""")
def _(v):
    return rounded(Z.field_totals(_reported(v)), 2, "Irrigation_AF")


@query("z4_totals_against_reports", f"""
  with {_PIX}, {_TOTALS}, {_REPORTED}, j as (select basin_code, year, pred_pumping_mm,
      pred_pumping_m3, pred_pumping_AF, Irrigation_AF as actual_pumping_AF
    from tot full join rep using (basin_code, year) where year >= 1997)
  select basin_code, year, round(pred_pumping_mm, 3) as pred_pumping_mm,
    round(pred_pumping_m3, 3) as pred_pumping_m3, round(pred_pumping_AF, 3) as pred_pumping_AF,
    round(actual_pumping_AF, 2) as actual_pumping_AF,
    round(actual_pumping_AF * 1233.48e0, 1) as actual_pumping_m3,
    round(pred_pumping_AF * 1233481837547.5e0 / (area_m2 * 1e6), 5) as mean_pred_pumping_mm,
    round(actual_pumping_AF * 1233481837547.5e0 / (area_m2 * 1e6), 5) as mean_actual_pumping_mm
  from j join basin_dim using (basin_code)""")
def _(v):
    out = Z.totals_against_reports(_totals(v), Z.field_totals(_reported(v)), v.basin_dim, 1997)
    out = rounded(out, 3, "pred_pumping_mm", "pred_pumping_m3", "pred_pumping_AF")
    out = rounded(rounded(out, 2, "actual_pumping_AF"), 1, "actual_pumping_m3").select(
        "basin_code", "year", "pred_pumping_mm", "pred_pumping_m3", "pred_pumping_AF",
        "actual_pumping_AF", "actual_pumping_m3", "mean_pred_pumping_mm", "mean_actual_pumping_mm")
    return rounded(out, 5, "mean_pred_pumping_mm", "mean_actual_pumping_mm")


_WEIGHTS = f"""{_IN}, small as (select poly_id as small_id, row_i, col_i from hits),
  sized as (select small_id, count(*) as n from small group by 1),
  share as (select small_id, basin_code, count(*) / any_value(n) as share from small
    join sized using (small_id) join big using (row_i, col_i) group by 1, 2),
  wt as (select *, case when share <= 0.2e0 then 0e0 when share >= 0.95e0 then 1e0 else share end
    as weight from share)"""
_BIG = "big as (select row_i, col_i, cast(floor(row_i / 3) % 25 as int) as basin_code from cell)"


def _weights(v):
    grid_cells = v.cell.select("row", "col")
    small = P.cells_in_polygons(v.edges, tall_grid(v)).join(grid_cells, ["row", "col"]).withColumnRenamed(
        "poly_id", "small_id")
    big = v.cell.select("row", "col", F.expr("cast(floor(row / 3) % 25 as int)").alias("basin_code"))
    return Z.overlap_weights(small, big)


@query("z6_overlap_weights", f"""
  with {_BIG}, {_WEIGHTS} select small_id, basin_code, round(share, 6) as share,
    round(weight, 6) as weight from wt""")
def _(v):
    return rounded(_weights(v), 6, "share", "weight")


@query("z6_area_weighted_transfer", f"""
  with {_BIG}, {_WEIGHTS}, val as (select l_suppkey as small_id, cast(year(l_shipdate) as int) as year,
    sum(l_quantity) as value from lineitem group by 1, 2)
  select basin_code, year, round(sum(value * weight), 4) as transferred from val join wt
    using (small_id) group by 1, 2""")
def _(v):
    values = v.lineitem.groupBy(F.col("l_suppkey").alias("small_id"),
                                F.year("l_shipdate").alias("year")).agg(
        F.sum("l_quantity").alias("value"))
    return rounded(Z.area_weighted_transfer(values, _weights(v)), 4, "transferred")


@query("z7_join_annual_series", f"""
  with {_REPORTED}, p as (select basin_code, year, sum(value2) as pred_pumping_AF from cell_year
    join cell_basin using (cell_id) where year < 2000 group by 1, 2),
  j as (select basin_code, year, pred_pumping_AF, Irrigation_AF as reported_AF
    from p full join rep using (basin_code, year))
  select basin_code, year, pred_pumping_AF, round(reported_AF, 2) as reported_AF,
    round(pred_pumping_AF * 1233.48e0, 2) as pred_pumping_m3,
    round(reported_AF * 1233.48e0, 1) as reported_m3,
    round(pred_pumping_AF * 1233481837547.5e0 / (area_m2 * 1e6), 6) as mean_pred_pumping_mm,
    round(reported_AF * 1233481837547.5e0 / (area_m2 * 1e6), 5) as mean_reported_mm
  from j join basin_dim using (basin_code)""")
def _(v):
    pred = v.cell_year.filter("year < 2000").join(v.cell_basin.select("cell_id", "basin_code"), "cell_id").groupBy(
        "basin_code", "year").agg(F.sum("value2").alias("pred_pumping_AF"))
    rep = Z.field_totals(_reported(v), out="reported_AF")
    out = Z.join_annual_series(pred, rep, v.basin_dim)
    out = rounded(rounded(out, 2, "reported_AF", "pred_pumping_m3"), 1, "reported_m3")
    return rounded(rounded(out, 6, "mean_pred_pumping_mm"), 5, "mean_reported_mm")


@query("z7_join_annual_series_all_years", f"""
  with {_REPORTED}, p as (select basin_code, year, sum(value2) as pred_pumping_AF from cell_year
    join cell_basin using (cell_id) group by 1, 2),
  j as (select basin_code, year, pred_pumping_AF, Irrigation_AF as reported_AF
    from p full join rep using (basin_code, year))
  select basin_code, year, pred_pumping_AF, round(reported_AF, 2) as reported_AF,
    round(pred_pumping_AF * 1233.48e0, 2) as pred_pumping_m3,
    round(reported_AF * 1233.48e0, 1) as reported_m3,
    round(pred_pumping_AF * 1233481837547.5e0 / (area_m2 * 1e6), 6) as mean_pred_pumping_mm,
    round(reported_AF * 1233481837547.5e0 / (area_m2 * 1e6), 5) as mean_reported_mm
  from j join basin_dim using (basin_code)""")
def _(v):
    pred = v.cell_year.join(v.cell_basin.select("cell_id", "basin_code"), "cell_id").groupBy(
        "basin_code", "year").agg(F.sum("value2").alias("pred_pumping_AF"))
    rep = Z.field_totals(_reported(v), out="reported_AF")
    out = Z.join_annual_series(pred, rep, v.basin_dim)
    out = rounded(rounded(out, 2, "reported_AF", "pred_pumping_m3"), 1, "reported_m3")
    return rounded(rounded(out, 6, "mean_pred_pumping_mm"), 5, "mean_reported_mm")


@query("z8_count_positive", f"""
  with {_PIX} select basin_code, year, count(case when pred_pumping_mm > 0 then 1 end)
    as n_pred_pumping_mm, count(case when actual_pumping_mm > 0 then 1 end) as n_actual_pumping_mm
  from pix join basin_dim using (basin_code) where year between first_year and last_year
  group by 1, 2""")
def _(v):
    return Z.count_positive(_pixels(v), basins=v.basin_dim)


_BOUND_MEASURES = ["low_mm", "low_m3", "low_AF", "mean_low_mm", "high_mm", "high_m3", "high_AF",
                   "mean_high_mm"]
_BOUNDS = f"""bnd as (select basin_code, year, {_totals_sql('value2 * 0.8e0', 'low')},
    {_totals_sql('value2 * 1.2e0', 'high')} from cell_year join cell_basin using (cell_id)
    join basin_dim using (basin_code) group by 1, 2)"""


def _bounds(v):
    pixels = v.cell_year.join(v.cell_basin.select("cell_id", "basin_code"), "cell_id").select(
        "basin_code", "year", (F.col("value2") * 0.8).alias("low_mm"),
        (F.col("value2") * 1.2).alias("high_mm"))
    return Z.interval_totals(pixels, v.basin_dim)


@query("z9_interval_totals", f"""
  with {_BOUNDS} select basin_code, year,
    {", ".join(f"round({m}, 3) as {m}" for m in _BOUND_MEASURES)} from bnd""")
def _(v):
    return rounded(_bounds(v), 3, *_BOUND_MEASURES)


_COMPILED = f"""select t.basin_code, basin, t.year,
    {", ".join(f"round(nullif({m}, 0), 3) as {m}" for m in _MEASURES)},
    round(mean_low_mm, 5) as mean_low_mm, round(mean_high_mm, 5) as mean_high_mm
  from tot t join basin_dim using (basin_code) join bnd b on b.basin_code = t.basin_code
    and b.year = t.year where b.year >= 1997"""


def _compiled(v, totals, bounds):
    bounds = bounds.select("basin_code", "year", "mean_low_mm", "mean_high_mm")
    out = Z.compile_basins(totals, v.basin_dim, bounds)
    return rounded(rounded(out, 3, *_MEASURES), 5, "mean_low_mm", "mean_high_mm")


@query("z10_compile_basins", f"with {_PIX}, {_TOTALS}, {_BOUNDS} {_COMPILED}")
def _(v):
    return _compiled(v, _totals(v), _bounds(v).filter("year >= 1997"))


@query("z10_compile_basins_all_years",
       f"with {_PIX}, {_TOTALS}, {_BOUNDS} {_COMPILED.removesuffix(' where b.year >= 1997')}")
def _(v):
    return _compiled(v, _totals(v), _bounds(v))


@query("z11_year_window", """
  select cell_id, basin_code, year, value2 from cell_year join cell_basin using (cell_id)
    join basin_dim using (basin_code)
  where year between first_year and last_year and basin_code not in ('NATION_03', 'NATION_09')""")
def _(v):
    cells = v.cell_year.join(v.cell_basin.select("cell_id", "basin_code"), "cell_id").select(
        "cell_id", "basin_code", "year", "value2")
    return Z.cells_in_year_window(cells, v.basin_dim, exclude=["NATION_03", "NATION_09"])


@query("z12_region_values", """
  select basin_code as region, value from cell join cell_basin using (cell_id)
  where value is not null""")
def _(v):
    return Z.region_values(v.cell.select("row", "col", "value"),
                           v.cell_basin.withColumnRenamed("basin_code", "region"))


@query("z13_basin_report", f"""
  with {_PIX}, {_TOTALS}, win as (select basin_code, first_year, last_year, basin from basin_dim)
  select run, basin_code, basin, year, round(nullif(pred_pumping_mm * f, 0), 3) as pred_pumping_mm,
    round(nullif(pred_pumping_AF * f, 0), 3) as pred_pumping_AF,
    round(nullif(actual_pumping_AF, 0), 3) as actual_pumping_AF
  from tot join win using (basin_code), (values ('all', 1e0), ('held_out', 0.5e0)) r(run, f)
  where year between first_year and last_year""")
def _(v):
    from aquagrid.plans.basins import basin_report
    keys = ["row", "col", "year"]
    cy = v.cell_year
    actual = cy.filter("value2 < 150").select(*keys, (F.col("value2") * 3).alias("value"))

    def run(scale):
        capped = F.when(F.col("value2") * 20 <= 2000, F.col("value2") * 20 * scale)
        return cy.filter("value2 > 30").select(*keys, capped.alias("value"))

    report = basin_report({"all": run(1.0), "held_out": run(0.5)}, actual, v.cell_basin, v.basin_dim)
    out = report.select("run", "basin_code", "basin", "year", "pred_pumping_mm",
                        "pred_pumping_AF", "actual_pumping_AF")
    return rounded(out, 3, "pred_pumping_mm", "pred_pumping_AF", "actual_pumping_AF")


_LOSS = """loss as (select coalesce(e.cell_id, a.cell_id) as ID, year, month, et, ppt, Area_m2,
    et - ppt as net_loss_mm, (et - ppt) * Area_m2 / 1000 * 0.0008107132e0 as net_loss_AF
  from (select a.cell_id, a.year, a.month, a.value / 1000 as et, b.value2 as ppt from dense_month a
    join dense_month b using (cell_id, year, month) where a.value > 0) e
  full join (select p_partkey % 50 as cell_id, sum(p_retailprice) as Area_m2 from part group by 1) a
    on e.cell_id = a.cell_id)"""


def _loss(v):
    m = v.dense_month.withColumnRenamed("cell_id", "ID")
    et = m.filter("value > 0").withColumn("et", F.col("value") / 1000)
    areas = v.part.groupBy(F.expr("p_partkey % 50").alias("ID")).agg(
        F.sum("p_retailprice").alias("Area_m2"))
    return B.monthly_loss(et, m.withColumnRenamed("value2", "ppt"), areas)


@query("b1_monthly_loss", f"""
  with {_LOSS} select ID, year, month, round(et, 5) as et, ppt, round(Area_m2, 2) as Area_m2,
    round(net_loss_mm, 5) as net_loss_mm, round(net_loss_AF, 5) as net_loss_AF from loss""")
def _(v):
    return rounded(rounded(_loss(v), 5, "et", "net_loss_mm", "net_loss_AF"), 2, "Area_m2")


@query("b2_annual_loss", f"""
  with {_LOSS} select year, round(coalesce(sum(net_loss_AF), 0), 5) as net_loss_AF from loss
  where year is not null group by 1""")
def _(v):
    return rounded(B.annual_loss(_loss(v)), 5, "net_loss_AF")


_PIVOT = """piv as (select structure_id, year, """ + ", ".join(
    f"coalesce(sum(case when water_class = '{c}' then annual_total end), 0) as {c}"
    for c in "FOP") + " from structure_class group by 1, 2)"


def _pivot(v):
    return B.pivot_classes(v.structure_class, ["structure_id", "year"], ["F", "O", "P"])


@query("b3_pivot_classes", f"""
  with {_PIVOT} select structure_id, year, round(F, 2) as F, round(O, 2) as O, round(P, 2) as P
  from piv""")
def _(v):
    return rounded(_pivot(v), 2, "F", "O", "P")


@query("b3_annual_class_totals", f"""
  with {_PIVOT} select year, round(sum(F), 2) as F, round(sum(O), 2) as O, round(sum(P), 2) as P
  from piv group by 1""")
def _(v):
    return rounded(B.annual_class_totals(_pivot(v), ["F", "O", "P"]), 2, "F", "O", "P")


_PUMP = """pump as (select year, avg(value2) as actual_pumping_mm from cell_year group by 1)"""


def _pump(v):
    return v.cell_year.groupBy("year").agg(F.avg("value2").alias("actual_pumping_mm"))


@query("b4_river_basin_total", f"""
  with {_PIVOT}, {_PUMP}, river as (select year, sum(value) as diversion_AF, sum(value2) as recharge_AF
    from dense_month group by 1), res as (select year, sum(F) as dv, sum(P) as rl from piv group by 1),
  s as (select *, diversion_AF * 0.77e0 - recharge_AF - dv as direct, (rl - 44740.50e0) * 0.77e0 as stored
    from pump join river using (year) join res using (year))
  select year, round(direct, 2) as sw_direct_AF, round(stored, 2) as sw_reservoir_AF,
    round(direct + stored, 2) as sw_total_AF,
    round((direct + stored) * 1233481837547.5e0 / (7189173178.537e0 * 1e6), 4) as sw_total_mm,
    round((direct + stored) * 1233481837547.5e0 / (7189173178.537e0 * 1e6) + actual_pumping_mm, 4)
      as total_irrigation_mm from s""")
def _(v):
    river = v.dense_month.groupBy("year").agg(F.sum("value").alias("diversion_AF"),
                                              F.sum("value2").alias("recharge_AF"))
    res = B.annual_class_totals(_pivot(v), ["F", "O", "P"]).select(
        "year", F.col("F").alias("reservoir_diversion_AF"), F.col("P").alias("reservoir_release_AF"))
    out = B.river_basin_total(_pump(v), river, res, 7189173178.537)
    out = rounded(rounded(out, 2, "sw_direct_AF", "sw_reservoir_AF", "sw_total_AF"), 4,
                  "sw_total_mm", "total_irrigation_mm")
    return out.select("year", "sw_direct_AF", "sw_reservoir_AF", "sw_total_AF", "sw_total_mm",
                      "total_irrigation_mm")


@query("b5_district_total", f"""
  with {_PIVOT}, {_PUMP}, src as (select year, sum(F) as F, sum(O) as O, sum(P) as P from piv group by 1)
  select year, round(F + O + P, 2) as sw_total_AF,
    round((F + O + P) * 1233481837547.5e0 / (10614105343.818e0 * 1e6) * 0.85e0, 4) as sw_delivered_mm,
    round((F + O + P) * 1233481837547.5e0 / (10614105343.818e0 * 1e6) * 0.85e0 + actual_pumping_mm, 4)
      as total_irrigation_mm from pump join src using (year)""")
def _(v):
    src = B.annual_class_totals(_pivot(v), ["F", "O", "P"])
    out = B.district_total(_pump(v), src, ["F", "O", "P"], 10614105343.818)
    out = rounded(rounded(out, 2, "sw_total_AF"), 4, "sw_delivered_mm", "total_irrigation_mm")
    return out.select("year", "sw_total_AF", "sw_delivered_mm", "total_irrigation_mm")
