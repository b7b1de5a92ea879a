"""Whole jobs end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.plans import predictors as PR, pumping as PU
from aquagrid.sources import records as SR, vectors as SV
from checks.records_queries import well_grid
from checks.registry import query, rounded
from checks.views import CORNERS

@query("s5_file_dates", """
  select l_orderkey, l_linenumber, l_partkey, cast(year(l_shipdate) as int) as year,
    case when l_linenumber > 2 then cast(month(l_shipdate) as int) end as month from lineitem""")
def _(v):
    stem = F.concat(F.lit("ET_"), F.year("l_shipdate"))
    joined = F.concat(F.lit("ppt_"), F.date_format("l_shipdate", "yyyyMM"), F.lit("_bil.bil"))
    name = F.when(F.col("l_linenumber") > 4, joined).when(F.col("l_linenumber") > 2, F.concat(stem, F.lit("_"), F.month("l_shipdate"),
                                                      F.lit(".tif"))).otherwise(
        F.concat(stem, F.lit(".tif")))
    return SR.with_file_dates(v.lineitem.withColumn("file_name", name)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "year", "month")


def _corner_text(v):
    """Each supplier's polygon as GeoJSON coordinates, its ring left open."""
    ring = F.array(*[F.array(F.expr(f"cx + ({x}D) * s"), F.expr(f"cy + ({y}D) * s"))
                     for x, y in CORNERS])
    base = v.supplier.selectExpr(
        "s_suppkey as poly_id", "cast(s_suppkey * 7 % 43 as double) + 0.21D as cx",
        "-0.4D * s_suppkey - 4.13D as cy", "1D + (s_suppkey % 3) * 0.5D as s")
    return base.select("poly_id", F.lit("Polygon").alias("kind"),
                       F.to_json(F.array(ring)).alias("coordinates"))


@query("s9_polygon_edges", """
  select poly_id, round(x1, 9) as x1, round(y1, 9) as y1, round(x2, 9) as x2, round(y2, 9) as y2
  from edges""")
def _(v):
    edges = SV.polygon_edges(_corner_text(v), "poly_id").select("poly_id", "x1", "y1", "x2", "y2")
    return rounded(edges, 9, "x1", "y1", "x2", "y2")


_CELLS = """cells as (select w.year, cast(floor(45 - lat) as int) as r, cast(floor(lon + 120) as int) as c,
    nullif(sum(af), 0) as af from wells w join well_registry g on g.well_id = '0' || w.well_id
  where right_type in ('A', 'N') and water_type = 'F' and floor(45 - lat) >= 0
    and floor(lon + 120) between 0 and 9 group by 1, 2, 3)"""
_MM = "af * 1233481837548e0 / ((2199.59e0 * 1000) * (1746.53e0 * 1000))"


def _cell_basin(v, grid):
    """Grid cells to basins: every cell of the well grid belongs to one."""
    return v.spark.range(grid.nrows * grid.ncols).select(
        F.expr(f"cast(id div {grid.ncols} as int)").alias("row"),
        F.expr(f"cast(id % {grid.ncols} as int)").alias("col"),
        F.expr("cast(id % 25 as int)").alias("n_nationkey")).join(
        v.nation.withColumnRenamed("n_name", "basin_code"), "n_nationkey").select(
        "row", "col", "basin_code")


def basin_pumping(v):
    grid = well_grid(v)
    out = PU.basin_pumping(v.wells, v.well_registry.drop("basin_id"), v.basin_dim, grid,
                           _cell_basin(v, grid), ["A", "N"], "F")
    return rounded(out, 4, "pumping_mm", "pumping_m3", "pumping_AF", "mean_pumping_mm")


@query("entry_basin_pumping", f"""
  with {_CELLS}, t as (select n_name as basin_code, year, coalesce(sum({_MM}), 0) as mm from cells
    join nation on n_nationkey = (r * 10 + c) % 25 group by 1, 2),
  x as (select *, mm * ((2199.59e0 * 1000) * (1746.53e0 * 1000)) / 1e9 as m3 from t)
  select basin_code, year, round(mm, 4) as pumping_mm, round(m3, 4) as pumping_m3,
    round(m3 / 1233.48e0, 4) as pumping_AF,
    round(m3 / 1233.48e0 * 1233481837547.5e0 / (area_m2 * 1e6), 4) as mean_pumping_mm
  from x join basin_dim using (basin_code)""")
def _(v):
    return basin_pumping(v)


@query("job_gridded_pumping", f"""
  with {_CELLS} select year, r as "row", c as col, af, round({_MM}, 6) as mm from cells""")
def _(v):
    cells = PU.gridded_pumping(v.wells, v.well_registry.drop("basin_id"), well_grid(v), ["A", "N"], "F")
    return rounded(cells, 6, "mm")


@query("job_training_layer", """
  with f as (select y.cell_id, y.row_i, y.col_i, y.year, y.cell_id % 4 as r, case when
      (c.value + y.value2 * 1000) > 0 and (c.value + y.value2 * 1000) / y.value between 0.5e0 and 0.9e0
      then nullif(y.value2 * 1000, 0) end as v from cell_year y join cell c using (cell_id))
  select year, row_i as "row", col_i as col, v as value from f
  where v > 0 and not exists (select 1 from cell k where k.zone > 45 and k.row_i = f.row_i
    and k.col_i = f.col_i)""")
def _(v):
    keys = ["year", "row", "col"]
    cy = v.cell_year
    regions = {n: cy.filter(F.col("cell_id") % 4 == i).select(*keys, (F.col("value2") * 1000).alias("value"))
               for i, n in enumerate(("NV", "AZ", "CO", "KS"))}
    peff = cy.select(*keys, "cell_id").join(v.cell.select("cell_id", "value"), "cell_id").select(*keys, "value")
    return PU.training_layer(regions, peff, cy.select(*keys, "value"), 0.5, 0.9,
                             exclude=v.cell.filter("zone > 45"))


@query("job_training_layer_by_region", """
  with j as (select y.row_i, y.col_i, y.year, y.cell_id % 4 as r, y.value2 * 40 as pump,
      y.value / 20e0 as et, y.value2 * 2 as sw, c.value as peff
    from cell_year y join cell c using (cell_id)),
  f as (select *, peff + pump + case when r = 2 and year < 2020 then sw else 0 end as water from j)
  select year, row_i as "row", col_i as col, pump as value from f
  where pump > 0 and case r when 0 then true when 1 then pump between 0 and 1500
      else water > 0 and et > 1e-6 and water / et between 0.7e0 and 1.5e0 end
    and not exists (select 1 from cell k where k.zone > 45 and k.row_i = f.row_i
      and k.col_i = f.col_i)""")
def _(v):
    keys = ["year", "row", "col"]
    cy = v.cell_year
    regions = {n: cy.filter(F.col("cell_id") % 4 == i).select(*keys, (F.col("value2") * 40).alias("value"))
               for i, n in enumerate(("NV", "AZ", "CO", "KS"))}
    peff = cy.select(*keys, "cell_id").join(v.cell.select("cell_id", "value"), "cell_id").select(*keys, "value")
    et, sw = (cy.select(*keys, c.alias("value")) for c in (F.col("value") / 20, F.col("value2") * 2))
    return PU.training_layer(regions, peff, et, surface=sw, exclude=v.cell.filter("zone > 45"),
                             rules=PU.REGION_RULES)


@query("job_season_predictors", """
  with g as (select m.cell_id, m.year, coalesce(sum(case when month between start_month and end_month
      then value2 end), 0) as total, count(value2) as n, coalesce(greatest(any_value(end_month)
      - any_value(start_month) + 1, 0), 0) as len,
      any_value(start_month) is null or any_value(end_month) is null as none
    from dense_month m left join season s using (cell_id) group by 1, 2)
  select 'qty' as var, cell_id, year, case when n = 12 then total end as value from g
  union all select 'tmax', cell_id, year, round(case when n = 12 and not none then total / nullif(len, 0)
    end, 6) from g""")
def _(v):
    m = v.dense_month.select("cell_id", "year", "month", F.col("value2").alias("value"))
    both = m.withColumn("var", F.explode(F.array(F.lit("qty"), F.lit("tmax"))))
    return rounded(PR.season_predictors(both, v.season, ["qty"], ["tmax"], ["cell_id"]), 6, "value")
