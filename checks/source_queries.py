"""Sources and sinks: each query writes files of the given tables to the shared folder, reads them
back through the library, and returns what came back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from aquagrid.operators import features as FE
from aquagrid.session import ensure_checkpoint_dir
from aquagrid.sources import rasters as RA, records as RE
from checks.registry import query, rounded

WELLS = "well_id string, year int, af double"


def _folder(v):
    return f"{ensure_checkpoint_dir(v.spark)}/files-{uuid4().hex}"


def _csv(df, path):
    df.write.csv(path, header=True, nullValue="NA")


@query("s1_read_record_files", """
  select well_id, year, case when year % 2 = 0 then af end as af from wells""")
def _(v):
    """Even years hold all columns in another order and one more; odd years lack the amounts."""
    path, wells = _folder(v), v.wells.select("well_id", "year", "af", "right_type")
    _csv(wells.filter("year % 2 = 0").select("af", "right_type", "year", "well_id"), f"{path}/even")
    _csv(wells.filter("year % 2 = 1").select("well_id", "year"), f"{path}/odd")
    return RE.read_record_files(v.spark, f"{path}/*/*.csv", WELLS)


@query("s2_tolerant_read", """
  select well_id, year, af from wells where af > 10""")
def _(v):
    """Some files have a header and no rows, some are empty."""
    path = _folder(v)
    _csv(v.wells.select("year", "well_id", "af").filter("af > 10"), f"{path}/some")
    _csv(v.wells.select("well_id", "af", "year").filter("af < 0").coalesce(1), f"{path}/none")
    v.wells.select("well_id").filter("af < 0").coalesce(1).write.csv(f"{path}/empty")
    return RE.read_record_files(v.spark, f"{path}/*/*.csv", WELLS)


@query("s3_read_summary", """
  select year, n_name as region, case when sum(l_quantity) >= 200 then round(sum(l_quantity), 2) end as af
  from (select cast(year(l_shipdate) as int) as year, l_quantity, n_name from lineitem
    join supplier on s_suppkey = l_suppkey join nation on n_nationkey = s_nationkey) group by 1, 2""")
def _(v):
    """A summary file starts with a byte-order mark and writes NA for missing."""
    rows = (v.lineitem.join(v.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
            .join(v.nation, F.col("n_nationkey") == F.col("s_nationkey"))
            .groupBy(F.year("l_shipdate").alias("year"), F.col("n_name").alias("region"))
            .agg(F.round(F.sum("l_quantity"), 2).alias("af")))
    amount = F.when(F.col("af") >= 200, F.col("af").cast("string")).otherwise(F.lit("NA"))
    lines = rows.select(F.col("year"), F.concat_ws(",", "year", "region", amount).alias("line"))
    head = v.spark.createDataFrame([(0, "﻿year,region,af")], "year int, line string")
    path = _folder(v)
    (head.unionByName(lines).coalesce(1).sortWithinPartitions("year").select("line")    # a row a year and region
     .write.text(path))
    return RE.read_summary(v.spark, f"{path}/*.txt", "year int, region string, af double")


GRID = """NROWS 1
NCOLS 59
NBITS 8
PIXELTYPE UNSIGNEDINT
NODATA 10
"""


@query("s4_read_grids", """
  with c as (select row_i, col_i, 48 + cast(floor(value) as bigint) % 60 as value from cell where value is not null),
  r as (select distinct row_i from cell)
  select r.row_i, cast(k as int) as col_i, cast(c.value as double) as value
  from r cross join range(50) t(k) left join c on c.row_i = r.row_i and c.col_i = k""")
def _(v):
    """Bytes that are text: a line is eight digits of the row number, a byte a cell, and the line
    end, which doubles as the mark of missing cells."""
    cells = v.cell.select("row", "col", "value")
    sign = F.when(F.col("value").isNull(), F.chr(F.lit(10))).otherwise(
        F.chr(48 + F.floor("value").cast("bigint") % 60))
    held = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(
        F.struct(F.col("col"), sign))).alias("m"))                      # at most 50 cells a row
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.coalesce(
        F.col("m")[k], F.lit("\n"))), "")
    path = _folder(v)
    held.select(F.concat(F.lpad(F.col("row").cast("string"), 8, "0"), line)).write.text(path)
    grid = RA.read_bil(v.spark, path, "*.txt", header=GRID).withColumnRenamed("row", "line")
    name = F.col("col") < 8
    digits = grid.filter(name).groupBy("file_name", "line").agg(
        F.sum((F.col("value") - 48) * F.pow(F.lit(10.0), 7 - F.col("col"))).cast("int").alias("row_i"))
    body = grid.filter((F.col("col") >= 8) & (F.col("col") < 58))
    return body.join(digits, ["file_name", "line"]).select(
        "row_i", (F.col("col") - 8).alias("col_i"), "value")


@query("s6_write_layers", """
  select 'disc' as var, year, row_i, col_i, round(disc, 6) as value from cell_year where year between 1994 and 1996
  union all select 'use', year, row_i, col_i, round(value2, 6) from cell_year where year between 1994 and 1996""")
def _(v):
    keys = ["year", "row", "col"]
    layers = v.cell_year.select(F.lit("disc").alias("var"), *keys, F.col("disc").alias("value")).unionByName(
        v.cell_year.select(F.lit("use").alias("var"), *keys, F.col("value2").alias("value"))).unionByName(
        v.cell_year.select(F.lit("price").alias("var"), *keys, "value"))
    path = _folder(v)
    RA.write_layers(layers, path)
    back = RA.read_layers(v.spark, path, ["disc", "use"], (1994, 1996))
    return rounded(back.select("var", "year", F.col("row").alias("row_i"), F.col("col").alias("col_i"), "value"),
                   6, "value")


@query("s7_write_features", """
  select kind, cell_id, year, round(value2, 6) as value2, round(disc, 6) as disc
  from cell_year, (values ('parquet'), ('csv')) k(kind)""")
def _(v):
    path, rows = _folder(v), v.cell_year.select("cell_id", "year", "value2", "disc")
    RA.write_features(rows, f"{path}/parquet", partitions=4)
    RA.write_features(rows, f"{path}/csv", fmt="csv")
    one = v.spark.read.parquet(f"{path}/parquet").withColumn("kind", F.lit("parquet"))
    two = v.spark.read.csv(f"{path}/csv", header=True, schema=rows.schema).withColumn("kind", F.lit("csv"))
    return rounded(one.unionByName(two), 6, "value2", "disc")


@query("s10_statistics_round_trip", """
  select 'disc' as variable, round(avg(disc), 8) as mean, round(stddev_pop(disc), 8) as std from cell_year
  union all select 'value2', round(avg(value2), 8), round(stddev_pop(value2), 8) from cell_year""")
def _(v):
    path = _folder(v)
    RE.write_statistics(FE.scaling_stats(v.cell_year, ["disc", "value2"]), path)
    return rounded(RE.read_statistics(v.spark, path), 8, "mean", "std")
