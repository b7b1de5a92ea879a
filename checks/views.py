"""Stand-ins for the domain tables, derived from the test tables.

Each view is SQL that both engines run unchanged, except ``edges``, whose row generator
differs by name. ``Views`` hands them out as DataFrames; ``with_views`` puts the same text
in front of an oracle query.
"""

from __future__ import annotations

import re

VIEWS = {
    "wells": """select l_orderkey, l_linenumber, cast(10000 + l_suppkey as string) as well_id,
      cast(year(l_shipdate) as int) as year, l_returnflag as right_type,
      l_linestatus as water_type, l_quantity as af from lineitem""",
    "well_registry": """select concat('0', cast(10000 + s_suppkey as string)) as well_id,
      -120 + (s_suppkey % 20) * 0.5e0 + 0.01e0 as lon,
      45 - floor(s_suppkey / 20e0) * 0.2e0 - 0.01e0 as lat, s_suppkey as load_order,
      s_nationkey as basin_id from supplier where s_suppkey % 17 <> 0""",
    "cell": """select cast(floor(p_partkey / 50e0) as int) as row_i,
      cast(p_partkey % 50 as int) as col_i, p_partkey as cell_id, p_size as zone,
      case when p_size % 10 = 0 then null else p_retailprice end as value from part""",
    "cell_year": """select l_partkey as cell_id, cast(floor(l_partkey / 50e0) as int) as row_i,
      cast(l_partkey % 50 as int) as col_i, cast(year(l_shipdate) as int) as year,
      sum(l_extendedprice) as value, sum(l_quantity) as value2, avg(l_discount) as disc
      from lineitem group by 1, 2, 3, 4""",
    "dense_month": """select cast(l_partkey % 40 as int) as cell_id,
      cast(year(l_shipdate) as int) as year, cast(month(l_shipdate) as int) as month,
      sum(l_extendedprice) as value, sum(l_quantity) as value2
      from lineitem group by 1, 2, 3""",
    "season": """select cast(id as int) as cell_id,
      case when id % 13 = 0 then null else cast(3 + id % 3 as int) end as start_month,
      case when id % 11 = 0 then 1 else cast(8 + id % 4 as int) end as end_month
      from (select distinct l_partkey % 40 as id from lineitem) t""",
    "basin_dim": """select n_nationkey as basin_id, n_name as basin_code,
      concat(n_name, ' basin') as basin, 1e9 * (n_nationkey + 1) as area_m2,
      1995 + n_nationkey % 3 as first_year, 2001 - n_nationkey % 2 as last_year
      from nation""",
    "cell_basin": """select p_partkey as cell_id, cast(floor(p_partkey / 50e0) as int) as row_i,
      cast(p_partkey % 50 as int) as col_i, n_name as basin_code
      from part join nation on p_partkey % 25 = n_nationkey""",
    "pred_actual": """select l_orderkey * 8 + l_linenumber as id, l_returnflag as grp,
      cast(year(l_shipdate) as int) as year, l_extendedprice as actual,
      l_quantity * 1500e0 as predicted from lineitem""",
    "balances": """select c_custkey as id, c_mktsegment as grp, c_acctbal as value
      from customer""",
    "daily_obs": """select event_id, event_type as var, user_id as cell_id, ts, value
      from events""",
    "members": """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
      cast(year(l_shipdate) as int) as year, l_quantity as af,
      case l_linenumber % 3 when 0 then cast(l_partkey as string)
      when 1 then concat(cast(l_partkey as string), '_', cast(l_suppkey as string))
      else concat(cast(l_partkey as string), '_', cast(l_suppkey as string), '_x') end
      as all_app from lineitem""",
    "wide_use": """select o_custkey % 100 as site,
      sum(case when year(o_orderdate)=1995 then o_totalprice end) as AF_USED_1995,
      sum(case when year(o_orderdate)=1996 then o_totalprice end) as AF_USED_1996,
      sum(case when year(o_orderdate)=1997 then o_totalprice end) as AF_USED_1997,
      count(case when year(o_orderdate)=1995 then 1 end) * 1e0 as ACRES_1995,
      count(case when year(o_orderdate)=1997 then 1 end) * 1e0 as ACRES_1997
      from orders group by 1""",
    "structure_class": """select o_custkey % 50 as structure_id,
      cast(year(o_orderdate) as int) as year, o_orderstatus as water_class,
      sum(o_totalprice) as annual_total from orders group by 1, 2, 3""",
    "segments": """select c_custkey as line_id, (c_custkey * 13 % 47) + 0.137e0 as x1,
      -(c_custkey * 29 % 37) - 0.211e0 as y1,
      (c_custkey * 13 % 47) + 0.137e0 + (c_custkey % 7) * 0.83e0 - 2.1e0 as x2,
      -(c_custkey * 29 % 37) - 0.211e0 + (c_custkey % 5) * 0.71e0 - 1.3e0 as y2
      from customer""",
    "survey_points": """select o_orderkey as point_id, (o_custkey * 17 % 4999) / 100e0 as lon,
      -(o_orderkey * 31 % 4397) / 100e0 as lat from orders""",
}

# Corners of the test polygon: concave, with two level edges.
CORNERS = [(0.0, 0.0), (4.0, 0.0), (4.5, 1.3), (1.7, 1.3), (2.2, 3.6), (-0.6, 3.1)]


def _edge_sql(fields):
    rows = []
    for (ax, ay), (bx, by) in zip(CORNERS, CORNERS[1:] + CORNERS[:1]):
        values = [f"cx + ({ax}e0) * s", f"cy + ({ay}e0) * s",
                  f"cx + ({bx}e0) * s", f"cy + ({by}e0) * s"]
        rows.append(fields(values))
    return ", ".join(rows)


_EDGE_BASE = """(select s_suppkey as poly_id, cast(s_suppkey * 7 % 43 as double) + 0.21e0 as cx,
  -0.4e0 * s_suppkey - 4.13e0 as cy, 1e0 + (s_suppkey % 3) * 0.5e0 as s from supplier) b"""
_NAMES = ("x1", "y1", "x2", "y2")
EDGES_SPARK = (
    "select poly_id, inline(array(" + _edge_sql(
        lambda v: "struct(" + ", ".join(f"{e} as {n}" for e, n in zip(v, _NAMES)) + ")")
    + ")) from " + _EDGE_BASE)
EDGES_DUCKDB = (
    "select poly_id, unnest([" + _edge_sql(
        lambda v: "{" + ", ".join(f"{n}: {e}" for e, n in zip(v, _NAMES)) + "}")
    + "], recursive := true) from " + _EDGE_BASE)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


class Views:
    """``v.cell`` and so on as DataFrames over one data folder. Grid columns come back as
    ``row`` and ``col``."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def table(self, name):
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name):
        if name in TABLES:
            return self.table(name)
        text = EDGES_SPARK if name == "edges" else VIEWS[name]
        used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]
        filled = text
        for t in used:
            filled = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", filled)
        df = self.spark.sql(filled, **{t: self.table(t) for t in used})
        return df.withColumnsRenamed({"row_i": "row", "col_i": "col"})


def with_views(sql):
    """The oracle text with the views it mentions in front."""
    found = [v for v in [*VIEWS, "edges"] if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} as ({EDGES_DUCKDB if v == 'edges' else VIEWS[v]})" for v in found]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts + [body[5:]])
    return ("with " + ", ".join(parts) + " " if parts else "") + body
