"""Cells, points and lines on a regular grid."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aquagrid.constants import GridSpec
from aquagrid.functions.numeric import zero_to_null
from aquagrid.operators.joins import shuffled


def col_index(grid: GridSpec, lon):
    return F.floor((F.col(lon) - F.lit(grid.xmin)) / F.lit(grid.res)).cast("int")


def row_index(grid: GridSpec, lat):
    return F.floor((F.lit(grid.ymax) - F.col(lat)) / F.lit(grid.res)).cast("int")


def full_grid(spark, grid: GridSpec):
    """One row per cell of the grid, generated in parallel."""
    return spark.range(grid.nrows * grid.ncols).select(
        F.expr(f"cast(id div {grid.ncols} as int)").alias("row"),
        F.expr(f"cast(id % {grid.ncols} as int)").alias("col"))


def points_to_cells(df, grid: GridSpec, lon="lon", lat="lat"):
    """Row and column of the cell a point falls in; points off the grid, or without
    coordinates, are dropped."""
    placed = df.withColumns({"row": row_index(grid, lat), "col": col_index(grid, lon)})
    return placed.filter(F.col("row").between(0, grid.nrows - 1)
                         & F.col("col").between(0, grid.ncols - 1))


def centre_x(grid: GridSpec, col="col"):
    return F.lit(grid.xmin) + (F.col(col) + 0.5) * F.lit(grid.res)


def centre_y(grid: GridSpec, row="row"):
    return F.lit(grid.ymax) - (F.col(row) + 0.5) * F.lit(grid.res)


def with_centres(df, grid: GridSpec, row="row", col="col"):
    return df.withColumns({"lon": centre_x(grid, col), "lat": centre_y(grid, row)})


def with_boxes(df, grid: GridSpec, row="row", col="col"):
    """Corner coordinates of each cell and a cell id that counts row-major from 1."""
    x0 = F.lit(grid.xmin) + F.col(col) * F.lit(grid.res)
    y1 = F.lit(grid.ymax) - F.col(row) * F.lit(grid.res)
    return df.withColumns({
        "box_id": F.col(row).cast("bigint") * grid.ncols + F.col(col) + 1,
        "x0": x0, "y0": y1 - grid.res, "x1": x0 + grid.res, "y1": y1})


def dense_pixel_id(df, row="row", col="col", out="pixel_id"):
    """1..n over the cells in row-major order. Only the per-row counts (at most one per grid
    row) are prefix-summed in one place; the numbering inside a row runs per row."""
    per_row = df.groupBy(row).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_row.select(row, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = df.withColumn("_pos", F.row_number().over(Window.partitionBy(row).orderBy(col)))
    return (local.join(offsets, row)
            .withColumn(out, F.col("_off") + F.col("_pos")).drop("_off", "_pos"))


def sum_points(df, keys, value, keep_zero=False):
    """Sum of point values per cell; a zero sum reads as missing unless ``keep_zero``."""
    total = F.sum(value)
    return df.groupBy(*keys).agg((total if keep_zero else zero_to_null(total)).alias(value))


def window_assign(df, grid: GridSpec, lon_range, lat_range, value, assigned):
    """Set ``value`` in the cells whose centre lies in the lon/lat rectangle."""
    inside = (centre_x(grid).between(*lon_range)) & (centre_y(grid).between(*lat_range))
    return df.withColumn(value, F.when(inside, F.lit(assigned)).otherwise(F.col(value)))


def fishnet(extent_df, size_x, size_y):
    """Numbered boxes of the given size over each extent (``xmin ymin xmax ymax``), numbered
    from the lower-left corner upwards, then to the right. Cut boxes keep their full size."""
    width = F.greatest(F.ceil((F.col("xmax") - F.col("xmin")) / size_x), F.lit(1))
    height = F.greatest(F.ceil((F.col("ymax") - F.col("ymin")) / size_y), F.lit(1))
    zero = F.lit(0).cast("bigint")
    boxes = (extent_df.withColumns({"_w": width.cast("bigint"), "_h": height.cast("bigint")})
             .withColumn("i", F.explode(F.sequence(zero, F.col("_w") - 1)))
             .withColumn("j", F.explode(F.sequence(zero, F.col("_h") - 1))))
    x0 = F.col("xmin") + F.col("i") * size_x
    y0 = F.col("ymin") + F.col("j") * size_y
    keep = [c for c in extent_df.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    return boxes.select(*keep, (F.col("i") * F.col("_h") + F.col("j") + 1).alias("box_id"),
                        x0.alias("x0"), y0.alias("y0"), (x0 + size_x).alias("x1"),
                        (y0 + size_y).alias("y1"))


def fishnet_by_count(extent_df, nx, ny):
    """As :func:`fishnet` with a fixed number of boxes per side."""
    dx = (F.col("xmax") - F.col("xmin")) / F.lit(float(nx))
    dy = (F.col("ymax") - F.col("ymin")) / F.lit(float(ny))
    keep = [c for c in extent_df.columns if c not in ("xmin", "ymin", "xmax", "ymax")]
    boxes = (extent_df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))))
    x0, y0 = F.col("xmin") + F.col("i") * dx, F.col("ymin") + F.col("j") * dy
    return boxes.select(*keep, (F.col("i") * ny + F.col("j") + 1).alias("box_id"),
                        x0.alias("x0"), y0.alias("y0"), (x0 + dx).alias("x1"),
                        (y0 + dy).alias("y1"))


def cells_on_lines(segments, grid: GridSpec, key="line_id", pad=0.0, clip=True):
    """Every cell a segment passes through, once per line.

    A segment (x1 y1 x2 y2) is expanded along the rows it spans; in each row it covers one
    run of columns, so the work is the number of touched cells, not the bounding box.
    ``pad`` (in cells) widens the run on both sides to make the cover conservative.
    """
    u = {c: (F.col(c) - F.lit(grid.xmin)) / F.lit(grid.res) for c in ("x1", "x2")}
    v = {c: (F.lit(grid.ymax) - F.col(c)) / F.lit(grid.res) for c in ("y1", "y2")}
    seg = segments.select(key, u["x1"].alias("u1"), u["x2"].alias("u2"),
                          v["y1"].alias("v1"), v["y2"].alias("v2"))
    top = F.floor(F.least("v1", "v2") - pad)
    bottom = F.floor(F.greatest("v1", "v2") + pad)
    if clip:
        top, bottom = F.greatest(top, F.lit(0)), F.least(bottom, F.lit(grid.nrows - 1))
    rows = seg.withColumns({"_a": top.cast("int"), "_b": bottom.cast("int")}).filter(
        "_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
    slope = (F.col("u2") - F.col("u1")) / F.nullif(F.col("v2") - F.col("v1"), F.lit(0.0))

    def at(edge):
        # where the segment meets a row edge, held inside the segment's own span
        lo, hi = F.least("v1", "v2"), F.greatest("v1", "v2")
        level = F.least(F.greatest(edge, lo), hi)
        return F.col("u1") + (level - F.col("v1")) * slope

    first, second = at(F.col("row").cast("double")), at(F.col("row") + 1.0)
    left = F.coalesce(F.least(first, second), F.least("u1", "u2"))
    right = F.coalesce(F.greatest(first, second), F.greatest("u1", "u2"))
    a, b = F.floor(left - pad), F.floor(right + pad)
    if clip:
        a, b = F.greatest(a, F.lit(0)), F.least(b, F.lit(grid.ncols - 1))
    runs = rows.select(key, "row", a.cast("int").alias("_c0"), b.cast("int").alias("_c1"))
    return shuffled(runs.filter("_c0 <= _c1").select(
        key, "row", F.explode(F.sequence("_c0", "_c1")).alias("col")).distinct())
