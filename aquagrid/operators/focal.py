"""Neighbourhood and resolution operators."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from aquagrid.constants import GridSpec
from aquagrid.functions.numeric import ratio
from aquagrid.operators.grid import centre_x, centre_y, full_grid, points_to_cells
from aquagrid.operators.joins import hot_join
from aquagrid.operators.polygons import clip_cells


def resample_nearest(source, src: GridSpec, target, dst: GridSpec, value="value"):
    """Source value at each target cell centre; target cells off the source are missing."""
    looked_up = target.withColumns({
        "_sr": F.floor((F.lit(src.ymax) - centre_y(dst)) / F.lit(src.res)).cast("int"),
        "_sc": F.floor((centre_x(dst) - F.lit(src.xmin)) / F.lit(src.res)).cast("int")})
    side = source.select(F.col("row").alias("_sr"), F.col("col").alias("_sc"), value)
    return looked_up.join(side, ["_sr", "_sc"], "left").drop("_sr", "_sc")


def coarse_index(factor, row="row", col="col"):
    return {"coarse_row": F.floor(F.col(row) / factor).cast("int"),
            "coarse_col": F.floor(F.col(col) / factor).cast("int")}


def resample_aggregate(df, factor, how="average", by=(), value="value"):
    """Fine to coarse by an integer factor: average, mode (smallest on a tie), max or min."""
    fine = df.filter(F.col(value).isNotNull()).withColumns(coarse_index(factor))
    keys = [*by, "coarse_row", "coarse_col"]
    if how == "mode":
        counts = fine.groupBy(*keys, value).agg(F.count("*").alias("_n"))
        smallest = counts.repartition(*keys).groupBy(*keys, "_n").agg(F.min(value).alias(value))
        return smallest.groupBy(*keys).agg(F.max_by(value, "_n").alias(value))
    pick = {"average": F.avg, "max": F.max, "min": F.min}[how](value)
    return fine.groupBy(*keys).agg(pick.alias(value))


def resample_bilinear(source, src: GridSpec, target, dst: GridSpec, value="value"):
    """Weights of the four source centres around each target centre; missing neighbours are
    left out and the rest re-weighted."""
    u = (centre_x(dst) - F.lit(src.xmin)) / F.lit(src.res) - 0.5
    v = (F.lit(src.ymax) - centre_y(dst)) / F.lit(src.res) - 0.5
    at = target.withColumns({"_u": u, "_v": v, "_c": F.floor(u), "_r": F.floor(v)})
    offsets = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj"))
                        for i in (0, 1) for j in (0, 1)])
    spread = at.withColumn("_o", F.explode(offsets)).select(
        *target.columns, (F.col("_r") + F.col("_o.di")).cast("int").alias("_sr"),
        (F.col("_c") + F.col("_o.dj")).cast("int").alias("_sc"),
        ((1 - F.abs(F.col("_v") - F.col("_r") - F.col("_o.di")))
         * (1 - F.abs(F.col("_u") - F.col("_c") - F.col("_o.dj")))).alias("_w"))
    side = source.filter(F.col(value).isNotNull()).select(
        F.col("row").alias("_sr"), F.col("col").alias("_sc"), F.col(value).alias("_x"))
    met = spread.join(side, ["_sr", "_sc"], "left")
    weight = F.sum(F.when(F.col("_x").isNotNull(), F.col("_w")))
    return met.groupBy(*target.columns).agg(
        ratio(F.sum(F.col("_w") * F.col("_x")), weight).alias(value))


def clip_and_resample(source, src: GridSpec, edges, target, dst: GridSpec, value="value"):
    """Clip the source to the polygons, then take the nearest value on the target cells."""
    inside = clip_cells(source, edges, src).select("row", "col", value).distinct()
    return resample_nearest(inside, src, target, dst, value)


def flagged_fraction(df, flag, factor, by=()):
    """Share of flagged fine cells in each coarse cell; a missing flag counts as not set."""
    fine = df.withColumns(coarse_index(factor))
    return fine.groupBy(*by, "coarse_row", "coarse_col").agg(
        (F.count_if(flag) / F.count("*")).alias("fraction"))


def merge_presence(a, b, keys, value="value"):
    """A cell is present where either layer has it; the larger value is kept."""
    return a.select(*keys, value).unionByName(b.select(*keys, value)).groupBy(*keys).agg(
        F.max(value).alias(value))


def kernel_weights(sigma, size=None):
    """Weights of an odd-sized, unit-sum Gaussian kernel of side int(3 sigma)."""
    size = int(3 * sigma) if size is None else size
    if size % 2 == 0:
        raise ValueError("the kernel side must be odd")
    half = size // 2
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-half, half + 1)]
    return half, [w / sum(raw) for w in raw]


def _sweep(rows, line, axis, fields, half, weights, by=()):
    """One kernel pass along ``axis`` of every layer; a window frame holds at most as many
    cells as the kernel."""
    table = F.array(*[F.lit(w) for w in weights])
    frame = Window.partitionBy(*by, line).orderBy(axis).rangeBetween(-half, half)
    near = F.collect_list(F.struct(axis, *fields)).over(frame)

    def weighted(field):
        return F.aggregate("_near", F.lit(0.0), lambda acc, e: acc + e[field] * F.get(
            table, (e[axis] - F.col(axis) + half).cast("int")))

    return rows.withColumn("_near", near).select(
        *by, "row", "col", "_cell", *[weighted(f).alias(f) for f in fields])


def _on_full_grid(df, grid, value, by=()):
    """Every grid cell of every layer, with the given cell (if any) carried along."""
    given = df.select(*by, "row", "col", value, F.lit(True).alias("_given"))
    if by:      # layers times grid rows are dealt out before the columns are laid
        rows = df.select(*by).distinct().withColumn(
            "row", F.explode(F.sequence(F.lit(0), F.lit(grid.nrows - 1))))
        cells = rows.repartition(*by, "row").withColumn(
            "col", F.explode(F.sequence(F.lit(0), F.lit(grid.ncols - 1))))
    else:
        cells = full_grid(df.sparkSession, grid)
    return cells.join(given, [*by, "row", "col"], "left").select(
        *by, "row", "col", F.struct(value, "_given").alias("_cell"))


def gaussian_smooth(df, grid: GridSpec, sigma=1.0, value="value", normalise=False, by=()):
    """Gaussian smoothing that ignores missing cells and keeps missing centres missing.

    Off-grid neighbours count as 0 with their weight; missing cells on the grid are left out
    of numerator and denominator. The kernel is separable, so it runs as two one-dimensional
    passes (along rows, then along columns): 2k work per cell instead of k*k. ``by`` (never
    missing) tells the layers apart, such as variable and year; each is smoothed on its own.
    """
    half, weights = kernel_weights(sigma)
    # the second pass reads sums at cells that may hold no value themselves, so the sweep
    # runs over the whole grid with missing cells at weight 0
    held = F.col(f"_cell.{value}")
    start = _on_full_grid(df, grid, value, by).withColumns({
        "_num": F.coalesce(held, F.lit(0.0)),
        "_gap": F.when(held.isNull(), 1.0).otherwise(0.0)})
    along = _sweep(start, "row", "col", ["_num", "_gap"], half, weights, by)
    both = _sweep(along, "col", "row", ["_num", "_gap"], half, weights, by).filter(
        "_cell._given")
    smooth = F.when(held.isNotNull(), ratio("_num", 1.0 - F.col("_gap")))
    out = both.select(*by, "row", "col", smooth.alias(value))
    return scale_to_unit(out, value, by) if normalise else out


def _mirrored(rows, axis, size, half):
    """Copies of the cells near a border at their mirror positions beyond it."""
    turns = range(-(half // (2 * size) + 1), half // (2 * size) + 2)
    places = F.array(*[F.col(axis) + 2 * size * k for k in turns],
                     *[-1 - F.col(axis) + 2 * size * k for k in turns])
    kept = F.filter(places, lambda q: (q >= -half) & (q < size + half))
    return rows.withColumn(axis, F.explode(kept))


def gaussian_smooth_filled(df, grid: GridSpec, sigma=1.0, value="value", normalise=False,
                           by=()):
    """Plain Gaussian smoothing: missing cells count as 0, the grid is mirrored at its
    borders and the kernel reaches four standard deviations. Returns the whole grid of each
    layer (``by``)."""
    half, weights = kernel_weights(sigma, 2 * int(4 * sigma + 0.5) + 1)
    rows = _on_full_grid(df, grid, value, by).withColumn(
        "_num", F.coalesce(F.col(f"_cell.{value}"), F.lit(0.0)))
    along = _sweep(_mirrored(rows, "col", grid.ncols, half), "row", "col", ["_num"], half,
                   weights, by).filter(F.col("col").between(0, grid.ncols - 1))
    both = _sweep(_mirrored(along, "row", grid.nrows, half), "col", "row", ["_num"], half,
                  weights, by).filter(F.col("row").between(0, grid.nrows - 1))
    out = both.select(*by, "row", "col", F.col("_num").alias(value))
    return scale_to_unit(out, value, by) if normalise else out


def scale_to_unit(df, value="value", by=()):
    """Absolute values on a 0..1 scale over each whole layer; missing counts as 0."""
    filled = df.withColumn(value, F.abs(F.coalesce(F.col(value), F.lit(0.0))))
    if by:      # a layer is a hot key: many cells, one row of bounds
        ends = filled.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
        met = hot_join(filled, ends, list(by))
        low, high = F.col("_low"), F.col("_high")
    else:
        met = filled
        low, high = filled.agg(F.min(value)).scalar(), filled.agg(F.max(value)).scalar()
    return met.select(*by, "row", "col", ratio(F.col(value) - low, high - low).alias(value))


def _lower_envelope(column):
    """Squared distances down one grid column, from the squared in-row distances.

    One sweep keeps the parabolas that form the lower envelope, a second reads them off.
    """
    rows = column["row"].to_numpy(dtype=np.float64)
    near = column["near"].to_numpy(dtype=np.float64)
    order = np.argsort(rows)
    rows, near = rows[order], near[order]
    sites = np.flatnonzero(np.isfinite(near))
    out = np.full(len(rows), np.nan)
    if len(sites):
        lift = near ** 2 + rows ** 2
        hull, start = [], []
        for i in sites:
            while hull:
                j = hull[-1]
                meet = (lift[i] - lift[j]) / (2 * (rows[i] - rows[j]))
                if meet > start[-1]:
                    break
                hull.pop()
                start.pop()
            start.append(meet if hull else -np.inf)
            hull.append(i)
        owner = np.array(hull)[np.searchsorted(np.array(start), rows, side="left") - 1]
        out = (rows - rows[owner]) ** 2 + near[owner] ** 2
    return pd.DataFrame({"row": rows.astype("int32"), "col": column["col"].to_numpy()[order],
                         "d2": out})


def distance_to_target(df, target, grid: GridSpec, out="distance", by=()):
    """Exact Euclidean distance from each cell to the nearest target cell of its layer
    (``by``), in grid units.

    Separable: the nearest target within the row by two window frames, then the minimum over
    rows per column by a lower envelope. Groups are single grid rows and columns, bounded by
    the grid's sides, and no cell pairs are formed. Cells without any target are missing.
    """
    forward = Window.partitionBy(*by, "row").orderBy("col")
    target = F.expr(target) if isinstance(target, str) else target
    mark = F.when(target, F.col("col"))
    before = F.last(mark, ignorenulls=True).over(
        forward.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, ignorenulls=True).over(
        forward.rowsBetween(0, Window.unboundedFollowing))
    near = F.least(F.col("col") - before, after - F.col("col")).cast("double")
    in_row = df.select(*by, "row", F.col("col").cast("int").alias("col"), near.alias("near"))

    def envelope(column):
        found = _lower_envelope(column)
        for name in reversed(by):
            found.insert(0, name, column[name].iloc[0])
        return found

    layer = "".join(f"`{name}` {in_row.schema[name].dataType.simpleString()}, " for name in by)
    d2 = in_row.groupBy(*by, "col").applyInPandas(envelope, f"{layer}row int, col int, d2 double")
    cleaned = F.when(~F.isnan("d2"), F.sqrt("d2") * F.lit(grid.res))
    return d2.select(*by, "row", "col", cleaned.alias(out))


def sample_at_points(points, layers, grid: GridSpec, lon="lon", lat="lat"):
    """Every dated layer value at each point's cell; a cell may hold very many points."""
    return hot_join(points_to_cells(points, grid, lon, lat), layers, ["row", "col"])
