"""Polygon operators on edge tables ``(poly_id, x1, y1, x2, y2)``.

Rings may come in any order and orientation; holes work because insideness is the parity of
edge crossings. The crossing rule is half-open, so a point on a border shared by two
polygons belongs to exactly one of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from aquagrid.constants import GridSpec
from aquagrid.operators.grid import cells_on_lines, centre_x, centre_y
from aquagrid.operators.joins import hot_join, shuffled


def cells_in_polygons(edges, grid: GridSpec, key="poly_id"):
    """Cells whose centre is inside each polygon: ``(poly_id, row, col)``.

    Scan-line fill. Each edge is met with the row centres it spans, the crossings of one
    polygon and row are sorted and paired, and each pair gives a run of columns. The cost is
    edges x rows spanned plus the cells returned; no cell is ever joined to an edge.
    """
    sloped = edges.filter(F.col("y1") != F.col("y2"))  # a level edge crosses no scan line
    depth = {c: (F.lit(grid.ymax) - F.col(c)) / F.lit(grid.res) - 0.5 for c in ("y1", "y2")}
    # one row of slack either side; the exact rule is the filter below
    first = F.greatest(F.floor(F.least(depth["y1"], depth["y2"])) - 1, F.lit(0))
    last = F.least(F.ceil(F.greatest(depth["y1"], depth["y2"])) + 1, F.lit(grid.nrows - 1))
    met = (sloped.withColumns({"_a": first.cast("int"), "_b": last.cast("int")})
           .filter("_a <= _b").withColumn("row", F.explode(F.sequence("_a", "_b")))
           .withColumn("_y", centre_y(grid))
           .filter((F.col("y1") > F.col("_y")) != (F.col("y2") > F.col("_y"))))
    x = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (
        F.col("y2") - F.col("y1")) + F.col("x1")
    crossings = met.select(key, "row", x.alias("_x"))
    line = Window.partitionBy(key, "row").orderBy("_x")
    pairs = (crossings.withColumns({"_i": F.row_number().over(line),
                                    "_next": F.lead("_x").over(line)})
             .filter("_i % 2 = 1 and _next is not null"))
    lo = F.floor((F.col("_x") - F.lit(grid.xmin)) / F.lit(grid.res) - 0.5)
    hi = F.ceil((F.col("_next") - F.lit(grid.xmin)) / F.lit(grid.res) - 0.5)
    runs = pairs.withColumns({"_c0": F.greatest(lo, F.lit(0)).cast("int"),
                              "_c1": F.least(hi, F.lit(grid.ncols - 1)).cast("int")})
    return shuffled(runs.filter("_c0 <= _c1")
                    .withColumn("col", F.explode(F.sequence("_c0", "_c1")))
                    .withColumn("_cx", centre_x(grid))
                    .filter("_cx >= _x and _cx < _next").select(key, "row", "col"))


def clip_cells(cells, edges, grid: GridSpec, key="poly_id"):
    """Cell rows inside a polygon, once per polygon they are in."""
    return cells.join(cells_in_polygons(edges, grid, key), ["row", "col"])


def erase_cells(cells, edges, grid: GridSpec, key="poly_id"):
    """Cell rows outside every polygon."""
    covered = cells_in_polygons(edges, grid, key).select("row", "col").distinct()
    return cells.join(covered, ["row", "col"], "left_anti")


def burn_attribute(edges, attributes, grid: GridSpec, attribute, priority, key="poly_id"):
    """Attribute of the polygon covering each cell; the highest (priority, id) wins."""
    covered = hot_join(cells_in_polygons(edges, grid, key), attributes, [key], expanded=True)
    # two aggregates on one shuffle by cell; they stay hash-based for numeric attributes
    ranked = covered.repartition("row", "col").groupBy("row", "col", priority).agg(
        F.max_by(attribute, key).alias(attribute))
    return ranked.groupBy("row", "col").agg(F.max_by(attribute, priority).alias(attribute))


def burn_constant(cells, edges, grid: GridSpec, burn=1, fill=0, out="value", key="poly_id"):
    """``burn`` in cells covered by any polygon, ``fill`` elsewhere."""
    covered = (cells_in_polygons(edges, grid, key).select("row", "col").distinct()
               .withColumn("_hit", F.lit(True)))
    return (cells.join(covered, ["row", "col"], "left")
            .withColumn(out, F.when(F.col("_hit"), F.lit(burn)).otherwise(F.lit(fill)))
            .drop("_hit"))


def dissolve_cells(edges, groups, grid: GridSpec, group="group_id", key="poly_id"):
    """Cells of a group of polygons; a cell in several members counts once."""
    inside = hot_join(cells_in_polygons(edges, grid, key), groups, [key], expanded=True)
    return inside.select(group, "row", "col").distinct()


def tile_index(edges, tiles: GridSpec, key="poly_id"):
    """``(poly_id, row, col, x1, y1, x2, y2, inside)``: per tile and polygon the edges that touch
    the tile, each with one bit that says whether the tile's mark is inside the polygon. A tile
    no edge touches has one row without an edge if it is inside and none if it is outside.

    The rows grow with the length of the edges in tiles and the area covered. An edge that
    occurs twice cancels itself, as it does in the parity of crossings.
    """
    once = (edges.groupBy(key, "x1", "y1", "x2", "y2").agg(F.count("*").alias("_n"))
            .filter("_n % 2 = 1").withColumn("_edge", F.struct(key, "x1", "y1", "x2", "y2")))
    touched = cells_on_lines(once, tiles, "_edge", pad=1e-9).select("row", "col", "_edge.*")
    inside = cells_in_polygons(edges, _mark_grid(tiles), key).withColumn("inside", F.lit(1))
    return (touched.join(inside, [key, "row", "col"], "full")
            .withColumn("inside", F.coalesce("inside", F.lit(0))))


def _mark_grid(tiles):
    """The grid whose cell centres are the marks of the tiles: off the tile centres, so that
    vertices at round coordinates do not lie level with a mark."""
    lean = (math.sqrt(0.5) - 0.5) * tiles.res / 2
    return GridSpec(tiles.xmin - lean, tiles.ymax + lean, tiles.res, tiles.nrows, tiles.ncols)


def points_in_polygons(points, edges, tiles: GridSpec, point_id, key="poly_id",
                       x="lon", y="lat"):
    """(point, polygon) pairs for any points, by a tile index.

    ``tiles`` is a coarse grid over the polygons. From the mark of its tile, whose side of the
    polygon the index knows, a point is reached level and then upright inside the tile, so only
    edges that touch the tile can be crossed. Both legs judge an edge by one formula, that of
    the scan lines, so a point on a border has one owner here as well. The index is built from
    the polygons before any point is read.
    """
    marks = _mark_grid(tiles)
    lookup = tile_index(edges, tiles, key).withColumns(
        {"_mx": centre_x(marks), "_my": centre_y(marks)})
    col = F.floor((F.col(x) - F.lit(tiles.xmin)) / F.lit(tiles.res)).cast("int")
    row = F.floor((F.lit(tiles.ymax) - F.col(y)) / F.lit(tiles.res)).cast("int")
    placed = points.select(point_id, F.col(x).alias("_px"), F.col(y).alias("_py"),
                           row.alias("row"), col.alias("col"))
    met = hot_join(placed, lookup, ["row", "col"], salt_on=[point_id], expanded=True)

    def meets(level):
        # where the edge, drawn on beyond its ends, meets a level line
        return f"((x2 - x1) * ({level} - y1) / nullif(y2 - y1, 0) + x1)"

    def right_of_mark(level):
        return f"if(y1 = y2, y1 > {level}, _mx < {meets(level)})"

    level_leg = F.expr(f"(y1 > _py) != (y2 > _py) "
                       f"and (_px < {meets('_py')}) != (_mx < {meets('_py')})")
    upright_leg = F.expr(f"(x1 > _mx) != (x2 > _mx) "
                         f"and {right_of_mark('_py')} != {right_of_mark('_my')}")
    return (met.groupBy(point_id, key)
            .agg((F.max("inside") + F.count_if(level_leg) + F.count_if(upright_leg)).alias("_k"))
            .filter("_k % 2 = 1").select(point_id, key))


def clip_points(points, edges, tiles: GridSpec, point_id, key="poly_id", x="lon", y="lat"):
    """Points inside any polygon."""
    inside = points_in_polygons(points, edges, tiles, point_id, key, x, y)
    return points.join(inside.select(point_id).distinct(), point_id, "left_semi")


def points_within_distance(points, edges, distance, tiles: GridSpec, point_id, key="poly_id",
                           x="lon", y="lat"):
    """(point, polygon) pairs inside the polygon or at most ``distance`` from its border, in
    the units of the (projected) coordinates.

    Border tiles of side ``distance`` are grown by one tile, which bounds the edges a point
    must be measured against; points further inside come from the parity test on ``tiles``.
    """
    step = float(distance)
    near = GridSpec(tiles.xmin, tiles.ymax, step, 0, 0)
    whole_edge = edges.withColumn("_edge", F.struct(key, "x1", "y1", "x2", "y2"))
    touched = cells_on_lines(whole_edge, near, "_edge", pad=1e-9, clip=False)
    near_edges = (touched.withColumn("_dr", F.explode(F.sequence(F.lit(-1), F.lit(1))))
                  .withColumn("_dc", F.explode(F.sequence(F.lit(-1), F.lit(1))))
                  .select("_edge", (F.col("row") + F.col("_dr")).alias("row"),
                          (F.col("col") + F.col("_dc")).alias("col")).distinct()
                  .select("row", "col", "_edge.*"))
    col = F.floor((F.col(x) - F.lit(near.xmin)) / F.lit(step)).cast("int")
    row = F.floor((F.lit(near.ymax) - F.col(y)) / F.lit(step)).cast("int")
    placed = points.select(point_id, F.col(x).alias("_px"), F.col(y).alias("_py"),
                           row.alias("row"), col.alias("col"))
    met = hot_join(placed, near_edges, ["row", "col"], salt_on=[point_id], expanded=True)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    span = F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = ((F.col("_px") - F.col("x1")) * dx + (F.col("_py") - F.col("y1")) * dy) / span
    t = F.coalesce(F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    gap2 = (F.pow(F.col("_px") - F.col("x1") - t * dx, 2)
            + F.pow(F.col("_py") - F.col("y1") - t * dy, 2))
    close = met.filter(gap2 <= step * step).select(point_id, key)
    inside = points_in_polygons(points, edges, tiles, point_id, key, x, y)
    return inside.unionByName(close).distinct()


def polygon_measures(edges, key="poly_id"):
    """Area and centroid in the coordinates given. Rings keep their sign, so holes of the
    opposite orientation are subtracted. Coordinates are shifted to the polygon's corner
    first, which keeps the shoelace sums accurate far from the origin."""
    base = edges.groupBy(key).agg(F.min(F.least("x1", "x2")).alias("_x"),
                                  F.min(F.least("y1", "y2")).alias("_y"))
    e = hot_join(edges, base, [key]).selectExpr(
        key, "_x", "_y", "x1 - _x a1", "y1 - _y b1", "x2 - _x a2", "y2 - _y b2")
    cross = F.col("a1") * F.col("b2") - F.col("a2") * F.col("b1")
    sums = e.groupBy(key).agg(
        F.min("_x").alias("_x"), F.min("_y").alias("_y"), F.sum(cross).alias("_s"),
        F.sum((F.col("a1") + F.col("a2")) * cross).alias("_sx"),
        F.sum((F.col("b1") + F.col("b2")) * cross).alias("_sy"))
    twice = F.nullif(F.col("_s"), F.lit(0.0))
    return sums.select(key, (F.abs("_s") / 2).alias("area"),
                       (F.col("_x") + F.col("_sx") / (3 * twice)).alias("cx"),
                       (F.col("_y") + F.col("_sy") / (3 * twice)).alias("cy"))


def boxes_over_polygons(boxes, edges, tiles: GridSpec, box_id="box_id", key="poly_id"):
    """Boxes (x0 y0 x1 y1) that overlap a polygon: an edge passes through the box, or the
    box centre is inside. ``tiles`` matches the box layout."""
    centre = boxes.select(box_id, ((F.col("x0") + F.col("x1")) / 2).alias("lon"),
                          ((F.col("y0") + F.col("y1")) / 2).alias("lat"))
    col = F.floor((F.col("lon") - F.lit(tiles.xmin)) / F.lit(tiles.res)).cast("int")
    row = F.floor((F.lit(tiles.ymax) - F.col("lat")) / F.lit(tiles.res)).cast("int")
    placed = centre.select(box_id, row.alias("row"), col.alias("col"))
    met = (cells_on_lines(edges, tiles, key).select("row", "col")
           .union(cells_in_polygons(edges, tiles, key).select("row", "col"))).distinct()
    return boxes.join(placed.join(shuffled(met), ["row", "col"]).select(box_id), box_id, "left_semi")
