import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.constants import GridSpec
from aquagrid.operators import algebra as A, focal as FO, grid as G, polygons as P, temporal as T
from tests.test_records import rows

SQUARE = [(0, 0), (4, 0), (4, -4), (0, -4)]


def edge_frame(spark, polygons):
    out = []
    for pid, rings in polygons.items():
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                out.append((pid, float(x1), float(y1), float(x2), float(y2)))
    return spark.createDataFrame(out, "poly_id int, x1 double, y1 double, x2 double, y2 double")


def test_points_outside_are_dropped_and_sums_agree(spark):
    grid = GridSpec(0.0, 0.0, 1.0, 2, 2)
    pts = spark.createDataFrame(
        [(0.5, -0.5, 3.0), (0.9, -0.1, 4.0), (1.5, -1.5, 2.0), (1.5, -1.2, -2.0),
         (2.0, -0.5, 9.0), (None, None, 9.0)], "lon double, lat double, af double")
    placed = G.points_to_cells(pts, grid)
    cells = G.sum_points(placed, ["row", "col"], "af")
    assert rows(cells, "row", "col", "af") == [(0, 0, 7.0), (1, 1, None)]
    kept = G.sum_points(placed, ["row", "col"], "af", keep_zero=True)
    assert rows(kept, "row", "col", "af") == [(0, 0, 7.0), (1, 1, 0.0)]


def test_square_with_hole_and_shared_border(spark):
    hole = [(1, -1), (2, -1), (2, -2), (1, -2)]
    right = [(4, 0), (8, 0), (8, -4), (4, -4)]
    edges = edge_frame(spark, {1: [SQUARE, hole], 2: [right]})
    grid = GridSpec(0.0, 0.0, 1.0, 4, 8)
    cells = {tuple(r) for r in P.cells_in_polygons(edges, grid).collect()}
    want = {(1, r, c) for r in range(4) for c in range(4)} - {(1, 1, 1)}
    assert cells == want | {(2, r, c) for r in range(4) for c in range(4, 8)}


def test_cell_centres_on_a_border_belong_to_one_side(spark):
    # the shared border runs through cell centres
    left = [(0, 0), (1.5, 0), (1.5, -3), (0, -3)]
    right = [(1.5, 0), (3, 0), (3, -3), (1.5, -3)]
    cells = P.cells_in_polygons(edge_frame(spark, {1: [left], 2: [right]}),
                                GridSpec(0.0, 0.0, 1.0, 3, 3))
    assert cells.count() == 9 and cells.select("row", "col").distinct().count() == 9


def test_mask_and_inverse_partition_the_cells(spark):
    edges = edge_frame(spark, {1: [[(0.2, -0.3), (5.1, -1.2), (2.2, -6.4)]]})
    grid = GridSpec(0.0, 0.0, 1.0, 8, 8)
    cells = G.full_grid(spark, grid)
    inside = P.clip_cells(cells, edges, grid).count()
    outside = P.erase_cells(cells, edges, grid).count()
    assert inside > 0 and inside + outside == 64


def crossing_parity(x, y, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


@pytest.mark.parametrize("tile", [0.5, 1.0, 3.0])
def test_points_in_polygon_against_brute_force(spark, tile):
    rng = np.random.default_rng(3)
    rings = {}
    for pid in range(6):
        angles = np.sort(rng.uniform(0, 2 * math.pi, 9))
        radius = rng.uniform(0.6, 3.0, 9)
        cx, cy = rng.uniform(2, 8), -rng.uniform(2, 8)
        rings[pid] = [(float(cx + r * math.cos(a)), float(cy + r * math.sin(a)))
                      for r, a in zip(radius, angles)]
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 10, (400, 2)) * [1, -1])]
    edges = edge_frame(spark, {k: [v] for k, v in rings.items()})
    frame = spark.createDataFrame(pts, "pid int, lon double, lat double")
    tiles = GridSpec(-2.0, 2.0, tile, int(14 / tile) + 1, int(14 / tile) + 1)
    got = {tuple(r) for r in P.points_in_polygons(frame, edges, tiles, "pid").collect()}
    want = {(i, k) for i, x, y in pts for k, ring in rings.items() if crossing_parity(x, y, ring)}
    assert got == want
    assert P.clip_points(frame, edges, tiles, "pid").count() == len({i for i, _ in want})


def test_points_on_borders_vertices_and_marks(spark):
    """Points on a lattice that holds all vertices and many border points, an edge drawn twice,
    and marks of the tiles themselves: the owner is that of the crossing rule."""
    shapes = {1: [[(0, 0), (2, 2), (4, 0), (2, -2)]], 2: [[(2, 2), (4, 0), (4, 2)]],
              3: [SQUARE, [(1, -1), (1, -3), (3, -3), (3, -1)]],
              4: [[(0, 0), (3, 0), (3, -3)], [(0, 0), (3, 0), (3, 3)]]}
    edges = edge_frame(spark, shapes)
    tiles = GridSpec(-1.0, 4.0, 1.5, 6, 5)
    mark = 1.5 * (0.5 - (math.sqrt(0.5) - 0.5) / 2)
    pts = [(x / 4, y / 4) for x in range(-3, 20) for y in range(-17, 13)]
    pts += [(-1 + c * 1.5 + mark, 4 - r * 1.5 - mark) for c in range(5) for r in range(6)]
    want = set()
    for pid, e in ((r.poly_id, r) for r in edges.collect()):
        for i, (x, y) in enumerate(pts):
            if (e.y1 > y) != (e.y2 > y) and x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1:
                want ^= {(i, pid)}
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)],
                                  "pid int, lon double, lat double")
    got = P.points_in_polygons(frame, edges, tiles, "pid").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


def test_tile_index_grows_with_the_border(spark):
    """A saw of many teeth along one row of tiles: each tile carries the edges that touch it (2
    of its own, 2 that end on its borders and, in both rows, the base), not all to its right."""
    n = 400
    saw = [(0, -1)] + [(i / 2, -0.9 if i % 2 else -0.1) for i in range(2 * n)] + [(n, -1)]
    index = P.tile_index(edge_frame(spark, {1: [saw]}), GridSpec(0.0, 0.0, 1.0, 2, n))
    assert index.count() <= 6 * n + 4


def test_area_and_centroid(spark):
    tri = [(0, 0), (20, 0), (10, 15)]
    bend = [(25, 2), (45, 2), (45, 12), (35, 12), (35, 30), (25, 30)]
    got = {r.poly_id: r for r in P.polygon_measures(edge_frame(spark, {1: [tri], 2: [bend]})).collect()}
    assert got[1].area == pytest.approx(150) and got[2].area == pytest.approx(380)
    assert (got[1].cx, got[1].cy) == (pytest.approx(10), pytest.approx(5))


def test_line_cells(spark):
    seg = spark.createDataFrame([(1, 0.5, -0.5, 2.5, -0.5), (2, 0.5, -0.5, 0.5, -2.5),
                                 (3, 0.25, -0.5, 1.5, -1.75)],
                                "line_id int, x1 double, y1 double, x2 double, y2 double")
    got = {tuple(r) for r in G.cells_on_lines(seg, GridSpec(0.0, 0.0, 1.0, 3, 3)).collect()}
    assert got == {(1, 0, 0), (1, 0, 1), (1, 0, 2), (2, 0, 0), (2, 1, 0), (2, 2, 0),
                   (3, 0, 0), (3, 1, 0), (3, 1, 1)}


def test_fishnet_counts(spark):
    ext = spark.createDataFrame([(0.0, 0.0, 10.0, 4.0)], "xmin double, ymin double, xmax double, ymax double")
    assert G.fishnet(ext, 3.0, 2.0).count() == 8
    boxes = G.fishnet_by_count(ext, 5, 2)
    assert boxes.count() == 10
    assert {r.box_id for r in boxes.collect()} == set(range(1, 11))


def test_threshold_and_combine(spark):
    a = spark.createDataFrame([(2000, 1, 0.0), (2000, 2, 5.0)], "year int, c int, value double")
    b = spark.createDataFrame([(2000, 1, 7.0), (2000, 2, 8.0), (2000, 3, None)], "year int, c int, value double")
    got = A.combine_by_priority({"NV": a, "AZ": b}, ["year", "c"])
    assert rows(got, "c", "value") == [(1, 7.0), (2, 5.0)]
    gaps = spark.createDataFrame([("NV", 2000)], "region string, year int")
    got = A.combine_by_priority({"NV": a, "AZ": b}, ["year", "c"], gaps)
    assert rows(got, "c", "value") == [(1, 7.0), (2, 8.0)]


def test_layer_means_and_sums(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "c int, value double")
    b = spark.createDataFrame([(1, 4.0), (2, 6.0)], "c int, value double")
    assert rows(A.mean_layers([a, b], ["c"]), "c", "value") == [(1, 3.0), (2, None)]
    assert rows(A.sum_layers([a, a], ["c"]), "c", "value") == [(1, 4.0), (2, 0.0)]
    assert rows(A.align({"x": a, "y": b.filter("c = 1")}, ["c"], how="inner"), "c", "x", "y") == [(1, 2.0, 4.0)]


def test_water_balance_surface_years(spark):
    df = spark.createDataFrame([(2020, 10.0, 0.0, 20.0, 10.0), (2021, 10.0, 0.0, 20.0, 10.0),
                                (2019, 10.0, 0.0, 0.0, 0.0)],
                               "year int, pump double, peff double, et double, sw double")
    got = A.water_balance_filter(df, sw="sw", low=0.9, high=1.1)
    assert rows(got, "year", "pump") == [(2019, None), (2020, 10.0), (2021, None)]


def test_normalise_constant_group(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 0.0), (2, 4.0)], "year int, value double")
    assert rows(A.normalise(df, ["year"]), "year", "value") == [
        (1, None), (1, None), (2, 0.0), (2, 1.0)]


def brute_smooth(z, sigma):
    half, w = FO.kernel_weights(sigma)
    out = np.full(z.shape, np.nan)
    for r in range(z.shape[0]):
        for c in range(z.shape[1]):
            if np.isnan(z[r, c]):
                continue
            num = den = 0.0
            for i in range(-half, half + 1):
                for j in range(-half, half + 1):
                    k = w[i + half] * w[j + half]
                    y, x = r + i, c + j
                    off = not (0 <= y < z.shape[0] and 0 <= x < z.shape[1])
                    if off or not np.isnan(z[y, x]):
                        den += k
                        num += 0 if off else k * z[y, x]
            out[r, c] = num / den
    return out


@pytest.mark.parametrize("sigma,sparse", [(1.0, False), (1.7, True)])
def test_smoothing_against_brute_force(spark, sigma, sparse):
    rng = np.random.default_rng(1)
    z = rng.uniform(0, 10, (7, 9))
    z[rng.uniform(size=z.shape) < 0.25] = np.nan
    data = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c]))
            for r in range(7) for c in range(9) if not (sparse and np.isnan(z[r, c]))]
    df = spark.createDataFrame(data, "row int, col int, value double")
    out = FO.gaussian_smooth(df, GridSpec(0.0, 0.0, 1.0, 7, 9), sigma)
    want = brute_smooth(z, sigma)
    got = {(r.row, r.col): r.value for r in out.collect()}
    assert len(got) == len(data)
    for (r, c), value in got.items():
        assert (value is None) == bool(np.isnan(want[r, c]))
        if value is not None:
            assert value == pytest.approx(want[r, c], abs=1e-12)
    scaled = FO.gaussian_smooth(df, GridSpec(0.0, 0.0, 1.0, 7, 9), sigma, normalise=True)
    ends = scaled.agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
    assert (ends.a, ends.b) == (0.0, 1.0)


@pytest.mark.parametrize("shape,sigma", [((7, 9), 1.0), ((3, 4), 2.0)])
def test_plain_smoothing_mirrors_the_borders(spark, shape, sigma):
    z = np.random.default_rng(8).uniform(0, 5, shape)
    z[1, 2] = np.nan
    half, w = FO.kernel_weights(sigma, 2 * int(4 * sigma + 0.5) + 1)
    padded = np.pad(np.nan_to_num(z), half, mode="symmetric")
    kernel = np.outer(w, w)
    df = spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c]))
                                for r in range(shape[0]) for c in range(shape[1])],
                               "row int, col int, value double")
    out = FO.gaussian_smooth_filled(df, GridSpec(0.0, 0.0, 1.0, *shape), sigma).collect()
    assert len(out) == z.size
    for r in out:
        part = padded[r.row:r.row + 2 * half + 1, r.col:r.col + 2 * half + 1]
        assert r.value == pytest.approx((part * kernel).sum())


def test_distance_against_brute_force(spark):
    rng = np.random.default_rng(5)
    t = rng.uniform(size=(23, 17)) < 0.02
    t[3, 4] = True
    df = spark.createDataFrame([(r, c, bool(t[r, c])) for r in range(23) for c in range(17)],
                               "row int, col int, t boolean")
    out = FO.distance_to_target(df, "t", GridSpec(0.0, 0.0, 0.5, 23, 17))
    spots = np.argwhere(t)
    for r in out.collect():
        want = 0.5 * np.sqrt(((spots - [r.row, r.col]) ** 2).sum(axis=1).min())
        assert r.distance == pytest.approx(want, abs=1e-12)
    none = FO.distance_to_target(df, "false", GridSpec(0.0, 0.0, 0.5, 23, 17))
    assert none.filter("distance is not null").count() == 0


def test_layers_are_smoothed_and_measured_apart(spark):
    grid = GridSpec(0.0, 0.0, 1.0, 3, 3)
    one = [(r, c, float(3 * r + c)) for r in range(3) for c in range(3)]
    both = [("a", y, r, c, v + 100 * (y - 2000)) for y in (2000, 2001) for r, c, v in one]
    layers = spark.createDataFrame(both, "var string, year int, row int, col int, value double")
    key = ["var", "year"]
    runs = [lambda d, by: FO.gaussian_smooth(d, grid, by=by),
            lambda d, by: FO.gaussian_smooth(d, grid, normalise=True, by=by),
            lambda d, by: FO.gaussian_smooth_filled(d, grid, by=by),
            lambda d, by: FO.distance_to_target(d, "value = 4", grid, by=by)]
    for run in runs:
        got = {(r[1], r[2], r[3]): r[4] for r in run(layers, key).collect()}
        for year in (2000, 2001):
            alone = run(layers.filter(F.col("year") == year).select("row", "col", "value"), ())
            want = {(year, r[0], r[1]): r[2] for r in alone.collect()}
            assert len(want) == 9
            for at, value in want.items():
                assert got[at] == (None if value is None else pytest.approx(value, abs=1e-12))
        assert len(got) == 18


def test_bilinear_centre_and_missing_neighbour(spark):
    src = spark.createDataFrame([(0, 0, 0.0), (0, 1, 4.0), (1, 0, None), (1, 1, 8.0)],
                                "row int, col int, value double")
    target = spark.createDataFrame([(0, 0)], "row int, col int")
    # one target cell of twice the size: its centre is the corner the four cells share
    out = FO.resample_bilinear(src, GridSpec(0.0, 0.0, 1.0, 2, 2), target, GridSpec(0.0, 0.0, 2.0, 1, 1))
    assert out.first().value == pytest.approx(4.0)


def test_season_rules(spark):
    months = [(c, 2000, m, float(m)) for c in (1, 2, 3, 4) for m in range(1, 13)]
    months += [(5, 2000, m, float(m)) for m in range(1, 12)]  # December is missing
    monthly = spark.createDataFrame(months, "cell int, year int, month int, value double")
    season = spark.createDataFrame([(1, 4, 6), (2, 8, 3), (3, None, 9), (5, 4, 6)],
                                   "cell int, start_month int, end_month int")
    total = T.season_sum(monthly, season, ["cell"])
    mean = T.season_mean(monthly, season, ["cell"])
    assert rows(total, "cell", "value") == [(1, 15.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, None)]
    assert rows(mean, "cell", "value") == [(1, 5.0), (2, None), (3, None), (4, None), (5, None)]
    loose = T.season_sum(monthly, season, ["cell"], strict=False)
    assert rows(loose.filter("cell = 5"), "cell", "value") == [(5, 15.0)]


def test_months_outside_the_offered_dates_are_skipped(spark):
    obs = spark.createDataFrame(
        [("a", 1, "2000-01-10 00:00:00", 2.0), ("a", 1, "2000-02-10 00:00:00", 3.0),
         ("a", 1, "2000-02-11 00:00:00", 4.0), ("z", 1, "2000-02-10 00:00:00", 3.0)],
        "var string, cell_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    layers = [("a", "sum", 10.0, "2000-01-05", "2000-03-01")]
    assert rows(T.monthly_reduce(obs, layers), "var", "year", "month", "value") == [("a", 2000, 2, 70.0)]


def test_expanded_sides_are_not_broadcast(spark, tmp_path, capsys):
    """Tiles and cells come from few polygons; Spark's size estimate does not count the growth."""
    def filed(df, name):
        df.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    edges = filed(edge_frame(spark, {1: [SQUARE], 2: [[(5, -1), (9, -2), (7, -6)]]}), "edges")
    points = filed(spark.createDataFrame([(1, 1.5, -1.5), (2, 4.7, -1.5), (3, 9.5, -9.5)],
                                         "point_id int, lon double, lat double"), "points")
    grid = GridSpec(0.0, 0.0, 2.0, 6, 6)
    near = P.points_within_distance(points, edges, 0.75, grid, "point_id")
    clipped = P.clip_cells(G.full_grid(spark, grid), edges, grid)
    for df in (near, clipped):
        df.explain()
        joins = [x for x in capsys.readouterr().out.split("\n") if "BroadcastHashJoin" in x]
        assert not [x for x in joins if ", Inner, " in x]
    assert rows(near, "point_id", "poly_id") == [(1, 1), (2, 1), (2, 2)]
