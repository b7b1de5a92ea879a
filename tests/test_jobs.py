import pytest
from pyspark.sql import functions as F

from aquagrid.constants import GridSpec
from aquagrid.operators import polygons as P
from aquagrid.plans import predictors as PR, pumping as PU
from tests.test_grids import edge_frame
from tests.test_records import rows

GRID = GridSpec(0.0, 0.0, 1.0, 4, 4)


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(
        [("12345", 2000, "IRR", "G", 2.0), ("12345", 2000, "IRR", "G", 3.0), ("12346", 2000, "IRR", "G", 7.0),
         ("12346", 2001, "IRR", "G", 1.0), ("12345", 2000, "IRR", "S", 50.0), ("12347", 2000, "DOM", "G", 60.0),
         ("99999", 2000, "IRR", "G", 70.0)],
        "well_id string, year int, right_type string, water_type string, af double")


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame([("012345", 0.5, -0.5, 1), ("012346", 9.0, -9.0, 1), ("012346", 2.5, -2.5, 2),
                                  ("012347", 0.5, -0.5, 1)],
                                 "well_id string, lon double, lat double, load_order int")


def test_gridded_pumping_with_and_without_zones(spark, records, registry):
    cells = PU.gridded_pumping(records, registry, GRID, ["IRR"], "G")
    assert rows(cells, "year", "row", "col", "af") == [(2000, 0, 0, 5.0), (2000, 2, 2, 7.0), (2001, 2, 2, 1.0)]
    assert cells.filter("year = 2000 and row = 0").first().mm == pytest.approx(5 * 0.32108127, abs=1e-6)
    zones = edge_frame(spark, {1: [[(2, -2), (4, -2), (4, -4), (2, -4)]]})
    inside = PU.gridded_pumping(records, registry, GRID, ["IRR"], "G", zones, GridSpec(0.0, 0.0, 2.0, 2, 2))
    assert rows(inside, "year", "row", "col", "af") == [(2000, 2, 2, 7.0), (2001, 2, 2, 1.0)]


def test_training_layer(spark):
    def layer(data):
        return spark.createDataFrame(data, "year int, row int, col int, value double")
    regions = {"NV": layer([(2000, 0, 0, 9.0), (2000, 0, 1, 500.0), (2001, 0, 0, 5.0)]),
               "AZ": layer([(2000, 0, 0, 8.0), (2000, 0, 1, 8.0), (2001, 0, 0, 7.0), (2000, 0, 2, 6.0)])}
    keys = [(y, 0, c) for y in (2000, 2001) for c in range(3)]
    peff, et = layer([(*k, 1.0) for k in keys]), layer([(*k, 10.0) for k in keys])
    gaps = spark.createDataFrame([("NV", 2001)], "region string, year int")
    exclude = spark.createDataFrame([(0, 2)], "row int, col int")
    out = PU.training_layer(regions, peff, et, 0.5, 1.1, exclude=exclude, no_data=gaps)
    assert rows(out, "year", "col", "value") == [(2000, 0, 9.0), (2000, 1, 8.0), (2001, 0, 7.0)]
    surface = layer([(*k, 100.0) for k in keys])
    assert PU.training_layer(regions, peff, et, 0.5, 1.1, surface).count() == 0
    use = PU.consumptive_use(out, layer([(2000, 0, 0, 0.5)]))
    assert rows(use, "year", "col", "value") == [(2000, 0, 4.5)]


def test_efficiency_layer(spark):
    units = spark.createDataFrame([("u", 2019, 0.4), ("u", 2020, 0.0), ("w", 2020, 0.0)],
                                  "unit_id string, year int, value double")
    cells = spark.createDataFrame([("u", 0, 0), ("u", 0, 1), ("w", 1, 1)], "unit_id string, row int, col int")
    out = PR.efficiency_layer(units, cells, last_year=2020, carry_to=2021)
    assert rows(out.filter("col = 1"), "row", "year", "value") == [(0, 2019, 0.4), (0, 2020, 0.4), (0, 2021, 0.4)]
    assert out.count() == 6


def test_distance_to_polygon_counts_each_pair_once(spark):
    edges = edge_frame(spark, {1: [[(0, 0), (4, 0), (4, -4), (0, -4)]], 2: [[(4, 0), (6, 0), (6, -4), (4, -4)]]})
    pts = spark.createDataFrame([(1, 2.0, -2.0), (2, 4.4, -2.0), (3, -0.6, 0.0), (4, 7.1, -2.0), (5, 3.9, -3.9)],
                                "pid int, lon double, lat double")
    got = P.points_within_distance(pts, edges, 0.5, GridSpec(-1.0, 1.0, 2.0, 4, 4), "pid")
    assert rows(got, "pid", "poly_id") == [(1, 1), (2, 1), (2, 2), (5, 1), (5, 2)]


def test_skew_does_not_change_the_burn(spark):
    edges = edge_frame(spark, {1: [[(0, 0), (4, 0), (4, -4), (0, -4)]], 2: [[(1, -1), (3, -1), (3, -3), (1, -3)]]})
    attrs = spark.createDataFrame([(1, 5, "low"), (2, 9, "high")], "poly_id int, rank int, name string")
    out = P.burn_attribute(edges, attrs, GRID, "name", "rank")
    assert out.count() == 16 and out.filter("name = 'high'").count() == 4
    assert out.filter(F.col("name") == "high").select(F.min("row"), F.max("col")).first()[:] == (1, 2)
