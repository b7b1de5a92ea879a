import pytest
from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.operators import balance as B, zonal as Z
from aquagrid.session import cut_lineage
from tests.test_records import rows


@pytest.fixture(scope="module")
def dims(spark):
    return spark.createDataFrame([("a", "A basin", 1e9, 2000, 2001), ("b", "B basin", 2e9, 2001, 2001)],
                                 "basin_code string, basin string, area_m2 double, first_year int, last_year int")


def test_pixels_and_totals(spark, dims):
    pred = spark.createDataFrame([(2000, 0, 0, 5.0), (2000, 0, 1, 2500.0), (2001, 0, 0, None)],
                                 "year int, row int, col int, value double")
    act = spark.createDataFrame([(2000, 0, 0, 4.0), (2001, 0, 2, 1.0)], "year int, row int, col int, value double")
    cells = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 2, "b")], "row int, col int, basin_code string")
    px = Z.compare_pixels(pred, act, cells)
    assert rows(px, "basin_code", "year", "col", "pred_pumping_mm", "actual_pumping_mm") == [
        ("a", 2000, 0, 5.0, 4.0), ("a", 2000, 1, 0.0, 0.0), ("a", 2001, 0, 0.0, 0.0), ("b", 2001, 2, 0.0, 1.0)]
    tot = {(r.basin_code, r.year): r for r in Z.annual_totals(px, dims).collect()}
    one = tot[("a", 2000)]
    assert one.pred_pumping_m3 == pytest.approx(5 * C.CELL_AREA_MM2 / 1e9)
    assert one.mean_pred_pumping_mm == pytest.approx(one.pred_pumping_m3 / 1e9 * 1000, rel=1e-5)
    named = Z.compile_basins(Z.in_year_window(Z.annual_totals(px, dims), dims), dims)
    got = {(r.basin_code, r.year): r.pred_pumping_mm for r in named.collect()}
    assert got == {("a", 2000): 5.0, ("a", 2001): None, ("b", 2001): None}
    assert Z.count_positive(px, basins=dims).filter("basin_code = 'a' and year = 2000").first()[
        "n_pred_pumping_mm"] == 1


def test_overlap_share_limits(spark):
    small = spark.createDataFrame([(s, 0, s * 100 + i) for s in (1, 2, 3) for i in range(20)],
                                  "small_id int, row int, col int")
    inside = [(0, 100 + i) for i in range(4)] + [(0, 200 + i) for i in range(19)] + [(0, 300 + i) for i in range(10)]
    large = spark.createDataFrame([(r, c, "x") for r, c in inside], "row int, col int, basin_code string")
    w = Z.overlap_weights(small, large)
    assert rows(w, "small_id", "weight") == [(1, 0.0), (2, 1.0), (3, 0.5)]
    values = spark.createDataFrame([(1, 2000, 9.0), (2, 2000, 10.0), (3, 2000, 4.0), (3, 2001, None)],
                                   "small_id int, year int, value double")
    out = Z.area_weighted_transfer(values, w)
    assert rows(out, "year", "transferred") == [(2000, 12.0), (2001, 0.0)]


def test_reports_keep_years_of_either_side(spark, dims):
    totals = spark.createDataFrame([("a", 2000, 1.0, 2.0, 3.0)],
                                   "basin_code string, year int, pred_pumping_mm double, pred_pumping_m3 double, pred_pumping_AF double")
    rep = spark.createDataFrame([("a", 2001, 7.0), ("a", 1999, 5.0)], "basin_code string, year int, Irrigation_AF double")
    out = Z.totals_against_reports(totals, rep, dims)
    assert rows(out, "year", "pred_pumping_AF", "actual_pumping_AF") == [(2000, 3.0, None), (2001, None, 7.0)]


def test_repeated_class_is_an_error(spark):
    df = spark.createDataFrame([(1, "F", 1.0), (1, "F", 2.0)], "k int, water_class string, annual_total double")
    with pytest.raises(Exception, match="repeated class"):
        B.pivot_classes(df, ["k"], ["F", "O"]).collect()
    ok = B.pivot_classes(df.limit(1), ["k"], ["F", "O"])
    assert rows(ok, "k", "O") == [(1, 0.0)]


def test_loss_keeps_bodies_without_months(spark):
    et = spark.createDataFrame([(1, 2000, 1, 10.0)], "ID int, year int, month int, et double")
    p = spark.createDataFrame([(1, 2000, 1, 4.0)], "ID int, year int, month int, ppt double")
    area = spark.createDataFrame([(1, 1e6), (2, 5.0)], "ID int, Area_m2 double")
    out = B.monthly_loss(et, p, area)
    assert rows(out, "ID", "net_loss_mm") == [(1, 6.0), (2, None)]
    assert B.annual_loss(out).first().net_loss_AF == pytest.approx(6e3 * C.AF_PER_M3)


def test_configured_tables(spark):
    assert C.basin_dim(spark).count() == len(C.BASINS)
    assert C.layer_catalog(spark).filter("reducer not in ('sum', 'mean', 'first')").count() == 0


def test_checkpoint_uses_the_named_folder(spark):
    df = cut_lineage(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10 and spark.sparkContext.getCheckpointDir()
