import pytest
from pyspark.sql import functions as F

from aquagrid.functions import numeric as N, units as U
from aquagrid.operators import joins as J, records as R


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=repr)


def test_ids_are_padded_not_cut(spark):
    df = spark.createDataFrame([("12345", "1"), ("123456", "12345678"), ("1", "1234567")],
                               "well_id string, wdid string")
    out = R.pad_ids(R.pad_short_ids(df), "wdid", 7)
    assert rows(out, "well_id", "wdid") == [("012345", "0000001"), ("1", "1234567"),
                                            ("123456", "12345678")]


def test_registry_last_row_wins_and_unknown_wells_stay(spark):
    reg = spark.createDataFrame([("a", 1.0, 1.0, 1), ("a", 2.0, 3.0, 2), (None, 9.0, 9.0, 3)],
                                "well_id string, lon double, lat double, load_order int")
    wells = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "well_id string, v int")
    assert rows(R.attach_coordinates(wells, reg), "well_id", "v", "lon", "lat") == sorted(
        [("a", 1, 2.0, 3.0), ("b", 2, None, None), (None, 3, None, None)], key=repr)


def test_cap_drops_missing_and_keeps_boundary(spark):
    rec = spark.createDataFrame([("a", 5000.0), ("a", 5000.1), ("b", None), ("c", 1.0)],
                                "k string, af_pumped double")
    wells = spark.createDataFrame([("a", 1), ("a", 2)], "k string, w int")
    assert rows(R.join_well_table(rec, wells, "k"), "k", "af_pumped", "w") == [
        ("a", 5000.0, 1), ("a", 5000.0, 2), ("c", 1.0, None)]


def test_member_shares_sum_to_value(spark):
    df = spark.createDataFrame([(1, "a_b_c", 9.0), (2, "d", 4.0)], "id int, l string, v double")
    out = R.split_members(df, "l", "v")
    assert rows(out.groupBy("id").agg(F.sum("v").alias("s")), "id", "s") == [(1, 9.0), (2, 4.0)]


def test_wide_years_keep_missing(spark):
    df = spark.createDataFrame([("x", 1.0, None, 5.0)],
                               "id string, AF_USED_2000 double, AF_USED_2001 double, ACRES_2001 double")
    out = R.wide_years_to_long(df, ["id"], {"af": "AF_USED_", "acres": "ACRES_"})
    assert rows(out, "id", "year", "af", "acres") == [
        ("x", 2000, 1.0, None), ("x", 2001, None, 5.0)]


def test_unit_mean_fill(spark):
    df = spark.createDataFrame([("h", 2019, 0.0), ("h", 2020, 4.0), ("h", 2018, 2.0),
                                ("g", 2020, 0.0)], "u string, year int, value double")
    out = R.fill_with_unit_mean(df, "u", "value", 2020, 2021)
    assert rows(out, "u", "year", "value") == sorted([
        ("h", 2018, 2.0), ("h", 2019, 3.0), ("h", 2020, 4.0), ("h", 2021, 4.0),
        ("g", 2020, None), ("g", 2021, None)], key=repr)


def test_names_outside_the_mapping_are_missing(spark):
    df = spark.createDataFrame([("DOUGLAS INA",), ("NOWHERE",), (None,)], "a string")
    assert {r[0] for r in R.map_names(df, "a").collect()} == {"DOUGLAS AMA", None}


@pytest.mark.parametrize("easting,northing,lon,lat", [
    # central meridian on the equator, and one degree checks computed by hand from the
    # meridian arc of GRS80 (4984944.378 m to 45 degrees north)
    (500000.0, 0.0, -111.0, 0.0),
    (500000.0, 0.9996 * 4984944.3778, -111.0, 45.0),
])
def test_utm_control_points(spark, easting, northing, lon, lat):
    df = spark.createDataFrame([(easting, northing)], "utm_x double, utm_y double")
    r = R.with_lonlat(df).first()
    assert r.lon == pytest.approx(lon, abs=1e-7) and r.lat == pytest.approx(lat, abs=1e-7)


def test_utm_is_symmetric_and_conformal(spark):
    import math
    df = spark.createDataFrame([(x, y) for x in (350000.0, 500000.0, 650000.0)
                                for y in (3700000.0, 3700001.0)], "utm_x double, utm_y double")
    got = {(r.utm_x, r.utm_y): (r.lon, r.lat) for r in R.with_lonlat(df).collect()}
    west, east = got[(350000.0, 3700000.0)], got[(650000.0, 3700000.0)]
    assert west[0] + 111 == pytest.approx(-(east[0] + 111), abs=1e-10)
    assert west[1] == pytest.approx(east[1], abs=1e-10)
    # one grid metre north at the central meridian is 1/0.9996 m of meridian arc
    lat0, lat1 = got[(500000.0, 3700000.0)][1], got[(500000.0, 3700001.0)][1]
    e2 = 2 / 298.257222101 - 1 / 298.257222101 ** 2
    radius = 6378137.0 * (1 - e2) / (1 - e2 * math.sin(math.radians(lat0)) ** 2) ** 1.5
    assert math.radians(lat1 - lat0) * radius == pytest.approx(1 / 0.9996, rel=1e-6)


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(-9999.0,), (-9999.00001,), (float("nan"),), (0.0,), (None,)],
                               "v double")
    got = [r[0] for r in df.select(N.decode_nodata("v")).collect()]
    assert got == [None, None, None, 0.0, None]
    empty = df.filter("v is null").agg(N.total_or_zero("v").alias("s")).first()
    assert empty.s == 0.0
    assert df.select(N.ratio(F.lit(1.0), F.lit(0.0)).alias("r")).first().r is None


def test_af_to_mm(spark):
    mm = spark.range(1).select(U.af_to_mm(F.lit(1.0)).alias("mm")).first().mm
    assert mm == pytest.approx(0.32108127, abs=1e-8)


def test_doy_to_month_in_leap_years(spark):
    df = spark.createDataFrame([(2000, 60, 2), (2001, 60, 3), (2000, 366, 12), (2001, 1, 1)],
                               "y int, d int, want int")
    assert df.filter(U.doy_to_month("y", "d") != F.col("want")).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join_equals_plain_join(spark, how):
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 11 == 0, None)
        .otherwise(F.col("id") % 40).cast("int").alias("k"), "id")
    right = spark.range(0, 60, 2).select(F.col("id").cast("int").alias("k"),
                                         (F.col("id") * 10).alias("w"))
    right = right.unionByName(right.filter("k = 0").withColumn("w", F.lit(-1).cast("bigint")))
    salted = J.hot_join(left, right, ["k"], how, salts=4, min_rows=50)
    plain = left.join(right, ["k"], how)
    cols = sorted(plain.columns)
    assert rows(salted, *cols) == rows(plain, *cols)
    assert J.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"],
                      min_rows=500).collect()[0].k == 0


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, w int")
    assert rows(J.null_safe_join(a, b, ["k"]), "k", "v", "w") == [(None, 1, 10)]


def test_deduplicate_is_deterministic(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 1, "z"), (2, 5, "q")],
                               "k int, o int, t string")
    assert rows(R.deduplicate(df.repartition(4), ["k"], ["o"]), "k", "o", "t") == [
        (1, 1, "z"), (2, 5, "q")]
