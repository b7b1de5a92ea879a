"""Queries over inputs past the sizes the stand-in tables were first laid out for."""

import duckdb
import pytest

import __spark_entry__ as entry
from aquagrid.plans import pumping as PU
from checks.run import compare, connect

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """A folder whose wells, cells and polygons lie far down the grid."""
    folder = tmp_path_factory.mktemp("far")
    with duckdb.connect() as db:
        for name in ("nation", "supplier", "part", "lineitem"):
            db.execute(f"create table {name} as from '/root/testdata/sf0.001/{name}.parquet' limit "
                       f"{25 if name == 'nation' else 0}")
        for key in (1, 1499, 1500, 1507, 9999, 30_000_000):
            db.execute(f"insert into supplier by name select {key} as s_suppkey, {key % 25} as s_nationkey")
            db.execute(f"""insert into lineitem by name select {key} as l_orderkey, 1 as l_linenumber,
                {key} as l_suppkey, 7 as l_partkey, timestamp '1997-05-05' as l_shipdate,
                'A' as l_returnflag, 'F' as l_linestatus, 2.0 as l_quantity""")
        db.execute("""insert into part by name select 600000000 + i as p_partkey, 5 as p_size,
            1.0 as p_retailprice from range(1000) t(i)""")
        for name in ("nation", "supplier", "part", "lineitem"):
            db.execute(f"copy {name} to '{folder}/{name}.parquet'")
    return str(folder)


def test_wells_past_the_first_rows_stay_on_the_grid(spark, far):
    kept = {r.well_id: (r.row, r.col) for r in QUERIES["g1_points_to_cells"](spark, far).collect()}
    assert kept["011500"] == (15, 0) and kept["011507"] == (15, 3)
    assert len(kept) == 6
    # the longest well id is not padded, so its records meet no well
    for name in ("g4_sum_points", "job_gridded_pumping"):
        assert sum(r.af for r in QUERIES[name](spark, far).collect()) == 10.0
    basins = {r.basin_code: r.pumping_mm for r in QUERIES["entry_basin_pumping"](spark, far).collect()}
    assert sum(basins.values()) == pytest.approx(10 * 0.32108127, abs=1e-3)


def test_cells_past_row_ten_million_are_found(spark, far):
    connection = connect(far)
    for name in ("g7_cells_in_polygons", "n1_resample_nearest"):
        assert connection.execute(ORACLES[name]).fetchall()
        assert compare(QUERIES[name](spark, far), ORACLES[name], connection) is None


def test_each_region_has_its_own_rule(spark):
    def layer(data):
        return spark.createDataFrame(data, "year int, row int, col int, value double")
    # per region a column: the balance holds, fails, and the value is above 1500
    regions = {name: layer([(2000, i, 0, 90.0), (2000, i, 1, 1500.0), (2000, i, 2, 1501.0), (2020, i, 0, 60.0)])
               for i, name in enumerate(("NV", "AZ", "CO", "KS"))}
    keys = [(y, r, c) for y in (2000, 2020) for r in range(4) for c in range(3)]
    peff, et, sw = (layer([(*k, x) for k in keys]) for x in (0.0, 100.0, 20.0))
    got = PU.training_layer(regions, peff, et, surface=sw, rules=PU.REGION_RULES).collect()
    assert sorted((r.row, r.year, r.value) for r in got) == [
        (0, 2000, 90.0), (0, 2000, 1500.0), (0, 2000, 1501.0), (0, 2020, 60.0),
        (1, 2000, 90.0), (1, 2000, 1500.0), (1, 2020, 60.0), (2, 2000, 90.0), (3, 2000, 90.0)]
    half = {n: f.withColumn("value", f.value * 0 + 60) for n, f in regions.items()}
    out = PU.training_layer(half, peff, et, surface=sw, rules=PU.REGION_RULES).filter("col = 0")
    assert sorted((r.row, r.year) for r in out.collect()) == [
        (0, 2000), (0, 2020), (1, 2000), (1, 2020), (2, 2000)]   # surface water, until 2019, in CO only


@pytest.mark.parametrize("name, key, least", [
    ("a3_mean_layers_all_years", None, 1), ("a16_fill_on_grid_all_years", "year", 7),
    ("r14_unit_mean_fill_all_years", "year", 9), ("z7_join_annual_series_all_years", "year", 7),
    ("z10_compile_basins_all_years", "year", 7), ("f4_fit_and_holdout_rows_all_folds", "fold", 25)])
def test_all_years_and_folds(spark, name, key, least):
    folder = "/root/testdata/sf0.001"
    out = QUERIES[name](spark, folder)
    assert compare(out, ORACLES[name], connect(folder)) is None
    assert key is None or out.select(key).distinct().count() >= least
