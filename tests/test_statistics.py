import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.functions.normal import inverse_normal
from aquagrid.operators import distributions as D, features as FE, metrics as M, ordering as O
from tests.test_records import rows


def test_blocks_never_decrease(spark):
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.lognormal(0, 8, 2000), -rng.lognormal(0, 8, 2000),
                        2.0 ** np.arange(-60, 60), -2.0 ** np.arange(-60, 60),
                        np.nextafter(2.0 ** np.arange(-60, 60), 0), [0.0, np.inf, -np.inf, np.nan]])
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    few = [-np.inf, -3.5, 0.0, 1e-5, 2.0 ** 40, np.inf]
    for bounds in ([], few[2:3], few, O.range_bounds(df, "v")):
        got = df.select("v", O.block_of(bounds, "v").alias("b")).orderBy("v").collect()
        assert [r.b for r in got] == sorted(r.b for r in got)
        assert all(r.b == sum(x < r.v for x in bounds) for r in got if r.v == r.v)


def test_narrow_and_hot_values_are_cut(spark):
    """A million doubles in [1000, 1001) fill 1,000 blocks at 200 partitions; a value that half
    of the rows share is cut by its ties, and no block holds more than 1 in 300 rows."""
    df = spark.range(1_000_000).withColumn("x", 1000 + F.rand(7))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        bounds = O.range_bounds(df, "x")
        half = df.withColumn("x", F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("x")))
        pairs = O.pair_bounds(half, "x", "id")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    sizes = df.groupBy(O.block_of(bounds, "x").alias("b")).count()
    assert sizes.count() == 1000 and sizes.agg(F.max("count")).first()[0] < 1_000_000 / 300
    sizes = half.groupBy(O.block_of(pairs, "x", "id").alias("b")).count()
    assert sizes.agg(F.max("count")).first()[0] < 1_000_000 / 300


def test_ranks_of_no_rows_and_odd_values(spark):
    schema = "id long, x double"
    none = spark.createDataFrame([(1, None)], schema)
    assert O.row_rank(none, [], "x", "id").count() == 0
    assert O.exact_quantiles(none, [], "x", {"m": 0.5}).first()["m"] is None
    odd = spark.createDataFrame([(3, float("nan")), (1, float("inf")), (4, -0.0), (2, 0.0),
                                 (5, float("-inf"))], schema)
    ranked = O.row_rank(odd, [], "x", "id").orderBy("rank").collect()
    assert [r.id for r in ranked] == [5, 2, 4, 1, 3]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(2)
    out = []
    for i in range(3000):
        g = "hot" if i % 3 else ("small" if i % 2 else "flat")
        x = 5.0 if g == "flat" or i % 4 == 0 else float(np.round(rng.normal(0, 100), 1))
        out.append((i, g, x if i % 50 else None))
    return spark.createDataFrame(out, "id int, g string, x double").repartition(7).persist()


def arrays(sample):
    p = sample.toPandas()
    return {g: d for g, d in p.dropna().groupby("g")}


def test_ranks_and_quantiles_are_exact(sample):
    ranked = O.row_rank(sample, ["g"], "x", "id").toPandas()
    for g, d in arrays(sample).items():
        r = ranked[ranked.g == g].sort_values("rank")
        assert list(r["rank"]) == list(range(1, len(d) + 1))
        assert list(r["id"]) == list(d.sort_values(["x", "id"])["id"])
    q = O.exact_quantiles(sample, ["g"], "x", {"a": 0.1, "b": 0.5, "c": 0.999}).collect()
    for r in q:
        want = np.percentile(arrays(sample)[r.g].x, [10, 50, 99.9])
        assert [r.a, r.b, r.c] == pytest.approx(list(want))


def test_running_totals_with_next_value(sample):
    got = O.counted(sample, ["g"], "x", following="nx").toPandas()
    for g, d in arrays(sample).items():
        runs = got[got.g == g].sort_values("x")
        assert list(runs.below_n) == list(np.concatenate([[0], runs.n.cumsum()[:-1]]))
        assert list(runs.nx.dropna()) == list(runs.x[1:])


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1), ("c", 3)], "k string, n long")
    got = O.repeat_rows(df, "n", "i", chunk=3)
    assert rows(got.groupBy("k").agg(F.count("*").alias("c"), F.sum("i").alias("s")),
                "k", "c", "s") == [("a", 10, 55), ("b", 1, 1), ("c", 3, 6)]


def test_ecdf_and_quantile_mapping(spark, sample):
    e = D.empirical_cdf(sample, "x", ["g"]).toPandas()
    for g, d in arrays(sample).items():
        mine = e[e.g == g].sort_values("ecdf")
        assert list(mine.x) == sorted(d.x)
        assert list(mine.ecdf) == pytest.approx(list(np.arange(1, len(d) + 1) / len(d)))
    obs = spark.createDataFrame([("hot", float(v)) for v in (1, 2, 4, 8, 8, 20)]
                                + [("small", 3.0)], "g string, actual double")
    mapped = D.quantile_mapping(sample.filter("g <> 'flat'"), obs, ["g"], "x", "id").toPandas()
    assert mapped[mapped.x.isna()].corrected.isna().all()
    for g, seen in (("hot", [1, 2, 4, 8, 8, 20]), ("small", [3.0])):
        d = mapped[(mapped.g == g) & mapped.x.notna()].sort_values(["x", "id"])
        n, m = len(d), len(seen)
        want = np.interp(np.arange(1, n + 1) / n, np.arange(1, m + 1) / m, seen)
        assert list(d.corrected) == pytest.approx(list(want))
    assert len(mapped) == sample.filter("g <> 'flat'").count()


def test_ks_distance(sample):
    got = {(r.group_a, r.group_b): r.distance for r in
           D.ks_distances(sample, ["flat", "hot", "small"], "g", "x", 6).collect()}
    data = arrays(sample)
    assert len(got) == 9
    for a in data:
        for b in data:
            both = np.sort(np.concatenate([data[a].x, data[b].x]))
            fa = np.searchsorted(np.sort(data[a].x), both, side="right") / len(data[a])
            fb = np.searchsorted(np.sort(data[b].x), both, side="right") / len(data[b])
            assert got[(a, b)] == pytest.approx(np.abs(fa - fb).max(), abs=1e-6)


def test_density_integrates_to_one(sample):
    d = D.kernel_density(sample, "x", ["g"], points=400).toPandas()
    assert set(d.g) == {"hot", "small"}  # a constant group has no density
    for _, part in d.groupby("g"):
        part = part.sort_values("x")
        assert np.trapezoid(part.density, part.x) == pytest.approx(1.0, abs=5e-3)


def test_spearman_equals_pandas(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 20, 300)
    b = a + rng.integers(0, 15, 300)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "id int, a double, b double")
    got = {(r.var_a, r.var_b): r.r for r in
           D.correlation_matrix(df, ["a", "b"], "spearman", ["id"], 8).collect()}
    pdf = df.toPandas()
    want = pdf["a"].rank().corr(pdf["b"].rank())
    assert got[("a", "b")] == pytest.approx(want, abs=1e-8) and got[("a", "a")] == 1.0


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0), (None, 1.0)],
                               "actual double, predicted double")
    r = M.regression_metrics(df).first()
    assert r.n == 3 and r.rmse == pytest.approx(math.sqrt(5 / 3)) and r.mae == pytest.approx(1.0)
    assert r.r2 == pytest.approx(1 - 5 / 8) and r.pbias == pytest.approx(100 / 9)
    assert r.me == pytest.approx(1 / 3) and r.nmae == pytest.approx(1 / 3)
    flat = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "actual double, predicted double")
    assert M.regression_metrics(flat).first().r2 is None
    assert M.regression_metrics(df.filter("false")).count() == 0


def test_range_edges(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (0, 5, 10, 15, 20)],
                               "actual double, predicted double")
    half = {r.low: r.n for r in M.range_metrics(df, [0, 10, 20]).collect()}
    closed = {r.low: r.n for r in M.range_metrics(df, [0, 10, 20], closed="both").collect()}
    assert half == {0.0: 2, 10.0: 2} and closed == {0.0: 3, 10.0: 3}


def test_histogram_matches_numpy(sample):
    got = M.histogram(sample, "x", bins=12).toPandas().set_index("bin")
    x = sample.toPandas().x.dropna()
    n, edges = np.histogram(x, bins=12)
    dense, _ = np.histogram(x, bins=12, density=True)
    assert [int(got.n.get(i, 0)) for i in range(12)] == list(n)
    for i in got.index:
        assert got.density[i] == pytest.approx(dense[i]) and got.low[i] == pytest.approx(edges[i])
    one = M.histogram(sample.filter("g = 'flat'"), "x", ["g"], bins=12).first()
    n, edges = np.histogram([5.0] * one.n, bins=12, density=True)
    assert one.density == pytest.approx(n[one.bin]) and one.low == pytest.approx(edges[one.bin])


def test_outlier_limits(sample):
    for r in M.iqr_limits(sample, "x", ["g"]).collect():
        x = arrays(sample)[r.g].x.to_numpy()
        q1, q2, q3 = np.percentile(x, [25, 50, 75])
        assert r.low == x[x >= q1 - 1.5 * (q3 - q1)].min()
        assert r.high == x[x <= q3 + 1.5 * (q3 - q1)].max() and r.median == pytest.approx(q2)
    one = M.mad_limits(sample, "x", k=2.0, lower_by=1, raise_by=2).first()
    x = sample.toPandas().x.dropna()
    mad = np.median(np.abs(x - np.median(x)))
    assert one.low == pytest.approx(np.median(x) - 2 * mad - 1)
    assert one.high == pytest.approx(np.median(x) + 2 * mad + 2)
    whole = M.iqr_limits(sample, "x").first()
    assert whole.median == pytest.approx(np.median(x))


def test_inverse_normal(spark):
    points = [(0.5, 0.0), (0.975, 1.959963985), (0.001, -3.090232306), (0.84134474607, 1.0)]
    df = spark.createDataFrame(points, "p double, z double").withColumn("got", inverse_normal("p"))
    assert df.filter("abs(got - z) > 1e-7").count() == 0
    assert df.select(inverse_normal(F.lit(0.0)).alias("z")).first().z is None


def test_band_shares_sum_to_100(sample):
    got = {r.band: r.pct for r in M.band_shares(sample, "x", [-50, 0, 50]).collect()}
    assert len(got) == 4 and sum(got.values()) == pytest.approx(100)


def test_pixel_split_keeps_pixels_whole(spark):
    df = spark.range(4000).select((F.col("id") % 400).alias("pixel_id"), (F.col("id") % 10).alias("year"),
                                  (F.col("id") % 400 % 8).alias("state_id"))
    out = FE.pixel_split(df, test=0.25, validation=0.2).persist()
    assert out.count() == 4000
    assert out.groupBy("pixel_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    shares = {(r.state_id, r.split): r.n for r in out.select("pixel_id", "state_id", "split").distinct()
              .groupBy("state_id", "split").agg(F.count("*").alias("n")).collect()}
    sizes = {}
    for (state, _), n in shares.items():
        sizes[state] = sizes.get(state, 0) + n
    assert 1 not in sizes and 3 not in sizes and sizes[12] == 100
    for state, total in sizes.items():
        n_test = math.ceil(0.25 * total)
        assert shares[(state, "test")] == n_test
        assert shares[(state, "validation")] == math.ceil(0.2 * (total - n_test))


def test_bootstrap_counts_sum_to_n(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    w = FE.bootstrap_weights(df, ["k"], 4, seed=3)
    sums = w.groupBy("member").agg(F.sum("weight").alias("n"), F.count("*").alias("rows"))
    got = sums.collect()
    assert len(got) == 4 and all(r.n == 500 for r in got)
    assert all(280 < r.rows < 350 for r in got)  # about 63 % of the rows are drawn


def test_sampling_and_folds(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = {r.k for r in FE.sample_rows(df.repartition(3), ["k"], 50).collect()}
    b = {r.k for r in FE.sample_rows(df.repartition(9), ["k"], 50).collect()}
    assert a == b and len(a) == 50
    folds = FE.assign_folds(df, ["k"], 5).groupBy("fold").count().collect()
    assert len(folds) == 5 and all(140 < r["count"] < 260 for r in folds)


def test_standardise_round_trip(spark, tmp_path):
    from aquagrid.sources.records import read_statistics, write_statistics
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0), (None, 7.0)], "a double, b double")
    stats = FE.scaling_stats(df, ["a", "b"])
    write_statistics(stats, str(tmp_path / "stats"))
    out = FE.standardise(df, read_statistics(spark, str(tmp_path / "stats")), ["a", "b"])
    assert rows(out, "a", "b") == sorted([(-1.0, None), (1.0, None), (None, None)], key=repr)


def test_feature_table_drops_incomplete_rows(spark):
    annual = spark.createDataFrame([("irr", 1, 2000, 0.02), ("et", 1, 2000, 3.0), ("irr", 2, 2000, 0.5),
                                    ("irr", 3, 2000, 0.01), ("et", 3, 2000, 1.0)],
                                   "var string, pixel_id int, year int, value double")
    static = spark.createDataFrame([("fc", 1, 9.0), ("fc", 2, 9.0), ("fc", 3, 9.0)],
                                   "var string, pixel_id int, value double")
    out = FE.feature_table(annual, static, ["irr", "et"], ["fc"], crop_fraction="irr")
    assert rows(out, "pixel_id", "irr", "et", "fc") == [(1, 0.02, 3.0, 9.0)]
    ref = spark.createDataFrame([(1,), (2,)], "pixel_id int")
    table = FE.prediction_table(ref, [2000, 2001], annual, static, ["irr", "et"], ["fc"])
    assert rows(table, "pixel_id", "year", "et", "valid") == [
        (1, 2000, 3.0, True), (1, 2001, 0.0, False), (2, 2000, 0.0, False), (2, 2001, 0.0, False)]
