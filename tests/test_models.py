import pytest
from pyspark.sql import functions as F

from aquagrid.operators import features as FE, modeling as L
from aquagrid.plans.modelling import pumping_with_bounds, train_and_score

FEATURES = ["a", "b", "noise"]
FAST = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.4}


@pytest.fixture(scope="module")
def table(spark):
    h = F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0
    g = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000.0
    n = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1000)) / 1000.0
    return spark.range(1500).select(
        "id", (F.col("id") % 300).alias("pixel_id"), (F.col("id") % 300 % 5).alias("state_id"),
        (2000 + F.col("id") / 300).cast("int").alias("year"), h.alias("a"), g.alias("b"),
        n.alias("noise"), (10 * h + F.when(g > 0.5, 3).otherwise(0) + 1).alias("y")).persist()


@pytest.fixture(scope="module")
def model(table):
    return L.fit_trees(table, FEATURES, "y", FAST)


def test_fit_scores_and_saves(spark, table, model, tmp_path):
    fitted, metrics = train_and_score(table, FEATURES, "y", params=FAST)
    got = {r.split: r.r2 for r in metrics.collect()}
    assert got["train"] > 0.9 and got["test"] > 0.85
    L.save_model(fitted, str(tmp_path / "m"))
    from pyspark.ml import PipelineModel
    again = PipelineModel.load(str(tmp_path / "m"))
    assert again.transform(table).agg(F.sum("predicted")).first()[0] == pytest.approx(
        fitted.transform(table).agg(F.sum("predicted")).first()[0])


def test_importance_finds_the_signal(table, model):
    imp = {r.feature: r["mean"] for r in L.importance_ranking(
        L.permutation_importance(model, table, FEATURES, "y", ["id"], repeats=3)).collect()}
    assert imp["a"] > imp["b"] > imp["noise"] and abs(imp["noise"]) < 0.05


def test_shuffled_feature_is_a_permutation(table):
    calls = []

    class Record:
        def transform(self, df):
            calls.append(df)
            return df.withColumn("predicted", F.col("a"))
    L.permutation_importance(Record(), table, ["a"], "y", ["id"], repeats=1)
    shuffled = sorted(r.a for r in calls[0].collect())
    assert shuffled == sorted(r.a for r in table.collect())


def test_partial_dependence_follows_the_function(table, model):
    pd = L.partial_dependence(model, table, FEATURES, ["a", "b"], points=5).toPandas()
    a = pd[pd.feature == "a"].sort_values("point").mean_prediction.tolist()
    assert len(pd) == 10 and a[-1] - a[0] > 6 and a == sorted(a)
    assert pd[pd.feature == "a"].x.max() == table.agg(F.max("a")).first()[0]


def test_attributions_add_up(table, model):
    att = L.attributions(model, table, FEATURES, ["id"], rows=60)
    sums = att.groupBy("id").agg(F.sum("attribution").alias("s"), F.min("base").alias("base"),
                                 F.count("*").alias("k"))
    pred = model.transform(table).select("id", "predicted")
    bad = sums.join(pred, "id").filter("abs(s + base - predicted) > 1e-6 or k <> 3")
    assert sums.count() == 60 and bad.count() == 0


def test_ensemble_bounds_contain_the_prediction(spark, table, model):
    base = {**FAST, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
    models = L.bootstrap_ensemble(table, FEATURES, "y", ["id"], members=2, params=base)
    mask = table.filter("pixel_id < 200").select("id")
    out = pumping_with_bounds(models, model, table.withColumn("valid", F.lit(True)), mask, ["id"])
    assert out.count() == mask.count()
    assert out.filter("low > predicted or high < predicted").count() == 0


def test_search_returns_best_of_trials(table):
    space = {"maxIter": ("int", 1, 3), "stepSize": ("log", 0.1, 0.5)}
    results, best = L.search_trees(table, FEATURES, "y", ["id"], trials=2, folds=2, space=space)
    rows = results.orderBy("loss").collect()
    assert len(rows) == 2 and best["maxIter"] == rows[0].params["maxIter"]


def test_perturbed_settings_stay_in_range():
    for seed in range(30):
        p = L.perturb(L.TUNED, seed)
        assert 5 <= p["maxDepth"] <= 7 and 0.6 <= p["subsamplingRate"] <= 0.9
        assert 0.9 <= p["stepSize"] / L.TUNED["stepSize"] <= 1.1


def test_parts_are_not_broadcast(spark, capsys):
    """They grow with the rows, so a broadcast of them would fill the driver."""
    from checks.model_queries import feature_rows
    from checks.views import Views
    feature_rows(Views(spark, "/root/testdata/sf0.001")).explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_search_fits_folds_only(spark, monkeypatch):
    fitted, fit = [], L.fit_trees
    monkeypatch.setattr(L, "fit_trees", lambda train, *a: fitted.append(train.count()) or fit(train, *a))
    data = spark.range(60).selectExpr("id", "cast(id % 7 as double) as a", "cast(id % 7 * 2 as double) as y")
    space = {"maxIter": ("int", 1, 2), "maxDepth": ("int", 1, 2)}
    results, best = L.search_trees(data, ["a"], "y", ["id"], trials=2, folds=3, space=space)
    assert len(fitted) == 6 and sum(fitted) == 2 * 2 * 60
    assert results.count() == 2 and set(best) == set(space)


def _runs(spark, train_of):
    """Evaluations of a table's rows by a job that makes several fits of it."""
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (seen.add(1), x)[1], "double").asNondeterministic()
    train_of(spark.range(90).selectExpr("id as pixel_id", "2000 as year", "cast(id % 7 as double) as a",
                                        "cast(id % 7 * 2 + 1 as double) as y").withColumn("a", count("a")))
    return seen.value / 90


def test_folds_of_basins_read_the_rows_once(spark):
    basins = spark.range(80).selectExpr("id as pixel_id", "concat('B', id % 4) as basin_code")
    basins = basins.unionByName(basins.filter("pixel_id < 3"))      # a cell listed twice
    got = []

    def scored(df):
        scores = L.leave_one_basin_out(df, basins, ["B0", "B1", "B2"], ["a"], "y",
                                       params={"maxIter": 2, "maxDepth": 2})
        got.extend(scores.groupBy("fold").count().collect())

    assert _runs(spark, scored) == 1
    assert sorted(map(tuple, got)) == [("B0", 21), ("B1", 21), ("B2", 21)]


def test_ensemble_meets_its_draws_once(spark, monkeypatch):
    weights, fit = [], L.fit_trees
    monkeypatch.setattr(L, "fit_trees", lambda train, *a, **k: weights.append(
        {r["a"]: r["w"] for r in train.groupBy("a").agg(F.sum("weight").alias("w")).collect()}) or fit(train, *a, **k))
    data = spark.range(50).selectExpr("id", "cast(id as double) as a", "cast(id * 2 as double) as y")
    L.bootstrap_ensemble(data, ["a"], "y", ["id"], 2, {"maxIter": 1, "maxDepth": 2, "stepSize": 0.3})
    want = FE.bootstrap_weights(data, ["id"], 2).collect()
    assert weights == [{float(r["id"]): float(r["weight"]) for r in want if r["member"] == b} for b in (0, 1)]
    assert all(sum(w.values()) == 50 for w in weights)
