"""Leaf paths of fitted trees against enumeration over all subsets and plain scoring."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.operators import modeling as L, trees as T

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        x = [rng.choice([0.0, 1.0, 2.0, rng.random() * 4]) for _ in FEATURES]
        rows.append((i, *x, 3 * x[0] + x[1] * x[2] + (x[3] > 1) * 5))
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y double").cache()


@pytest.fixture(scope="module")
def model(table):
    return L.fit_trees(table, FEATURES, "y", {"maxIter": 4, "maxDepth": 3, "stepSize": 0.4})


def value_of(nodes, x, known):
    """Expectation of the trees where only the ``known`` features are given."""
    by_id = {(n.tree, n.node): n for n in nodes}
    def walk(n):
        if n.feature is None:
            return n.value
        left, right = by_id[n.tree, n.left], by_id[n.tree, n.right]
        if n.feature in known:
            return walk(left if x[n.feature] <= n.threshold else right)
        return (left.cover * walk(left) + right.cover * walk(right)) / n.cover
    return sum(walk(by_id[t, 0]) for t in {n.tree for n in nodes})


def enumerated(nodes, x, k):
    out = []
    for f in range(k):
        rest, total = [g for g in range(k) if g != f], 0.0
        for size in range(k):
            weight = math.factorial(size) * math.factorial(k - 1 - size) / math.factorial(k)
            for known in combinations(rest, size):
                total += weight * (value_of(nodes, x, {*known, f}) - value_of(nodes, x, set(known)))
        out.append(total)
    return out


def test_attributions_equal_subset_enumeration(table, model):
    nodes = [T.Node(*(r[c] for c in T.Node._fields)) for r in T.node_table(model).collect()]
    told = L.attributions(model, table, FEATURES, ["id"]).collect()
    assert len(told) == 600 * 4
    got = {(r.id, r.feature): r.attribution for r in told}
    base = {r.base for r in told}
    assert len(base) == 1
    rows = table.orderBy("id").limit(40).collect()
    predicted = {r.id: r.predicted for r in model.transform(table).select("id", "predicted").collect()}
    for r in rows:
        x = [r[f] for f in FEATURES]
        for f, want in zip(FEATURES, enumerated(nodes, x, 4)):
            assert got[r.id, f] == pytest.approx(want, abs=1e-9)
    for i, p in predicted.items():
        assert sum(got[i, f] for f in FEATURES) + next(iter(base)) == pytest.approx(p, abs=1e-9)


def test_long_paths_need_no_table():
    rng = np.random.default_rng(0)
    m = T.TABLE_FEATURES + 2
    path = T.Path(2.0, [(f, 0.2, math.inf, 0.3 + 0.05 * f) for f in range(m)])
    explainer = T.Explainer([path], m)
    assert explainer.tables == [None]
    x = rng.random((50, m))
    x[0], x[1, 3] = 0.9, np.nan
    phi = explainer.contributions(x)
    reached = np.all((x > 0.2) | np.isnan(x), axis=1)
    assert np.allclose(phi.sum(axis=1) + explainer.base, np.where(reached, 2.0, 0.0))


def test_scorer_and_paths_predict_as_the_trees(table, model):
    scored = T.PathScorer(T.fitted_paths(model), FEATURES, "again").transform(model.transform(table))
    assert scored.filter("abs(again - predicted) > 1e-9").count() == 0


def test_dependence_equals_expanded_scoring(table, model):
    fast = {(r.feature, r.point): (r.x, r.mean_prediction)
            for r in L.partial_dependence(model, table, FEATURES, points=7).collect()}
    slow = {(r.feature, r.point): (r.x, r.mean_prediction)
            for r in L.expanded_dependence(model, table, FEATURES, points=7).collect()}
    assert fast.keys() == slow.keys() and len(fast) == 28
    for k in fast:
        assert fast[k] == pytest.approx(slow[k], abs=1e-9)


def test_dependence_of_a_subsample(table, model):
    some = L.partial_dependence(model, table, FEATURES, ["a"], points=3, share=0.8, keys=["id"]).collect()
    whole = L.partial_dependence(model, table, FEATURES, ["a"], points=3).collect()
    assert len(some) == 3 and some != whole
    assert all(abs(s.mean_prediction - w.mean_prediction) < 1 for s, w in zip(some, whole))


def test_members_in_one_scan(spark, table, model):
    other = L.fit_trees(table, FEATURES, "y", {"maxIter": 2, "maxDepth": 2, "stepSize": 0.4})
    scored = L.member_columns([model, other, model], table, ["id"])
    plan = L.row_spread(scored, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Union" not in plan
    rows = L.row_spread(scored, ["id"]).collect()
    long = L.ensemble_spread(L.member_predictions([model, other, model], table, ["id"]), ["id"])
    want = {r.id: (r["mean"], r["std"]) for r in long.collect()}
    assert len(rows) == len(want)
    for r in rows:
        assert (r["mean"], r["std"]) == pytest.approx(want[r.id], abs=1e-9)


def test_empty_table_and_missing_features(table, model):
    none = table.filter("false")
    assert L.attributions(model, none, FEATURES, ["id"]).count() == 0
    assert L.partial_dependence(model, none, FEATURES).count() == 0
    gone = table.limit(3).withColumn("a", F.lit(None).cast("double"))
    sums = L.attributions(model, gone, FEATURES, ["id"]).groupBy("id").agg(F.count("attribution").alias("n"))
    assert [r.n for r in sums.collect()] == [4, 4, 4]


def test_dependence_of_values_that_change_when_computed_again(spark):
    """As the last bits of a mean of doubles do, which depend on the order of the rows."""
    noise = F.udf(lambda: random.random() * 1e-9, "double").asNondeterministic()
    names = [f"f{i}" for i in range(8)]
    shaky = spark.range(4000).select(*[(F.lit(0.05) + noise()).alias(f) for f in names])
    paths = [T.Path(1.0, [(0, -math.inf, 0.06, 0.5)]), T.Path(2.0, [(0, 0.06, math.inf, 0.5)])]
    scorer = T.PathScorer(paths, names)
    for told in (T.tree_partial_dependence(paths, shaky, names), L.expanded_dependence(scorer, shaky, names)):
        found = told.collect()
        assert len(found) == 160 and all(abs(r["x"] - 0.05) < 1e-8 for r in found)
        assert all(abs(r["mean_prediction"] - 1.0) < 1e-12 for r in found)
