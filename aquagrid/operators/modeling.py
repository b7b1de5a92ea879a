"""Model jobs on feature tables: fit, search, score, predict, explain, bound."""

from __future__ import annotations

import math
import random
import time
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from aquagrid.functions.numeric import hash_slot, portable_hash, ratio
from aquagrid.operators.algebra import blank_unmasked, quotient
from aquagrid.operators.features import (
    assign_folds, bootstrap_weights, fit_rows_of_basin, holdout_rows_of_basin, sample_rows,
    with_basins)
from aquagrid.operators.metrics import regression_metrics
from aquagrid.operators.ordering import exact_quantiles, hash_rank
from aquagrid.operators.polygons import clip_cells
from aquagrid.operators.trees import fitted_paths, tree_attributions, tree_partial_dependence
from aquagrid.session import stored

# Tuned tree settings that have a counterpart in Spark ML.
TUNED = {"maxIter": 400, "maxDepth": 6, "stepSize": 0.019988466711388122,
         "subsamplingRate": 0.6424569150291416, "minInstancesPerNode": 90,
         "featureSubsetStrategy": "0.6594527779108277"}

SEARCH_SPACE = {"maxIter": ("step", 200, 400, 25), "maxDepth": ("int", 4, 8),
                "stepSize": ("log", 0.005, 0.02), "subsamplingRate": ("real", 0.5, 0.8),
                "minInstancesPerNode": ("step", 50, 100, 5)}


def tree_pipeline(features, target, params=None, weight=None, seed=42):
    """Assembler over the sorted feature names, then boosted regression trees."""
    assembler = VectorAssembler(inputCols=sorted(features), outputCol="features")
    trees = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="predicted",
                         seed=seed, **(TUNED if params is None else params))
    if weight is not None:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[assembler, trees])


def fit_trees(train, features, target, params=None, weight=None, seed=42):
    keep = [*sorted(features), target, *([weight] if weight else [])]
    return tree_pipeline(features, target, params, weight, seed).fit(train.select(*keep))


def save_model(model, path):
    model.write().overwrite().save(path)


def score_table(model, df, target, keep=()):
    """(actual, predicted) rows, with any columns to keep."""
    return model.transform(df).select(*keep, F.col(target).alias("actual"), "predicted")


def _draw(rng, rule):
    kind, low, high = rule[0], rule[1], rule[2]
    if kind == "step":
        return low + rule[3] * rng.randint(0, (high - low) // rule[3])
    if kind == "int":
        return rng.randint(low, high)
    if kind == "log":
        return math.exp(rng.uniform(math.log(low), math.log(high)))
    return rng.uniform(low, high)


def search_trees(train, features, target, keys, trials=10, folds=5, space=None, seed=0):
    """Seeded random search for the settings with the lowest k-fold RMSE.

    Folds are a hash column, so every trial sees the same folds. Returns the results table
    (trial, loss, params, run_time) and the best settings. The rows are stored once; fits run one
    after the other, as each holds its binned rows, and only those of the folds: no model of all
    rows is asked for.
    """
    rng = random.Random(seed)
    space = space or SEARCH_SPACE
    data = stored(assign_folds(train, keys, folds, seed, "_fold").select(
        *sorted(features), target, "_fold"))
    rmse = RegressionEvaluator(predictionCol="predicted", labelCol=target, metricName="rmse")
    rows = []
    for trial in range(trials):
        params = {name: _draw(rng, rule) for name, rule in space.items()}
        started = time.time()
        losses = []
        for fold in range(folds):
            model = fit_trees(data.filter(F.col("_fold") != fold), features, target, params)
            losses.append(rmse.evaluate(model.transform(data.filter(F.col("_fold") == fold))))
        rows.append((trial, float(sum(losses) / folds), {k: float(v) for k, v in params.items()},
                     time.time() - started))
    results = train.sparkSession.createDataFrame(
        rows, "trial int, loss double, params map<string,double>, run_time double")
    best = min(rows, key=lambda r: r[1])[2]
    whole = {k: int(v) if space[k][0] in ("step", "int") else v for k, v in best.items()}
    return results, whole


def kfold_scores(df, features, target, keys, k=10, params=None, seed=0):
    """R2 and RMSE per fold: k fits, then one aggregate over all held-out predictions."""
    data = assign_folds(df, keys, k, seed, "fold").persist()
    parts = []
    for fold in range(k):
        model = fit_trees(data.filter(F.col("fold") != fold), features, target, params)
        parts.append(score_table(model, data.filter(F.col("fold") == fold), target, ["fold"]))
    return regression_metrics(reduce(lambda a, b: a.unionByName(b), parts), ["fold"]).select(
        "fold", "n", "r2", "rmse")


def predict_cells(model, table, mask, keys=("pixel_id", "year"), valid="valid"):
    """Predictions for all cells and years in one pass; cells outside the mask, or with
    inputs missing, come back missing."""
    scored = model.transform(table).withColumn(
        "predicted", F.when(F.col(valid), F.col("predicted"))).select(*keys, "predicted")
    return blank_unmasked(scored, mask, keys)


def use_to_pumping(use, efficiency, edges, grid, keys=("year", "row", "col"), value="value"):
    """Consumptive use over irrigation efficiency, clipped to the region polygons."""
    pumping = quotient(use, efficiency, keys, value)
    return clip_cells(pumping, edges, grid)


def leave_one_basin_out(df, cell_basin, basins, features, target, cell=("pixel_id",),
                        basin="basin_code", params=None, keep=("year",)):
    """Predictions of each basin from a model that never saw it.

    One fit per basin (a short configured list); the scores of all basins are one table,
    limited to rows whose actual and predicted values are both positive. Rows meet their basins
    once and are stored; the fits, which read their rows several times, read files.
    """
    kept = df.select(*dict.fromkeys([*cell, *keep, *features, target]))
    rows = stored(with_basins(kept, cell_basin, cell, basin))
    parts = []
    for code in basins:
        model = fit_trees(fit_rows_of_basin(rows, code), features, target, params)
        parts.append(score_table(model, holdout_rows_of_basin(rows, code), target,
                                 ["fold", *cell, *keep]))
    return reduce(lambda a, b: a.unionByName(b), parts).filter("actual > 0 and predicted > 0")


def perturb(params, seed):
    """Slightly different settings for one ensemble member."""
    rng = random.Random(seed)
    out = dict(params)
    out["maxDepth"] = max(1, params["maxDepth"] + rng.randint(-1, 1))
    out["stepSize"] = params["stepSize"] * rng.uniform(0.9, 1.1)
    out["subsamplingRate"] = rng.uniform(0.6, 0.9)
    out["featureSubsetStrategy"] = str(rng.uniform(0.6, 0.9))
    return out


def bootstrap_ensemble(df, features, target, keys, members=100, params=None, seed=0):
    """One model per bootstrap sample; a sample enters as draw counts in the weight column. Rows
    meet the draw counts of all members once and are stored; every fit reads files."""
    weights = bootstrap_weights(df, keys, members, seed).groupBy(*keys).agg(
        F.collect_list(F.struct("member", "weight")).alias("_draws"))   # one entry a member
    kept = df.select(*dict.fromkeys([*keys, *features, target]))
    data = stored(kept.join(weights, list(keys)).select(*features, target, "_draws"))
    models = []
    for b in range(members):
        own = F.filter("_draws", lambda d: d["member"] == b)    # noqa: B023 (used at once)
        drawn = data.withColumn("weight", F.aggregate(
            own, F.lit(0.0), lambda t, d: t + d["weight"])).filter("weight > 0")
        models.append(fit_trees(drawn,
                                features, target, perturb(params or TUNED, seed + b),
                                weight="weight", seed=seed + b))
    return models


def member_columns(models, table, keys):
    """One row for each row of ``table``: keys and ``members``, the predictions of all models as
    one array. The models are steps of one projection, so the table is read once."""
    scored = table
    for i, m in enumerate(models):
        scored = m.transform(scored).withColumnRenamed("predicted", f"_m{i}").drop("features")
    return scored.select(*keys, F.array(*[f"_m{i}" for i in range(len(models))]).alias("members"))


def member_predictions(models, table, keys):
    """(member, keys, predicted) of all members, from one scan."""
    return member_columns(models, table, keys).select(
        F.posexplode("members").alias("member", "predicted"), *keys).select(
        "member", *keys, "predicted")


def row_spread(scored, keys, efficiency=None, members="members"):
    """Mean and population std of the members in each row's array, without a shuffle. An
    ``efficiency`` column divides them first, as the point prediction is; zero gives missing."""
    values = F.col(members)
    if efficiency is not None:
        values = F.transform(values, lambda x: x / F.nullif(F.col(efficiency), F.lit(0.0)))
    values = F.filter(values, lambda x: x.isNotNull())
    count = F.nullif(F.size(values), F.lit(0))
    mean = F.aggregate(values, F.lit(0.0), lambda t, x: t + x) / count
    away = scored.select("*", values.alias("_v"), mean.alias("mean"), count.alias("_n"))
    spread = F.aggregate("_v", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean")))
    return away.select(*keys, "mean", F.sqrt(spread / F.col("_n")).alias("std"))


def ensemble_spread(members, keys, efficiency=None, eff="efficiency", value="predicted"):
    """Mean and population std over members per cell and year; with an efficiency layer the
    members are divided by it first, as the point prediction is."""
    if efficiency is not None:
        members = members.join(efficiency.select(*keys, eff), list(keys)).withColumn(
            value, ratio(value, eff))
    return members.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def ensemble_spread_all_years(members, cell, value="predicted"):
    """Mean, std and coefficient of variation per cell over all members and years."""
    agg = members.groupBy(*cell).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return agg.withColumn("cv", ratio("std", "mean"))


def confidence_bounds(pred, spread, keys, value="predicted", z=1.96):
    """Lower and upper bound where prediction and spread both exist."""
    both = pred.select(*keys, value).join(spread.select(*keys, "std"), list(keys))
    both = both.filter(F.col(value).isNotNull() & F.col("std").isNotNull())
    return both.select(*keys, value, (F.col(value) - z * F.col("std")).alias("low"),
                       (F.col(value) + z * F.col("std")).alias("high"))


def permutation_importance(model, df, features, target, keys, repeats=30, seed=0):
    """Drop in R2 when one feature is shuffled, per feature and repeat.

    Rows are numbered once in hash order. A shuffle takes the value of the row a seeded
    number of places further round that order, which is a permutation and needs one equi-join
    on the number for all features and repeats. All shuffled copies are scored by one
    ``transform`` and one aggregate.
    """
    features = sorted(features)
    hashed = df.select(*keys, *features, target).withColumn("_h", portable_hash(seed, *keys))
    numbered = hash_rank(hashed, [], "_h", list(keys), "_r", "_n").withColumn(
        "_i", F.col("_r") - 1)
    trial = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"))
                                for f in features for r in range(repeats)]))
    tried = numbered.withColumn("_t", trial).select(
        *features, target, "_i", "_n", "_t.feature", "_t.repeat")
    step = 1 + hash_slot(portable_hash(seed, F.lit("shift"), "feature", "repeat", digits=15),
                         F.greatest(F.col("_n") - 1, F.lit(1)))
    donor = hash_slot(F.col("_i") + step, F.col("_n"))
    values = numbered.select(F.col("_i").alias("_j"), F.create_map(*[
        x for f in features for x in (F.lit(f), F.col(f).cast("double"))]).alias("_values"))
    mixed = tried.withColumn("_j", donor).join(values, "_j")
    swapped = mixed.select(target, "feature", "repeat", *[
        F.when(F.col("feature") == f, F.col("_values")[f]).otherwise(F.col(f)).alias(f)
        for f in features])
    shuffled = regression_metrics(score_table(model, swapped, target, ["feature", "repeat"]),
                                  ["feature", "repeat"])
    base = regression_metrics(score_table(model, df, target)).select("r2").scalar()
    return shuffled.select("feature", "repeat", (base - F.col("r2")).alias("importance"))


def importance_ranking(importances):
    return importances.groupBy("feature").agg(
        F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))


def partial_dependence(model, df, features, show=None, points=20, low=0.05, high=1.0,
                       share=None, keys=None, seed=0):
    """Mean prediction of fitted trees with one feature fixed at each of ``points`` values
    between two of its percentiles, from one count of rows by leaf path. ``share`` takes a
    hashed share of the rows, named by ``keys``."""
    return tree_partial_dependence(fitted_paths(model), df, sorted(features), show, points, low,
                                   high, share, keys, seed)


def expanded_dependence(model, df, features, show=None, points=20, low=0.05, high=1.0):
    """Partial dependence of any scorer: each row is expanded over features and points and
    scored in one pass; the grid of each feature is a one-row lookup."""
    features = sorted(features)
    show = sorted(show or features)
    df = stored(df.select(*{*features, *show}))      # the quantiles read it more than once
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in show])))
    ends = exact_quantiles(long, ["feature"], "x", {"a": low, "b": high})
    table = ends.agg(F.map_from_entries(F.collect_list(
        F.struct("feature", F.struct("a", "b")))).alias("m")).scalar()  # one entry per feature
    trial = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(i).alias("point"))
                                for f in show for i in range(points)]))
    tried = df.select(*features).withColumn("_t", trial).select(
        *features, "_t.feature", "_t.point").withColumn("_e", table[F.col("feature")])
    x = F.col("_e.a") + (F.col("_e.b") - F.col("_e.a")) * F.col("point") / (points - 1)
    fixed = tried.withColumn("x", x).select("feature", "point", "x", *[
        F.when(F.col("feature") == f, F.col("x")).otherwise(F.col(f)).alias(f)
        for f in features])
    return model.transform(fixed).groupBy("feature", "point").agg(
        F.min("x").alias("x"), F.avg("predicted").alias("mean_prediction"))


def attributions(model, df, features, keys, rows=None, seed=43):
    """Contribution of each feature to each row's prediction: exact Shapley values of the fitted
    trees' path-dependent expectation. Those of a row add up to its prediction minus ``base``.

    ``rows`` explains a sample of that many rows instead of all.
    """
    features = sorted(features)
    sample = df.select(*keys, *features)
    if rows is not None:
        sample = sample_rows(sample, keys, rows, seed)
    return tree_attributions(fitted_paths(model), sample, features, keys)


def attribution_ranking(table):
    return table.groupBy("feature").agg(F.avg(F.abs("attribution")).alias("mean_abs"))
