"""Fitted trees as tables of leaf paths, and what follows from those exactly.

A leaf path is the leaf's value (times the tree's weight) and, for every feature split on the
way, the interval its values must lie in and the share of training rows that took those turns.
From paths alone follow predictions, Shapley values of the path-dependent expectation, and
partial dependence; no rows are mixed, repeated or scored again.

The number of paths is that of the model's leaves and does not grow with the data, so paths
travel with the task. A missing or NaN feature takes the right branch, as NaN does in the trees.
"""

from __future__ import annotations

import math
from collections import namedtuple
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aquagrid.functions.numeric import portable_hash
from aquagrid.operators.ordering import exact_quantiles
from aquagrid.session import ensure_checkpoint_dir, stored

#: ``feature`` is a place in the feature list, None in a leaf; ``cover`` counts training rows.
Node = namedtuple("Node", "tree node feature threshold left right value cover")
#: ``conditions`` are (feature, low, high, share): low < x <= high.
Path = namedtuple("Path", "value conditions")

ROWS = 4_096
TABLE_FEATURES = 10     # paths of more features are evaluated row by row instead of by table


def node_table(model) -> DataFrame:
    """Nodes of a fitted tree pipeline, from its files: tree, weight and the columns of Node."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    folder = f"{ensure_checkpoint_dir(spark)}/model-{uuid4().hex}"
    model.stages[-1].write().save(folder)
    weights = spark.read.parquet(f"{folder}/treesMetadata")
    weights = weights.toDF("tree", "about", "weight").select("tree", "weight")
    nodes = spark.read.parquet(f"{folder}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    return nodes.join(weights, "tree").select(
        "tree", "weight", F.col("id").alias("node"),
        F.when(F.col("leftChild") >= 0, F.col("split.featureIndex")).alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        (F.col("prediction") * F.col("weight")).alias("value"),
        F.col("impurityStats")[0].alias("cover"), F.col("split.numCategories").alias("kinds"))


def fitted_paths(model):
    """Leaf paths of a fitted pipeline of continuous features, in the assembler's order."""
    rows = node_table(model).collect()      # the model itself: trees x nodes
    if any(r["feature"] is not None and r["kinds"] >= 0 for r in rows):
        raise ValueError("paths are intervals: categorical splits have none")
    return leaf_paths([Node(*(r[c] for c in Node._fields)) for r in rows])


def leaf_paths(nodes):
    """Paths of all leaves. Several splits on one feature become one interval."""
    known = {(n.tree, n.node): n for n in nodes}
    children = {(n.tree, c) for n in nodes if n.feature is not None for c in (n.left, n.right)}
    paths = []
    open_ = [(n, {}) for key, n in sorted(known.items()) if key not in children]
    while open_:
        at, held = open_.pop()
        if at.feature is None:
            paths.append(Path(float(at.value), [(f, *held[f]) for f in sorted(held)]))
            continue
        low, high, share = held.get(at.feature, (-math.inf, math.inf, 1.0))
        for child, a, b in ((at.left, low, min(high, at.threshold)),
                            (at.right, max(low, at.threshold), high)):
            node = known[at.tree, child]
            part = share * node.cover / at.cover
            open_.append((node, {**held, at.feature: (a, b, part)}))
    return paths


def _met(x, low, high):
    """Whether each value lies in the interval; NaN goes right at every split."""
    right = ~(x <= low) if low > -math.inf else np.ones(len(x), bool)
    return right & (x <= high) if high < math.inf else right


def shapley_parts(met, shares):
    """Shapley values of the game that multiplies, over a path's features, "the condition is
    met" for known ones and the share for unknown ones. Rows of ``met`` by features."""
    rows, m = met.shape
    out = np.zeros((rows, m))
    weight = [math.factorial(j) * math.factorial(m - 1 - j) / math.factorial(m) for j in range(m)]
    for f in range(m):
        # coefficient j sums the products over all sets of j known features besides f
        sums = np.zeros((rows, m))
        sums[:, 0] = 1.0
        for g in range(m):
            if g != f:
                grown = sums * shares[g]
                grown[:, 1:] += sums[:, :-1] * met[:, [g]]
                sums = grown
        out[:, f] = (met[:, f] - shares[f]) * (sums @ weight)
    return out


class Explainer:
    """Contributions of features to predictions, from leaf paths."""

    def __init__(self, paths, width):
        self.paths, self.width = paths, width
        self.base = math.fsum(p.value * math.prod(c[3] for c in p.conditions) for p in paths)
        self.tables = [self._table(p) for p in paths]

    @staticmethod
    def _table(path):
        m = len(path.conditions)
        if not 0 < m <= TABLE_FEATURES:
            return None
        met = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
        return path.value * shapley_parts(met, [c[3] for c in path.conditions])

    def contributions(self, x):
        out = np.zeros((len(x), self.width))
        for path, table in zip(self.paths, self.tables):
            features = [c[0] for c in path.conditions]
            if not features:
                continue
            met = np.stack([_met(x[:, f], low, high) for f, low, high, _ in path.conditions], axis=1)
            if table is None:
                out[:, features] += path.value * shapley_parts(
                    met.astype(float), [c[3] for c in path.conditions])
            else:
                out[:, features] += table[met @ (1 << np.arange(len(features)))]
        return out


def _numbers(batch, features):
    """Features of a batch as rows by features, missing ones as NaN."""
    return np.stack([batch.column(f).to_numpy(zero_copy_only=False).astype(float)
                     for f in features], axis=1)


def tree_attributions(paths, df: DataFrame, features, keys) -> DataFrame:
    """(keys, feature, attribution, base): exact Shapley values of every row. Those of a row add
    up to its prediction minus ``base``, the mean prediction by training cover."""
    source = df.select(*keys, *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    inputs, names = [f"_x{i}" for i in range(len(features))], list(keys)
    explainer = Explainer(paths, len(features))

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                phi = explainer.contributions(_numbers(batch, inputs))
                ends = np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k) for k in names]
                    + [pa.ListArray.from_arrays(pa.array(ends), pa.array(phi.ravel()))], [*names, "_phi"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:len(names)])
    told = source.mapInArrow(run, f"{fields}, _phi array<double>")
    pairs = F.arrays_zip(F.array(*[F.lit(f) for f in features]).alias("feature"),
                         F.col("_phi").alias("attribution"))
    return told.select(*names, F.inline(pairs), F.lit(explainer.base).alias("base"))


def tree_partial_dependence(paths, df: DataFrame, features, show=None, points=20, low=0.05,
                            high=1.0, share=None, keys=None, seed=0) -> DataFrame:
    """(feature, point, x, mean_prediction), as if every row were scored at every point.

    With one feature fixed at x a row reaches a leaf if x and all its other features meet the
    path. So rows are counted once, by path and the one condition they may miss, and each point
    is a sum over paths of value times count. ``share`` takes a hashed share of the rows
    (``keys`` name them), as a subsample."""
    features, show = list(features), sorted(show or features)
    if share is not None:
        slot = portable_hash(seed, F.lit("dependence"), *keys, digits=15)
        df = df.filter(slot < int(share * 16 ** 15))
    # the counts and both sides of the quantiles must see the same values
    names = [*features, *[f for f in show if f not in features]]
    values = stored(df.select(*[F.col(f).cast("double").alias(f"_x{i}")
                                for i, f in enumerate(names)]))
    inputs = values.columns[:len(features)]
    starts = np.cumsum([0] + [1 + len(p.conditions) for p in paths])

    def run(batches):
        found, rows = np.zeros(starts[-1], np.int64), 0
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                x = _numbers(whole.slice(first, ROWS), inputs)
                rows += len(x)
                for path, at in zip(paths, starts):
                    met = [_met(x[:, f], a, b) for f, a, b, _ in path.conditions]
                    missed = len(met) - np.sum(met, axis=0) if met else np.zeros(len(x))
                    found[at] += (missed == 0).sum()
                    for k, own in enumerate(met, 1):
                        found[at + k] += (missed == ~own).sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(found))), pa.array(np.append([rows], found))], ["slot", "n"])

    counted = values.select(*inputs).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    count = {r["slot"]: r["n"] for r in counted.collect()}       # one row a path and condition
    spark, schema = df.sparkSession, "feature string, point int, x double, mean_prediction double"
    if not count.get(-1):
        return spark.createDataFrame([], schema)
    long = values.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"_x{names.index(f)}").alias("x"))
        for f in show])))
    ends = {r["feature"]: (r["a"], r["b"]) for r in exact_quantiles(
        long, ["feature"], "x", {"a": low, "b": high}).collect()}
    rows = []
    for name in show:
        if name not in ends:
            continue
        a, b = ends[name]
        x = a + (b - a) * np.arange(points) / (points - 1)
        mean = np.zeros(points)
        for path, at in zip(paths, starts):
            own = next((k for k, c in enumerate(path.conditions, 1) if features[c[0]] == name), None)
            reach = np.ones(points, bool) if own is None else _met(x, *path.conditions[own - 1][1:3])
            mean += path.value * count[at + (own or 0)] * reach
        rows += [(name, i, float(x[i]), float(mean[i] / count[-1])) for i in range(points)]
    return spark.createDataFrame(rows, schema)


class PathScorer:
    """A scorer from leaf paths: ``transform`` adds the prediction as one column expression. For
    small models; features that are missing take the right branch."""

    def __init__(self, paths, features, prediction="predicted"):
        self.paths, self.features, self.prediction = paths, list(features), prediction

    def transform(self, df):
        total = F.lit(0.0)
        for path in self.paths:
            met = F.lit(True)
            for f, low, high, _ in path.conditions:
                x = F.coalesce(F.col(self.features[f]).cast("double"), F.lit(float("nan")))
                if low > -math.inf:
                    met = met & ~(x <= low)
                if high < math.inf:
                    met = met & (x <= high)
            total = total + F.when(met, F.lit(path.value)).otherwise(F.lit(0.0))
        return df.withColumn(self.prediction, total)
