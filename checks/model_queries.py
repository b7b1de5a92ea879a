"""Model jobs. Fits have no SQL equivalent; the aggregates over given members do."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.operators import features as FE, metrics as M, modeling as L
from aquagrid.operators.joins import shuffled
from checks.grid_queries import _IN, tall_grid
from checks.registry import query, rounded

FEATURES = ["avg_price", "disc", "lines", "size", "tax"]
FAST = {"maxIter": 5, "maxDepth": 4, "stepSize": 0.3, "minInstancesPerNode": 5}
KEYS = ["pixel_id", "year"]


def feature_rows(v):
    """One row per part and year, with the ordered quantity as target."""
    rows = v.lineitem.groupBy(F.col("l_partkey").alias("pixel_id"),
                              F.year("l_shipdate").alias("year")).agg(
        F.avg("l_extendedprice").alias("avg_price"), F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"), F.count("*").cast("double").alias("lines"),
        F.sum("l_quantity").alias("target"))
    parts = v.part.selectExpr("p_partkey as pixel_id", "cast(p_size as double) as size",
                              "p_size % 20 as state_id")
    return rows.join(shuffled(parts), "pixel_id")     # parts grow with the rows


def _split(v):
    data = FE.pixel_split(feature_rows(v)).persist()
    return data.filter("split = 'train'"), data.filter("split = 'test'")


def _model(v):
    train, test = _split(v)
    return L.fit_trees(train, FEATURES, "target", FAST), train, test


@query("l1_fit_trees")
def _(v):
    model, train, test = _model(v)
    both = train.unionByName(test)
    return M.regression_metrics(L.score_table(model, both, "target", ["split"]), ["split"])


@query("l2_search_trees")
def _(v):
    train, _ = _split(v)
    space = {"maxIter": ("int", 2, 4), "maxDepth": ("int", 2, 4), "stepSize": ("log", 0.1, 0.4)}
    results, _ = L.search_trees(train, FEATURES, "target", KEYS, trials=2, folds=3, space=space)
    return results.select("trial", "loss")


@query("l3_kfold_scores")
def _(v):
    return L.kfold_scores(feature_rows(v), FEATURES, "target", KEYS, k=3, params=FAST)


@query("l4_score_table")
def _(v):
    model, _, test = _model(v)
    return L.score_table(model, test, "target", KEYS)


@query("l5_predict_cells")
def _(v):
    model, train, test = _model(v)
    table = train.unionByName(test).withColumn("valid", F.col("size") > 2)
    return L.predict_cells(model, table, feature_rows(v).filter("lines > 3"), KEYS)


@query("l6_use_to_pumping", f"""
  with {_IN} select year, h.poly_id, cell_id, round(y.value2 / (zone * 0.01e0), 6) as value
  from cell_year y join cell c using (cell_id) join hits h on h.row_i = y.row_i and h.col_i = y.col_i""")
def _(v):
    keys = ["year", "row", "col"]
    use = v.cell_year.select(*keys, F.col("value2").alias("value"))
    eff = v.cell_year.select(*keys, "cell_id").join(v.cell.select("cell_id", "zone"), "cell_id").select(
        *keys, (F.col("zone") * 0.01).alias("value"))
    out = L.use_to_pumping(use, eff, v.edges, tall_grid(v))
    return rounded(out.join(v.cell.select("row", "col", "cell_id"), ["row", "col"]).select(
        "year", "poly_id", "cell_id", "value"), 6, "value")


@query("l7_leave_one_basin_out")
def _(v):
    names = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("basin_code"), "r_name")
    basins = v.cell_basin.join(names, "basin_code").select(
        F.col("cell_id").alias("pixel_id"), F.col("r_name").alias("basin_code"))
    folds = [r[0] for r in v.region.select("r_name").orderBy("r_name").collect()]
    scores = L.leave_one_basin_out(feature_rows(v).persist(), basins, folds, FEATURES, "target",
                                   params=FAST)
    return M.regression_metrics(scores, ["fold"])


def _fast_members(v, members=3):
    base = {**FAST, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
    rows = feature_rows(v).persist()
    return L.bootstrap_ensemble(rows, FEATURES, "target", KEYS, members, base), rows


@query("l8_bootstrap_ensemble")
def _(v):
    models, rows = _fast_members(v)
    return L.row_spread(L.member_columns(models, rows, KEYS), KEYS)


def _members(v):
    cells = v.cell_year.select("cell_id", "year", "value2")
    spread = F.explode(F.sequence(F.lit(1), F.lit(4)))
    return cells.withColumn("member", spread).select(
        "member", "cell_id", "year", (F.col("value2") * F.col("member")).alias("predicted"))


_MEMBERS = """mem as (select cell_id, year, value2 * m as predicted from cell_year,
    (values (1), (2), (3), (4)) t(m))"""


@query("l9_ensemble_spread", f"""
  with {_MEMBERS}, e as (select m.cell_id, m.year, predicted / (zone * 0.01e0) as p from mem m
    join cell using (cell_id))
  select cell_id, year, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std from e group by 1, 2""")
def _(v):
    eff = v.cell_year.select("cell_id", "year").join(v.cell.select(
        "cell_id", (F.col("zone") * 0.01).alias("efficiency")), "cell_id")
    return rounded(L.ensemble_spread(_members(v), ["cell_id", "year"], eff), 6, "mean", "std")


@query("l10_spread_all_years", f"""
  with {_MEMBERS} select cell_id, round(avg(predicted), 6) as mean, round(stddev_pop(predicted), 6)
    as std, round(stddev_pop(predicted) / nullif(avg(predicted), 0), 6) as cv from mem group by 1""")
def _(v):
    return rounded(L.ensemble_spread_all_years(_members(v), ["cell_id"]), 6, "mean", "std", "cv")


@query("l11_confidence_bounds", f"""
  with {_MEMBERS}, s as (select cell_id, year, stddev_pop(predicted) as std from mem group by 1, 2)
  select cell_id, year, value2 as predicted, round(value2 - 1.96e0 * std, 6) as low,
    round(value2 + 1.96e0 * std, 6) as high from cell_year join s using (cell_id, year)""")
def _(v):
    keys = ["cell_id", "year"]
    pred = v.cell_year.select(*keys, F.col("value2").alias("predicted"))
    return rounded(L.confidence_bounds(pred, L.ensemble_spread(_members(v), keys), keys), 6,
                   "low", "high")


@query("l12_permutation_importance")
def _(v):
    model, _, test = _model(v)
    return L.importance_ranking(L.permutation_importance(model, test, FEATURES, "target", KEYS, 5))


@query("l13_partial_dependence")
def _(v):
    model, train, _ = _model(v)
    return L.partial_dependence(model, train, FEATURES)


@query("l14_attributions")
def _(v):
    model, train, _ = _model(v)
    return L.attribution_ranking(L.attributions(model, train, FEATURES, KEYS))
