"""Model operators over a fixed scorer, whose results SQL can state in full, and what holds of
every fit: row counts of each split, fold or member, and that a fit beats the mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.operators import features as FE, metrics as M, modeling as L, trees as T
from checks.model_queries import FAST, FEATURES, KEYS, feature_rows
from checks.registry import query, rounded
from checks.stats_queries import _h

AVG_PRICE, DISC, LINES, SIZE, TAX = range(5)
N = T.Node
TREES = [
    N(0, 0, LINES, 2.5, 1, 2, 0, 100), N(0, 1, SIZE, 20.5, 3, 4, 0, 40), N(0, 2, DISC, 0.05123, 5, 6, 0, 60),
    N(0, 3, None, None, -1, -1, 10, 25), N(0, 4, None, None, -1, -1, 20, 15), N(0, 5, None, None, -1, -1, 30, 20),
    N(0, 6, LINES, 4.5, 7, 8, 0, 40), N(0, 7, None, None, -1, -1, 45, 30), N(0, 8, None, None, -1, -1, 60, 10),
    N(1, 0, AVG_PRICE, 30000.5, 1, 2, 0, 100), N(1, 1, TAX, 0.04051, 3, 4, 0, 55),
    N(1, 2, SIZE, 35.5, 5, 6, 0, 45), N(1, 3, None, None, -1, -1, -4, 30), N(1, 4, None, None, -1, -1, 6, 25),
    N(1, 5, None, None, -1, -1, 2, 20), N(1, 6, None, None, -1, -1, 12, 25)]
PATHS = T.leaf_paths(TREES)
SCORER = T.PathScorer(PATHS, FEATURES)

_ROWS = """fr as materialized (select l_partkey as pixel_id, cast(year(l_shipdate) as int) as year,
    avg(l_extendedprice) as avg_price, avg(l_discount) as disc, cast(count(*) as double) as lines,
    cast(p_size as double) as size, avg(l_tax) as tax, sum(l_quantity) as target, p_size % 20 as state_id
    from lineitem join part on p_partkey = l_partkey group by l_partkey, year(l_shipdate), p_size)"""


def _scored(name):
    return f"""(case when {name}lines <= 2.5 then case when {name}size <= 20.5 then 10 else 20 end
      when {name}disc <= 0.05123 then 30 when {name}lines <= 4.5 then 45 else 60 end
    + case when {name}avg_price <= 30000.5 then case when {name}tax <= 0.04051 then -4 else 6 end
      when {name}size <= 35.5 then 2 else 12 end)::double"""


@query("l4_score_fixed_trees", f"""
  with {_ROWS} select pixel_id, year, target as actual, {_scored('')} as predicted from fr""")
def _(v):
    return L.score_table(SCORER, feature_rows(v), "target", KEYS)


@query("l5_predict_fixed_trees", f"""
  with {_ROWS} select pixel_id, year, case when size > 2 and lines > 3 then {_scored('')} end as predicted
  from fr""")
def _(v):
    rows = feature_rows(v)
    return L.predict_cells(SCORER, rows.withColumn("valid", F.col("size") > 2), rows.filter("lines > 3"), KEYS)


def _permuted():
    """Each feature and repeat: rows numbered in hash order take the feature of the row a seeded
    number of places on."""
    taken = ", ".join(f"case when feature = '{f}' then d.{f} else a.{f} end as {f}" for f in FEATURES)
    names = ", ".join(f"('{f}')" for f in FEATURES)
    return f"""
  with {_ROWS}, num as materialized (select *, row_number() over (order by {_h(0, 'pixel_id', 'year')},
      pixel_id, year) - 1 as i, count(*) over () as n from fr),
  trial as (select feature, repeat, 1 + {_h(0, "'shift'", 'feature', 'repeat', digits=15)} % greatest(n - 1, 1)
      as step from (values {names}) f(feature), range(3) r(repeat), (select max(n) as n from num)),
  mixed as (select feature, repeat, a.target, {taken} from trial, num a
      join num d on d.i = (a.i + step) % a.n),
  s as (select feature, repeat, 1 - sum((target - {_scored('')}) ** 2) / (var_pop(target) * count(*)) as r2
      from mixed group by 1, 2),
  b as (select 1 - sum((target - {_scored('')}) ** 2) / (var_pop(target) * count(*)) as r2 from fr)
  select feature, cast(repeat as int) as repeat, round(b.r2 - s.r2, 6) as importance from s, b"""


@query("l12_importance_fixed_trees", _permuted())
def _(v):
    return rounded(L.permutation_importance(SCORER, feature_rows(v), FEATURES, "target", KEYS, 3), 6,
                   "importance")


def _dependence():
    parts = []
    for f in FEATURES:
        others = ", ".join(g for g in FEATURES if g != f)
        parts.append(f"""select '{f}' as feature, cast(p as int) as point, round(x, 6) as x,
      round(avg({_scored('')}), 6) as mean_prediction from (select p, {others}, a + (b - a) * p / 19e0 as {f},
      a + (b - a) * p / 19e0 as x from fr, range(20) g(p),
      (select quantile_cont({f}, 0.05) as a, max({f}) as b from fr)) group by p, x""")
    return f"with {_ROWS} " + " union all ".join(parts)


@query("l13_dependence_fixed_trees", _dependence())
def _(v):
    return rounded(T.tree_partial_dependence(PATHS, feature_rows(v), FEATURES), 6, "x", "mean_prediction")


@query("l13_dependence_any_scorer", _dependence())
def _(v):
    return rounded(L.expanded_dependence(SCORER, feature_rows(v), FEATURES), 6, "x", "mean_prediction")


#: Leaf, value, place on the path, places, feature, bounds and share of each condition.
_LEAVES = """(values
    (0, 10, 0, 2, 'lines', -1e300, 2.5, 0.4), (0, 10, 1, 2, 'size', -1e300, 20.5, 25 / 40e0),
    (1, 20, 0, 2, 'lines', -1e300, 2.5, 0.4), (1, 20, 1, 2, 'size', 20.5, 1e300, 15 / 40e0),
    (2, 30, 0, 2, 'disc', -1e300, 0.05123, 20 / 60e0), (2, 30, 1, 2, 'lines', 2.5, 1e300, 0.6),
    (3, 45, 0, 2, 'disc', 0.05123, 1e300, 40 / 60e0), (3, 45, 1, 2, 'lines', 2.5, 4.5, 0.6 * 30 / 40e0),
    (4, 60, 0, 2, 'disc', 0.05123, 1e300, 40 / 60e0), (4, 60, 1, 2, 'lines', 4.5, 1e300, 0.6 * 10 / 40e0),
    (5, -4, 0, 2, 'avg_price', -1e300, 30000.5, 0.55), (5, -4, 1, 2, 'tax', -1e300, 0.04051, 30 / 55e0),
    (6, 6, 0, 2, 'avg_price', -1e300, 30000.5, 0.55), (6, 6, 1, 2, 'tax', 0.04051, 1e300, 25 / 55e0),
    (7, 2, 0, 2, 'avg_price', 30000.5, 1e300, 0.45), (7, 2, 1, 2, 'size', -1e300, 35.5, 20 / 45e0),
    (8, 12, 0, 2, 'avg_price', 30000.5, 1e300, 0.45), (8, 12, 1, 2, 'size', 35.5, 1e300, 25 / 45e0))"""


@query("l14_attributions_fixed_trees", f"""
  with {_ROWS}, leaf(leaf, value, k, m, feature, low, high, z) as (select * from {_LEAVES}),
  sub as (select f.leaf, f.k, s, f.value * factorial(bit_count(s)) * factorial(f.m - bit_count(s) - 1)
      / factorial(f.m)::double * product(case when j.k <> f.k and (s >> j.k) & 1 = 0 then j.z else 1 end) as coef
    from leaf f, range(4) q(s) join leaf j on true where j.leaf = f.leaf and (s >> f.k) & 1 = 0
      and s < (1 << f.m) group by f.leaf, f.k, s, f.value, f.m),
  long as (unpivot (select pixel_id, year, avg_price, disc, lines, size, tax from fr)
    on avg_price, disc, lines, size, tax into name feature value x),
  met as (select pixel_id, year, leaf, k, l.feature, z, cast(x > low and x <= high as int) as o,
      sum(cast(x > low and x <= high as int) << k) over (partition by pixel_id, year, leaf) as pattern
    from leaf l join long using (feature)),
  phi as (select pixel_id, year, feature, sum((o - z) * coef) as phi
    from met join sub using (leaf, k) where s & pattern = s group by 1, 2, 3),
  base as (select sum(w) as base from (select value * product(z) as w from leaf group by leaf, value))
  select pixel_id, year, feature, round(phi, 6) as attribution, round(base, 6) as base from phi, base""")
def _(v):
    told = T.tree_attributions(PATHS, feature_rows(v), FEATURES, KEYS)
    return rounded(told, 6, "attribution", "base")


def _members(v, *extra):
    """Rows with the predictions of four members as one array."""
    members = F.array(*[F.col("value2") * m for m in (1, 2, 3, 4)]).alias("members")
    return v.cell_year.select("cell_id", "year", members, *extra)


@query("l9_spread_in_rows", """
  select cell_id, year, round(avg(value2 * m / (zone * 0.01e0)), 6) as mean,
    round(stddev_pop(value2 * m / (zone * 0.01e0)), 6) as std
  from cell_year join cell using (cell_id), (values (1), (2), (3), (4)) t(m) group by 1, 2""")
def _(v):
    eff = v.cell.select("cell_id", (F.col("zone") * 0.01).alias("efficiency"))
    return rounded(L.row_spread(_members(v).join(eff, "cell_id"), ["cell_id", "year"], "efficiency"), 6,
                   "mean", "std")


@query("l9_scorers_in_one_scan", f"""
  with {_ROWS}, m as (select pixel_id, year, unnest([{_scored('')}, {_scored('')} * 2, {_scored('')} * 3]) as p
    from fr)
  select pixel_id, year, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std from m group by 1, 2""")
def _(v):
    members = [T.PathScorer([T.Path(p.value * m, p.conditions) for p in PATHS], FEATURES) for m in (1, 2, 3)]
    return rounded(L.row_spread(L.member_columns(members, feature_rows(v), KEYS), KEYS), 6, "mean", "std")


def _fold_rows():
    return f"{_ROWS}, p as (select distinct pixel_id, case when state_id in (3, 1) then 12 else state_id end " \
           "as state_id from fr)"


@query("l1_fit_checks", f"""
  with {_fold_rows()}, r as (select *, row_number() over (partition by state_id order by
      {_h(42, 'pixel_id')}, pixel_id) as r, count(*) over (partition by state_id) as n from p)
  select case when r <= ceil(0.3e0 * n) then 'test' else 'train' end as split, count(*) as n,
    true as beats_mean from r join fr using (pixel_id) group by 1""")
def _(v):
    data = FE.pixel_split(feature_rows(v))
    model = L.fit_trees(data.filter("split = 'train'"), FEATURES, "target", FAST)
    scores = M.regression_metrics(L.score_table(model, data, "target", ["split"]), ["split"])
    return scores.select("split", "n", (F.col("r2") > 0.3).alias("beats_mean"))


@query("l2_search_checks", """
  select cast(trial as int) as trial, true as has_loss, true as best_is_least from range(3) t(trial)""")
def _(v):
    space = {"maxIter": ("int", 1, 3), "maxDepth": ("int", 2, 3), "stepSize": ("log", 0.1, 0.4)}
    results, best = L.search_trees(feature_rows(v), FEATURES, "target", KEYS, trials=3, folds=2, space=space)
    least = results.agg(F.min_by(F.col("params")["maxIter"], "loss")).scalar()
    return results.select("trial", (F.col("loss") > 0).alias("has_loss"),
                          (least == float(best["maxIter"])).alias("best_is_least"))


@query("l3_kfold_checks", f"""
  with {_ROWS} select cast({_h(0, 'pixel_id', 'year')} % 3 as int) as fold, count(*) as n, true as beats_mean
  from fr group by 1""")
def _(v):
    scores = L.kfold_scores(feature_rows(v), FEATURES, "target", KEYS, k=3, params=FAST)
    return scores.select("fold", "n", (F.col("r2") > 0.3).alias("beats_mean"))


@query("l7_held_out_checks", f"""
  with {_ROWS} select r_name as fold, count(*) as n, true as beats_mean from fr
  join cell_basin on cell_id = pixel_id join nation on n_name = basin_code
  join region on r_regionkey = n_regionkey group by 1""")
def _(v):
    names = v.nation.join(v.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("basin_code"), "r_name")
    basins = v.cell_basin.join(names, "basin_code").select(
        F.col("cell_id").alias("pixel_id"), F.col("r_name").alias("basin_code"))
    folds = [r[0] for r in v.region.select("r_name").orderBy("r_name").collect()]
    scores = L.leave_one_basin_out(feature_rows(v), basins, folds, FEATURES, "target", params=FAST)
    return M.regression_metrics(scores, ["fold"]).select("fold", "n", (F.col("r2") > 0.3).alias("beats_mean"))


@query("l8_ensemble_checks", f"""
  with {_ROWS} select pixel_id, year, 3 as members, true as spread_is_known from fr""")
def _(v):
    base = {**FAST, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8"}
    rows = feature_rows(v)
    models = L.bootstrap_ensemble(rows, FEATURES, "target", KEYS, 3, base)
    scored = L.member_columns(models, rows, KEYS)
    spread = L.row_spread(scored.withColumn("size", F.size("members")), [*KEYS, "size"])
    return spread.select(*KEYS, F.col("size").alias("members"), (F.col("std") >= 0).alias("spread_is_known"))
