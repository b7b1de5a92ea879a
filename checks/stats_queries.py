"""Features, splits, metrics and distribution comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.functions import normal as NM
from aquagrid.operators import distributions as D, features as FE, metrics as M
from checks.registry import query, rounded


def _h(seed, *keys, digits=8):
    text = ", ".join(f"cast({k} as varchar)" for k in keys)
    return f"cast('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, {digits}) as bigint)"


def _feature_layers(v):
    cy = v.cell_year.withColumnRenamed("cell_id", "pixel_id")
    long = cy.select("pixel_id", "year", F.inline(F.array(*[
        F.struct(F.lit(n).alias("var"), c.alias("value"))
        for n, c in (("use", F.col("value2")), ("irr_crop_frac", F.col("value2") / 2000))])))
    static = v.cell.select(F.col("cell_id").alias("pixel_id"), F.inline(F.array(
        F.struct(F.lit("elevation").alias("var"), F.col("value")),
        F.struct(F.lit("size").alias("var"), F.col("zone").cast("double").alias("value")))))
    return long, static


@query("f1_feature_table", """
  select y.cell_id as pixel_id, year, value2 as use, round(value2 / 2000, 9) as irr_crop_frac,
    c.value as elevation, zone * 1e0 as size
  from cell_year y join cell c using (cell_id) where c.value is not null and value2 / 2000 >= 0.02e0""")
def _(v):
    annual, static = _feature_layers(v)
    return rounded(FE.feature_table(annual, static, ["use", "irr_crop_frac"],
                                    ["elevation", "size"]), 9, "irr_crop_frac")


@query("f7_prediction_table", """
  select p_partkey as pixel_id, y.year, coalesce(value2, 0) as use, coalesce(c.value, 0) as elevation,
    value2 is not null and c.value is not null as valid
  from part, (values (1995), (1996), (1997), (1998), (1999), (2000), (2001)) y(year) left join cell_year cy
    on cy.cell_id = p_partkey and cy.year = y.year left join cell c on c.cell_id = p_partkey""")
def _(v):
    annual, static = _feature_layers(v)
    ref = v.part.select(F.col("p_partkey").alias("pixel_id"))
    return FE.prediction_table(ref, range(1995, 2002), annual, static, ["use"], ["elevation"])


@query("f2_row_split", f"""
  with r as (select cell_id, year, row_number() over (partition by year order by
      {_h(0, 'cell_id', 'year')}, cell_id) as r, count(*) over (partition by year) as n from cell_year),
  s as (select *, ceil(0.3e0 * n) as t from r)
  select cell_id, year, case when r <= t then 'test' when r <= t + ceil(0.2e0 * (n - t))
    then 'validation' else 'train' end as split from s""")
def _(v):
    cells = v.cell_year.select("cell_id", "year")
    return FE.row_split(cells, ["cell_id", "year"], 0.3, 0.2, ["year"])


@query("f3_pixel_split", f"""
  with p as (select p_partkey as pixel_id, case when p_size % 20 in (3, 1) then 12 else p_size % 20 end
      as state_id from part),
  r as (select *, row_number() over (partition by state_id order by {_h(42, 'pixel_id')}, pixel_id) as r,
    count(*) over (partition by state_id) as n from p)
  select pixel_id, state_id, year, case when r <= ceil(0.3e0 * n) then 'test' else 'train' end as split
  from r join cell_year on cell_id = pixel_id""")
def _(v):
    cells = v.cell_year.select(F.col("cell_id").alias("pixel_id"), "year").join(
        v.part.selectExpr("p_partkey as pixel_id", "p_size % 20 as state_id"), "pixel_id")
    return FE.pixel_split(cells)


@query("f4_fold_sizes", """
  select basin_code as fold, count(*) as n_holdout, (select count(*) from cell_year) - count(*) as n_fit
  from cell_year join cell_basin using (cell_id) group by 1""")
def _(v):
    return FE.fold_sizes(v.cell_year, v.cell_basin, ["cell_id"])


@query("f4_fit_and_holdout_rows", """
  select 'fit' as part, cell_id, year from cell_year join cell_basin using (cell_id)
    where basin_code <> 'NATION_07'
  union all select 'holdout', cell_id, year from cell_year join cell_basin using (cell_id)
    where basin_code = 'NATION_07'""")
def _(v):
    cells = v.cell_year.select("cell_id", "year")
    fit = FE.fit_rows(cells, v.cell_basin, "NATION_07", ["cell_id"])
    held = FE.holdout_rows(cells, v.cell_basin, ["cell_id"]).filter("fold = 'NATION_07'")
    return fit.select(F.lit("fit").alias("part"), "cell_id", "year").unionByName(
        held.select(F.lit("holdout").alias("part"), "cell_id", "year"))


@query("f4_fit_and_holdout_rows_all_folds", """
  select 'fit' as part, fold, cell_id, year from cell_year y
    cross join (select distinct basin_code as fold from cell_basin) k
    where not exists (select 1 from cell_basin b where b.cell_id = y.cell_id and b.basin_code = fold)
  union all select 'holdout', basin_code, cell_id, year from cell_year join cell_basin using (cell_id)""")
def _(v):
    cells = v.cell_year.select("cell_id", "year")
    fit = FE.fit_rows_of_folds(cells, v.cell_basin, ["cell_id"])
    held = FE.holdout_rows(cells, v.cell_basin, ["cell_id"])
    return fit.select(F.lit("fit").alias("part"), "fold", "cell_id", "year").unionByName(
        held.select(F.lit("holdout").alias("part"), "fold", "cell_id", "year"))


@query("f5_scaling_stats", """
  select 'value' as variable, round(avg(value), 4) as mean, round(stddev_pop(value), 4) as std from cell_year
  union all select 'value2', round(avg(value2), 4), round(stddev_pop(value2), 4) from cell_year""")
def _(v):
    return rounded(FE.scaling_stats(v.cell_year, ["value", "value2"]), 4, "mean", "std")


@query("f6_standardise", """
  with s as (select avg(value) m, stddev_pop(value) s, avg(value2) m2, stddev_pop(value2) s2 from cell_year)
  select cell_id, year, round((value - m) / nullif(s, 0), 6) as value,
    round((value2 - m2) / nullif(s2, 0), 6) as value2 from cell_year, s""")
def _(v):
    cells = v.cell_year.select("cell_id", "year", "value", "value2")
    stats = FE.scaling_stats(cells, ["value", "value2"])
    return rounded(FE.standardise(cells, stats, ["value", "value2"]), 6, "value", "value2")


@query("f8_bootstrap_weights", f"""
  with n as (select cell_id, year, row_number() over (order by {_h(7, 'cell_id', 'year')}, cell_id, year) - 1
      as i, count(*) over () as t from cell_year),
  d as (select m as member, {_h(7, "'member'", 'i')} as unused, i, t, m from n, (values (0), (1), (2)) b(m)),
  w as (select member, {_h(7, 'member', 'i', digits=15)} % t as i, count(*) as weight from d group by 1, 2)
  select member, cell_id, year, weight from w join n using (i)""")
def _(v):
    return FE.bootstrap_weights(v.cell_year, ["cell_id", "year"], 3, 7)


@query("f9_sample_rows", f"""
  select cell_id, year, value2 from cell_year order by {_h(5, 'cell_id', 'year')}, cell_id, year limit 200""")
def _(v):
    return FE.sample_rows(v.cell_year.select("cell_id", "year", "value2"), ["cell_id", "year"], 200, 5)


@query("f10_assign_folds", f"""
  select cell_id, year, cast({_h(0, 'cell_id', 'year')} % 10 as int) as fold from cell_year""")
def _(v):
    return FE.assign_folds(v.cell_year.select("cell_id", "year"), ["cell_id", "year"])


_METRICS = """count(*) as n, round(sqrt(sum((actual-predicted)**2) / count(*)), 4) as rmse,
    round(avg(abs(actual-predicted)), 4) as mae,
    round(1 - sum((actual-predicted)**2) / (var_pop(actual) * count(*)), 6) as r2,
    round(sqrt(sum((actual-predicted)**2) / count(*)) / avg(actual), 6) as nrmse,
    round(avg(abs(actual-predicted)) / avg(actual), 6) as nmae,
    round(100 * sum(actual-predicted) / sum(actual), 6) as pbias"""


def _metric_digits(df):
    return rounded(rounded(df, 4, "rmse", "mae"), 6, *[
        c for c in ("r2", "nrmse", "nmae", "pbias") if c in df.columns])


@query("e1_regression_metrics", f"select grp, year, {_METRICS} from pred_actual group by 1, 2")
def _(v):
    return _metric_digits(M.regression_metrics(v.pred_actual, ["grp", "year"]).drop("me"))


@query("e2_mean_error", """
  select grp, round(avg(actual - predicted), 4) as me from pred_actual group by 1""")
def _(v):
    return rounded(M.mean_error(v.pred_actual, ["grp"]), 4, "me")


_RANGES = [0, 10000, 30000, 60000, 120000]


def _range_sql(upper):
    return f"""
  with b as (select * from (values (0e0, 10000e0), (10000e0, 30000e0), (30000e0, 60000e0),
    (60000e0, 120000e0)) t(low, high))
  select low, high, count(*) as n,
    round(100e0 * count(*) / (select count(*) from pred_actual), 6) as pct_rows,
    round(sqrt(sum((actual-predicted)**2) / count(*)), 4) as rmse,
    round(avg(abs(actual-predicted)), 4) as mae,
    round(sqrt(sum((actual-predicted)**2) / count(*)) / avg(actual), 6) as nrmse,
    round(avg(abs(actual-predicted)) / avg(actual), 6) as nmae
  from pred_actual join b on actual >= low and actual {upper} high group by 1, 2"""


@query("e3_range_metrics", _range_sql("<"))
def _(v):
    return rounded(_metric_digits(M.range_metrics(v.pred_actual, _RANGES)), 6, "pct_rows")


@query("e3_range_metrics_closed", _range_sql("<="))
def _(v):
    return rounded(_metric_digits(M.range_metrics(v.pred_actual, _RANGES, closed="both")), 6,
                   "pct_rows")


@query("e4_residuals", """
  select id, actual - predicted as residual, round((actual - predicted) / (select
    stddev_pop(actual - predicted) from pred_actual), 6) as standardised from pred_actual""")
def _(v):
    return rounded(M.residuals(v.pred_actual.select("id", "actual", "predicted")), 6,
                   "standardised").drop("actual", "predicted")


@query("e5_histogram", """
  with b as (select grp, min(actual) as lo, max(actual) as hi, (max(actual) - min(actual)) / 30 as w,
    count(*) as total from pred_actual group by 1)
  select grp, cast(least(floor((actual - lo) / w), 29) as int) as bin, count(*) as n,
    round(any_value(lo + least(floor((actual - lo) / w), 29) * w), 4) as low,
    round(any_value(lo + (least(floor((actual - lo) / w), 29) + 1) * w), 4) as high,
    round(count(*) / any_value(total * w), 12) as density
  from pred_actual join b using (grp) group by 1, 2""")
def _(v):
    return rounded(rounded(M.histogram(v.pred_actual, "actual", ["grp"]), 4, "low", "high"), 12,
                   "density")


def _horner(coefficients, x):
    text = f"({coefficients[0]!r})"
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({c!r}))"
    return text


def _e(coefficients):
    """Exponent form, so that the SQL literals are doubles."""
    return [float_text(c) for c in coefficients]


class float_text(float):
    def __repr__(self):
        return f"{float(self):.17e}"


_QQ = f"""
  with r as (select id, grp, value, row_number() over (partition by grp order by value, id) as i,
    count(*) over (partition by grp) as n from balances),
  p as (select *, case when i = n then pow(0.5e0, 1e0 / n) when i = 1 then 1 - pow(0.5e0, 1e0 / n)
    else (i - 0.3175e0) / (n + 0.365e0) end as p from r),
  q as (select *, p - 0.5e0 as c, (p - 0.5e0) * (p - 0.5e0) as c2, sqrt(-2 * ln(p)) as lo,
    sqrt(-2 * ln(1 - p)) as hi from p)"""
_QQ_Z = f"""case when p < 0.02425e0 then {_horner(_e(NM._TAIL_NUM), 'lo')} / {_horner(_e(NM._TAIL_DEN), 'lo')}
    when p > 1 - 0.02425e0 then -{_horner(_e(NM._TAIL_NUM), 'hi')} / {_horner(_e(NM._TAIL_DEN), 'hi')}
    else c * {_horner(_e(NM._CENTRE_NUM), 'c2')} / {_horner(_e(NM._CENTRE_DEN), 'c2')} end"""


@query("e6_normal_qq", f"{_QQ} select id, grp, value, round({_QQ_Z}, 6) as theoretical from q")
def _(v):
    return rounded(M.normal_qq(v.balances, "value", "id", ["grp"]), 6, "theoretical")


@query("e6_qq_line", f"""{_QQ}, z as (select grp, value, {_QQ_Z} as t from q)
  select grp, round(regr_slope(value, t), 4) as slope, round(regr_intercept(value, t), 4) as intercept,
    round(corr(value, t), 6) as r from z group by 1""")
def _(v):
    points = M.normal_qq(v.balances, "value", "id", ["grp"])
    return rounded(rounded(M.qq_line(points, "value", ["grp"]), 4, "slope", "intercept"), 6, "r")


@query("e7_histogram_2d", """
  with b as (select min(actual) a0, max(actual) a1, min(predicted) p0, max(predicted) p1 from pred_actual)
  select cast(least(floor((actual - a0) * 300 / (a1 - a0)), 299) as int) as x_bin,
    cast(least(floor((predicted - p0) * 300 / (p1 - p0)), 299) as int) as y_bin, count(*) as n
  from pred_actual, b group by 1, 2""")
def _(v):
    return M.histogram_2d(v.pred_actual, "actual", "predicted")


@query("e8_iqr_limits", """
  with q as (select grp, quantile_cont(actual, 0.25) q1, quantile_cont(actual, 0.5) q2,
    quantile_cont(actual, 0.75) q3 from pred_actual group by 1)
  select grp, min(case when actual >= q1 - 1.5e0 * (q3 - q1) then actual end) - 5 as low,
    max(case when actual <= q3 + 1.5e0 * (q3 - q1) then actual end) + 7 as high,
    round(any_value(q2), 4) as median from pred_actual join q using (grp) group by 1""")
def _(v):
    return rounded(M.iqr_limits(v.pred_actual, "actual", ["grp"], 5, 7), 4, "median")


@query("e9_mad_limits", """
  with m as (select grp, median(actual) as m from pred_actual group by 1),
  d as (select grp, any_value(m) as m, median(abs(actual - m)) as mad from pred_actual
    join m using (grp) group by 1)
  select grp, round(m - 3 * mad, 4) as low, round(m + 3 * mad, 4) as high, round(m, 4) as median from d""")
def _(v):
    return rounded(M.mad_limits(v.pred_actual, "actual", ["grp"]), 4, "low", "high", "median")


@query("e10_empirical_cdf", """
  select grp, predicted, round(row_number() over (partition by grp order by predicted)
    / count(*) over (partition by grp), 9) as ecdf from pred_actual""")
def _(v):
    return rounded(D.empirical_cdf(v.pred_actual, "predicted", ["grp"]), 9, "ecdf")


@query("e11_quantile_mapping", """
  with p as (select id, grp, value, row_number() over (partition by grp order by value, id) as i,
    count(*) over (partition by grp) as n from balances),
  o as (select case l_linenumber % 5 when 0 then 'BUILDING' when 1 then 'MACHINERY' when 2 then
      'HOUSEHOLD' when 3 then 'FURNITURE' else 'AUTOMOBILE' end as grp, l_extendedprice as v
    from lineitem),
  r as (select grp, v, row_number() over (partition by grp order by v) as j,
    lead(v) over (partition by grp order by v) as w, count(*) over (partition by grp) as m from o),
  s as (select grp, any_value(m) as m from r group by 1),
  a as (select p.*, i * m / n as x, greatest(least(cast(floor(i * m / n) as bigint), m), 1) as j
    from p join s using (grp))
  select id, grp, value as predicted, round(v + coalesce(greatest(x - j, 0) * (w - v), 0), 4) as corrected
  from a join r using (grp, j)""")
def _(v):
    names = F.expr("case l_linenumber % 5 when 0 then 'BUILDING' when 1 then 'MACHINERY' when 2 "
                   "then 'HOUSEHOLD' when 3 then 'FURNITURE' else 'AUTOMOBILE' end")
    observed = v.lineitem.select(names.alias("grp"), F.col("l_extendedprice").alias("actual"))
    pred = v.balances.withColumnRenamed("value", "predicted")
    return rounded(D.quantile_mapping(pred, observed, ["grp"]), 4, "corrected")


@query("e12_ks_distances", """
  with g as (select distinct grp from balances), pairs as (
    select a.grp as group_a, b.grp as group_b from g a, g b),
  v as (select p.group_a, p.group_b, value, count(case when grp = group_a then 1 end) as na,
    count(case when grp = group_b then 1 end) as nb from balances b
    join pairs p on b.grp = p.group_a or b.grp = p.group_b group by 1, 2, 3),
  c as (select group_a, group_b, sum(na) over w / sum(na) over (partition by group_a, group_b) as fa,
    sum(nb) over w / sum(nb) over (partition by group_a, group_b) as fb from v
    window w as (partition by group_a, group_b order by value))
  select group_a, group_b, round(max(abs(fa - fb)), 3) as distance from c group by 1, 2""")
def _(v):
    names = [r[0] for r in v.balances.select("grp").distinct().orderBy("grp").collect()]
    return D.ks_distances(v.balances, names)


@query("e13_kernel_density", """
  with m as (select grp, count(*) as n, stddev_samp(value) * pow(count(*), -0.2e0) as h,
    min(value) as lo, max(value) as hi from balances group by 1),
  g as (select grp, n, h, cast(i as int) as i, lo - 3 * h + i * (hi - lo + 6 * h) / 49 as x
    from m, range(50) r(i))
  select grp, i, round(any_value(x), 4) as x, round(sum(exp(-0.5e0 * ((x - value) / h) ** 2))
    / any_value(n * h * sqrt(2 * pi())), 10) as density
  from g join balances using (grp) group by 1, 2""")
def _(v):
    return rounded(rounded(D.kernel_density(v.balances, "value", ["grp"], points=50), 4, "x"), 10,
                   "density")


_CORR_COLS = ["value", "value2", "disc"]


def _corr_sql(source, digits):
    parts = [f"select '{a}' as var_a, '{b}' as var_b, "
             + ("1e0" if a == b else f"round(corr({a}, {b}), {digits})") + f" as r from {source}"
             + (" limit 1" if a == b else "") for a in _CORR_COLS for b in _CORR_COLS]
    return " union all ".join(f"({p})" for p in parts)


@query("e14_pearson_matrix", _corr_sql("cell_year", 4))
def _(v):
    return D.correlation_matrix(v.cell_year, _CORR_COLS, "pearson", digits=4)


_RANKED = "with k as (select " + ", ".join(
    f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2e0 as {c}"
    for c in _CORR_COLS) + " from cell_year) "


@query("e14_spearman_matrix", _RANKED + _corr_sql("k", 4))
def _(v):
    return D.correlation_matrix(v.cell_year, _CORR_COLS, "spearman", ["cell_id", "year"], 4)


@query("e14_correlation_strength", _RANKED + f", c as ({_corr_sql('k', 2)}) "
       "select var_a, round(sum(abs(r)) - 1, 6) as total_abs_r from c group by 1")
def _(v):
    matrix = D.correlation_matrix(v.cell_year, _CORR_COLS, "spearman", ["cell_id", "year"])
    return rounded(D.correlation_strength(matrix), 6, "total_abs_r")


@query("e15_band_shares", """
  with t as (select case when value2 < 60 then 'below_first' when value2 < 70 then 'from_60'
    when value2 < 80 then 'from_70' when value2 < 95 then 'from_80' else 'from_95' end as band from cell_year)
  select band, round(100e0 * count(*) / (select count(*) from t), 6) as pct from t group by 1""")
def _(v):
    return rounded(M.band_shares(v.cell_year, "value2", [60, 70, 80, 95]), 6, "pct")
