"""Error metrics, histograms and outlier limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.functions.normal import inverse_normal
from aquagrid.functions.numeric import ratio
from aquagrid.operators.joins import hot_join
from aquagrid.operators.ordering import exact_quantiles, row_rank, value_counts


def regression_metrics(df, by=(), actual="actual", predicted="predicted"):
    """RMSE, MAE, R2, NRMSE, NMAE, PBIAS and mean error per group.

    One aggregate: the spread around the mean comes from the population variance, which
    Spark merges stably, so no second pass over the rows is needed. Rows with either value
    missing are left out.
    """
    a, p = F.col(actual), F.col(predicted)
    rows = df.filter(a.isNotNull() & p.isNotNull())
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum((a - p) * (a - p)).alias("_sse"),
        F.sum(F.abs(a - p)).alias("_sae"), F.sum(a - p).alias("_se"),
        F.sum(a).alias("_sum"), F.avg(a).alias("_mean"), F.var_pop(a).alias("_var"))
    rmse, mae = F.sqrt(F.col("_sse") / F.col("n")), F.col("_sae") / F.col("n")
    return sums.filter("n > 0").select(
        *by, "n", rmse.alias("rmse"), mae.alias("mae"),
        (1 - ratio("_sse", F.col("_var") * F.col("n"))).alias("r2"),
        ratio(rmse, "_mean").alias("nrmse"), ratio(mae, "_mean").alias("nmae"),
        (100 * ratio("_se", "_sum")).alias("pbias"), (F.col("_se") / F.col("n")).alias("me"))


def mean_error(df, by=(), actual="actual", predicted="predicted"):
    return df.groupBy(*by).agg(F.avg(F.col(actual) - F.col(predicted)).alias("me"))


def range_metrics(df, edges, actual="actual", predicted="predicted", closed="left"):
    """Metrics per range of the actual value, with the percentage of all rows.

    ``closed='left'`` uses half-open ranges; ``'both'`` counts a value on an inner edge in
    both neighbours.
    """
    ranges = list(zip(edges[:-1], edges[1:]))
    a = F.col(actual)
    hits = [F.when((a >= lo) & ((a <= hi) if closed == "both" else (a < hi)), F.lit(i))
            for i, (lo, hi) in enumerate(ranges)]
    tagged = df.withColumn("_bin", F.explode(F.array_compact(F.array(*hits))))
    total = df.agg(F.count("*")).scalar()
    low = F.array(*[F.lit(float(lo)) for lo, _ in ranges])
    high = F.array(*[F.lit(float(hi)) for _, hi in ranges])
    return regression_metrics(tagged, ["_bin"], actual, predicted).select(
        F.get(low, F.col("_bin")).alias("low"), F.get(high, F.col("_bin")).alias("high"), "n",
        (100.0 * F.col("n") / total).alias("pct_rows"), "rmse", "mae", "nrmse", "nmae")


def residuals(df, actual="actual", predicted="predicted"):
    """Residual and residual over its population standard deviation."""
    gap = F.col(actual) - F.col(predicted)
    spread = df.agg(F.stddev_pop(gap)).scalar()
    return df.withColumns({"residual": gap, "standardised": ratio(gap, spread)})


def histogram(df, value, by=(), bins=30):
    """Counts and density per equal-width bin; the top edge belongs to the last bin. A
    constant column gets a range of width 1 around its value. Only distinct values, with their
    counts, meet the ranges."""
    if by:
        rows = value_counts(df, list(by), value)
        bounds = rows.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                       F.count("*").alias("n"))
        spanned = hot_join(rows, bounds.drop("n"), list(by), counts=bounds)
    else:
        rows = df.filter(F.col(value).isNotNull())
        spanned = rows.select(value, F.lit(1).alias("n"),
                              rows.agg(F.min(value)).scalar().alias("_lo"),
                              rows.agg(F.max(value)).scalar().alias("_hi"))
    flat = F.when(F.col("_lo") == F.col("_hi"), 0.5).otherwise(0.0)
    spanned = spanned.withColumns({"_lo": F.col("_lo") - flat, "_hi": F.col("_hi") + flat})
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1))
    counts = (spanned.groupBy(*by, slot.cast("int").alias("bin"))
              .agg(F.sum("n").alias("n"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi")))
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    joined = counts.join(total, list(by)) if by else counts.withColumn(
        "_all", counts.agg(F.sum("n")).scalar())
    return joined.select(*by, "bin", (F.col("_lo") + F.col("bin") * width).alias("low"),
                         (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"), "n",
                         ratio("n", F.col("_all") * width).alias("density"))


def histogram_2d(df, x, y, bins=300):
    """Non-empty cells of a 2-D histogram over the two columns' own ranges."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def slot(c):
        low, high = rows.agg(F.min(c)).scalar(), rows.agg(F.max(c)).scalar()
        flat = low == high
        span = F.when(flat, 1.0).otherwise(high - low)
        offset = F.col(c) - F.when(flat, low - 0.5).otherwise(low)
        return F.least(F.floor(offset * bins / span), F.lit(bins - 1)).cast("int")

    return rows.groupBy(slot(x).alias("x_bin"), slot(y).alias("y_bin")).agg(
        F.count("*").alias("n"))


def normal_qq(df, value, tie, by=()):
    """Ordered values against normal quantiles at Filliben's plotting positions."""
    ranked = row_rank(df, list(by), value, tie)
    i, n = F.col("rank").cast("double"), F.col("total").cast("double")
    edge = F.pow(F.lit(0.5), 1.0 / n)
    position = (F.when(i == n, edge).when(i == 1, 1.0 - edge)
                .otherwise((i - 0.3175) / (n + 0.365)))
    return ranked.select(*by, tie, value, inverse_normal(position).alias("theoretical"))


def qq_line(points, value, by=()):
    """Least-squares line through the normal Q-Q points: slope, intercept and r."""
    x, y = F.col("theoretical"), F.col(value)
    return points.groupBy(*by).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
        F.corr(y, x).alias("r"))


def _widen_limits(low, high, lower_by, raise_by):
    return low - F.lit(float(lower_by or 0.0)), high + F.lit(float(raise_by or 0.0))


def iqr_limits(df, value, by=(), lower_by=None, raise_by=None):
    """Smallest value at or above Q1 - 1.5 IQR and largest at or below Q3 + 1.5 IQR. The rows
    are shuffled once, to count the distinct values; only those meet the quartiles."""
    counts = value_counts(df, list(by), value)
    q = exact_quantiles(counts, list(by), value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, "n")
    fence = (F.col("q3") - F.col("q1")) * 1.5
    joined = _meet_quantiles(counts, q.drop("n"), by, ["q1", "median", "q3"])
    found = joined.groupBy(*by).agg(
        F.min(F.when(F.col(value) >= F.col("q1") - fence, F.col(value))).alias("low"),
        F.max(F.when(F.col(value) <= F.col("q3") + fence, F.col(value))).alias("high"),
        F.min("median").alias("median"))
    low, high = _widen_limits(F.col("low"), F.col("high"), lower_by, raise_by)
    return found.select(*by, low.alias("low"), high.alias("high"), "median")


def mad_limits(df, value, by=(), k=3.0, lower_by=None, raise_by=None):
    """Median plus and minus k times the median absolute deviation, both from the counts of
    distinct values."""
    counts = value_counts(df, list(by), value)
    centre = exact_quantiles(counts, list(by), value, {"median": 0.5}, "n")
    joined = _meet_quantiles(counts, centre.drop("n"), by, ["median"])
    gaps = joined.select(*by, "median", "n", F.abs(F.col(value) - F.col("median")).alias("_gap"))
    spread = exact_quantiles(gaps, [*by, "median"], "_gap", {"mad": 0.5}, "n")
    low, high = _widen_limits(F.col("median") - k * F.col("mad"),
                              F.col("median") + k * F.col("mad"), lower_by, raise_by)
    return spread.select(*by, low.alias("low"), high.alias("high"), "median")


def _meet_quantiles(counts, quantiles, by, names):
    """Distinct values beside the quantiles of their group."""
    if not by:
        return counts.withColumns({c: quantiles.select(c).scalar() for c in names})
    sizes = counts.groupBy(*by).agg(F.count("*").alias("n"))
    return hot_join(counts, quantiles, list(by), counts=sizes)


def band_shares(df, value, cuts):
    """Percentage of rows at or above each cut but below the next, and below the lowest."""
    cuts = sorted(cuts)
    v = F.col(value)
    tests = [("below_first", v < cuts[0])]
    for i, c in enumerate(cuts):
        upper = v < cuts[i + 1] if i + 1 < len(cuts) else F.lit(True)
        tests.append((f"from_{c:g}", (v >= c) & upper))
    counted = df.filter(v.isNotNull()).agg(
        *[F.count_if(t).alias(n) for n, t in tests], F.count("*").alias("_all"))
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("band"), (100.0 * F.col(n) / F.nullif(
            F.col("_all"), F.lit(0))).alias("pct")) for n, _ in tests])))
