"""Distribution comparisons: ECDF, quantile mapping, KS distance, density, correlation."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import functions as F

from aquagrid.functions.numeric import ratio
from aquagrid.operators.joins import HOT_MIN_ROWS, hot_join
from aquagrid.operators.ordering import (
    counted, range_bounds, repeat_rows, row_rank, running_totals, value_counts)
from aquagrid.session import stored


def empirical_cdf(df, value, by=()):
    """(value, ecdf) with ecdf = i/n over the sorted non-missing values, one row per value
    as often as it occurs. Equal values are interchangeable, so they are ranked once as a
    run and expanded afterwards."""
    runs = counted(df, list(by), value)
    rows = repeat_rows(runs, "n", "_i")
    return rows.select(*by, value,
                       ((F.col("below_n") + F.col("_i")) / F.col("total_n")).alias("ecdf"))


def quantile_mapping(pred, observed, by=(), value="predicted", tie="id", obs_value="actual",
                     out="corrected"):
    """Give predictions the distribution of the observations.

    A prediction of rank i of n sits at quantile i/n; the result is the linear interpolation
    of the observed values between their quantiles j/m, held at the ends. The bracket is found
    by an equi-join on the observed rank, not by a range search. Missing predictions stay.
    """
    ranked = row_rank(pred, list(by), value, tie, "_i", "_n")
    runs = counted(observed, list(by), obs_value, following="_next")
    steps = repeat_rows(runs, "n", "_k")
    bracket = steps.select(
        *by, (F.col("below_n") + F.col("_k")).alias("_j"), F.col(obs_value).alias("_v"),
        F.when(F.col("_k") < F.col("n"), F.col(obs_value)).otherwise(F.col("_next")).alias("_w"))
    sizes = observed.filter(F.col(obs_value).isNotNull()).groupBy(*by).agg(
        F.count("*").alias("_m"))
    group_counts = pred.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"))
    at = (hot_join(ranked, sizes, list(by), "left", counts=group_counts) if by else
          ranked.withColumn("_m", sizes.select("_m").scalar()))
    place = F.col("_i") * F.col("_m") / F.col("_n")
    at = at.withColumns({"_p": place, "_j": F.greatest(
        F.least(F.floor(place), F.col("_m")), F.lit(1)).cast("bigint")})
    # an observed rank serves n/m predictions: the crowded ones follow from the group sizes
    both = (group_counts.join(sizes, list(by)) if by else
            group_counts.withColumn("_m", sizes.select("_m").scalar()))
    crowded = both.filter(F.col("n") > F.col("_m") * HOT_MIN_ROWS).select(
        *by, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))).alias("_j"),
        F.ceil(F.col("n") / F.col("_m")).alias("n"))
    met = hot_join(at, bracket, [*by, "_j"], "left", salt_on=[tie], counts=crowded)
    part = F.greatest(F.col("_p") - F.col("_j"), F.lit(0.0))
    mapped = met.select(*pred.columns, (F.col("_v") + F.coalesce(
        part * (F.col("_w") - F.col("_v")), F.lit(0.0))).alias(out))
    blank = pred.filter(F.col(value).isNull()).withColumn(out, F.lit(None).cast("double"))
    return mapped.unionByName(blank)


def ks_distances(df, groups, group="grp", value="value", digits=3):
    """Two-sample Kolmogorov-Smirnov distance of every pair of the named groups.

    One row per distinct value carries the counts of all groups; running counts give all
    distribution functions at once and each pair is one ``max``. No pair repeats the values.
    """
    slot = {g: f"c{i}" for i, g in enumerate(groups)}
    counts = (df.filter(F.col(value).isNotNull() & F.col(group).isin(list(groups)))
              .groupBy(value).agg(*[F.count_if(F.col(group) == g).alias(c)
                                    for g, c in slot.items()]))
    run = running_totals(counts, [], value, list(slot.values()), bounds=range_bounds(df, value))

    def cdf(g):
        c = slot[g]
        return ratio(F.col(f"below_{c}") + F.col(c), f"total_{c}")

    pairs = list(combinations(groups, 2))
    gaps = run.agg(*[F.max(F.abs(cdf(a) - cdf(b))).alias(f"d{i}")
                     for i, (a, b) in enumerate(pairs)])
    rows = []
    for i, (a, b) in enumerate(pairs):
        for left, right in ((a, b), (b, a)):
            rows.append(F.struct(F.lit(left).alias("group_a"), F.lit(right).alias("group_b"),
                                 F.round(F.col(f"d{i}"), digits).alias("distance")))
    rows += [F.struct(F.lit(g).alias("group_a"), F.lit(g).alias("group_b"),
                      F.lit(0.0).alias("distance")) for g in groups]
    return gaps.select(F.inline(F.array(*rows)))


def kernel_density(df, value, by, points=200, cut=3.0):
    """Gaussian kernel density per group on a grid of ``points`` reaching ``cut`` bandwidths
    past the data, with Scott's bandwidth.

    Equal values are counted first. Each distinct value adds its term to every grid point
    and the terms are summed before the shuffle, which carries at most ``points`` rows per
    task and group.
    """
    counts = value_counts(df, list(by), value)
    rows = df.filter(F.col(value).isNotNull())
    moments = rows.groupBy(*by).agg(
        F.count("*").alias("_n"), F.stddev_samp(value).alias("_s"),
        F.min(value).alias("_min"), F.max(value).alias("_max"))
    width = F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    grid = moments.filter("_s > 0").select(
        *by, "_n", width.alias("_h"), (F.col("_min") - cut * width).alias("_from"),
        ((F.col("_max") - F.col("_min") + 2 * cut * width) / (points - 1)).alias("_step"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"))  # an upper bound serves here
    joined = hot_join(counts, grid, list(by), counts=sizes)
    spread = joined.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_from") + F.col("i") * F.col("_step")
    z = (x - F.col(value)) / F.col("_h")
    terms = spread.groupBy(*by, "i").agg(
        F.sum(F.col("n") * F.exp(-0.5 * z * z)).alias("_sum"), F.min(x).alias("x"),
        F.min(F.col("_n") * F.col("_h")).alias("_nh"))
    norm = math.sqrt(2 * math.pi)
    return terms.select(*by, "i", "x", (F.col("_sum") / (F.col("_nh") * norm)).alias("density"))


def average_ranks(df, keys, cols):
    """Each column replaced by its rank, ties sharing the mean of their ranks."""
    entries = F.array(*[F.struct(F.lit(c).alias("_var"), F.col(c).cast("double").alias("_x"))
                        for c in cols])
    # a value is looked up by equality, so it must not change when it is computed again
    long = stored(df.select(*keys, *cols)).select(*keys, F.inline(entries))
    ranks = counted(long, ["_var"], "_x").select(
        "_var", "_x", (F.col("below_n") + (F.col("n") + 1) / 2.0).alias("_rank"),
        F.col("n"))
    ranked = hot_join(long, ranks.drop("n"), ["_var", "_x"], "left", salt_on=list(keys),
                      counts=value_counts(long, ["_var"], "_x"))
    return ranked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_var") == c, F.col("_rank"))).alias(c) for c in cols])


def correlation_matrix(df, cols, method="spearman", keys=None, digits=2):
    """(var_a, var_b, r) for all pairs, rounded; Spearman needs ``keys`` that identify rows.
    All coefficients come from one aggregate over complete rows."""
    data = df.na.drop(subset=list(cols))
    if method == "spearman":
        data = average_ranks(data, list(keys), cols)
    pairs = list(combinations(cols, 2))
    one = data.agg(*[F.round(F.corr(a, b), digits).alias(f"r{i}")
                     for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(c).alias("var_a"), F.lit(c).alias("var_b"), F.lit(1.0).alias("r"))
            for c in cols]
    for i, (a, b) in enumerate(pairs):
        for left, right in ((a, b), (b, a)):
            rows.append(F.struct(F.lit(left).alias("var_a"), F.lit(right).alias("var_b"),
                                 F.col(f"r{i}").alias("r")))
    return one.select(F.inline(F.array(*rows)))


def correlation_strength(matrix):
    """Sum of |r| with the other variables, per variable."""
    return matrix.groupBy("var_a").agg((F.sum(F.abs("r")) - 1).alias("total_abs_r"))
