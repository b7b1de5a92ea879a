"""Reductions along time on long cell tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.constants import LAYERS
from aquagrid.functions.numeric import ratio, recode


def monthly_reduce(obs, layers=tuple(LAYERS), cell=("cell_id",), var="var", ts="ts",
                   value="value", first_by="ts"):
    """Observations to monthly layers by each layer's own reducer and scale factor.

    ``layers`` lists (name, reducer, scale, first date, end date). Months that do not lie
    wholly inside the layer's dates are skipped, as are variables not listed. The settings
    enter as literals, so no join is needed, and one hash aggregate serves all reducers in
    use. ``first_by`` orders the observations of a cell and month and has no ties.
    """
    def setting(i):
        return recode(var, {row[0]: row[i] for row in layers})

    month = F.trunc(F.to_date(ts), "month")
    offered = ((F.col("_month") >= setting(3).cast("date"))
               & (F.add_months("_month", 1) <= setting(4).cast("date")))
    seen = F.when(F.col(value).isNotNull(), F.col(first_by))
    offers = {"sum": F.sum(value), "mean": F.avg(value), "first": F.min_by(value, seen)}
    used = [r for r in offers if any(row[1] == r for row in layers)]
    reduced = obs.withColumn("_month", month).filter(offered).groupBy(
        var, *cell, "_month").agg(*[offers[r].alias(f"_{r}") for r in used])
    pick = F.coalesce(*[F.when(setting(1) == r, F.col(f"_{r}")) for r in used])
    return reduced.select(var, *cell, F.year("_month").alias("year"),
                          F.month("_month").alias("month"),
                          (pick * setting(2)).alias(value))


def yearly_reduce(monthly, first_month, last_month, keys, how="sum", value="value"):
    pick = {"sum": F.sum, "mean": F.avg}[how](value)
    return (monthly.filter(F.col("month").between(first_month, last_month))
            .groupBy(*keys, "year").agg(pick.alias(value)))


def dated_snapshot(obs, keys, first_day, end_day, ts="ts", value="value"):
    """Average of the samples in [first_day, end_day) of each year; days are 'MM-dd'."""
    day = F.date_format(ts, "MM-dd")
    return (obs.filter((day >= first_day) & (day < end_day))
            .groupBy(*keys, F.year(ts).alias("year")).agg(F.avg(value).alias(value)))


def mean_over_bands(df, keys, value="value"):
    """Mean over the remaining axis (bands, depths) of a long layer."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def mean_of_columns(df, cols, out):
    """Mean over band columns; missing bands are left out."""
    packed = F.filter(F.array(*[F.col(c).cast("double") for c in cols]),
                      lambda x: x.isNotNull())
    total = F.aggregate(packed, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn(out, ratio(total, F.size(packed)))


def _season(monthly, season, keys, season_keys, value, strict):
    bounds = season.select(*season_keys, "start_month", "end_month")
    joined = monthly.join(bounds, list(season_keys), "left")
    inside = F.col("month").between(F.col("start_month"), F.col("end_month"))
    grouped = joined.groupBy(*keys, "year").agg(
        F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0.0)).alias("_sum"),
        F.count(value).alias("_valid"),
        F.min("start_month").alias("_a"), F.min("end_month").alias("_b"),
        F.count(F.when(inside, F.col(value))).alias("_seen"))
    length = F.coalesce(F.greatest(F.col("_b") - F.col("_a") + 1, F.lit(0)), F.lit(0))
    length = F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0).otherwise(length)
    months = length if strict else F.col("_seen")
    ok = (F.col("_valid") == 12) if strict else F.lit(True)
    return grouped.withColumns({"_months": months, "_ok": ok})


def season_sum(monthly, season, keys=("row", "col"), season_keys=None, value="value",
               strict=True):
    """Sum over the months of each cell's growing season, per year.

    A season without months (missing, or start after end) sums to 0. In strict mode a cell
    with any of its twelve months missing is missing for that year; otherwise missing months
    are skipped. ``monthly`` has one row per cell, year and month.
    """
    g = _season(monthly, season, keys, season_keys or keys, value, strict)
    return g.select(*keys, "year", F.when(F.col("_ok"), F.col("_sum")).alias(value))


def season_mean(monthly, season, keys=("row", "col"), season_keys=None, value="value",
                strict=True):
    """As :func:`season_sum`, divided by the number of season months; none gives missing."""
    g = _season(monthly, season, keys, season_keys or keys, value, strict)
    return g.select(*keys, "year",
                    F.when(F.col("_ok"), ratio("_sum", "_months")).alias(value))
