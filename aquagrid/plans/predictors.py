"""From monthly layers to annual predictors."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid.operators import algebra as A, temporal as T


def season_predictors(monthly, season, sums, means, keys=("row", "col"), season_keys=None):
    """Growing-season layers, long by ``var``: sums for some variables, means for others.

    All variables of one kind go through one aggregate, keyed by variable as well as cell.
    """
    by = ["var", *keys]
    season_keys = list(season_keys or keys)
    parts = []
    if sums:
        rows = monthly.filter(F.col("var").isin(list(sums)))
        parts.append(T.season_sum(rows, season, by, season_keys))
    if means:
        rows = monthly.filter(F.col("var").isin(list(means)))
        parts.append(T.season_mean(rows, season, by, season_keys))
    return A.stack(parts)


def efficiency_layer(unit_year, unit_cells, unit="unit_id", last_year=2020, carry_to=2023):
    """Irrigation efficiency per cell and year from unit records: zeros and gaps filled with
    the unit's mean, the last year carried forward, then burned by cell."""
    from aquagrid.operators.joins import hot_join
    from aquagrid.operators.records import fill_with_unit_mean
    filled = fill_with_unit_mean(unit_year, unit, "value", last_year, carry_to)
    return hot_join(unit_cells, filled, [unit]).filter(F.col("value") != 0).select(
        "row", "col", "year", "value")
