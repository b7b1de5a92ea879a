"""From raw well records to gridded and basin pumping."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from aquagrid.constants import GridSpec
from aquagrid.functions.numeric import null_to_zero, zero_to_null
from aquagrid.functions.units import af_to_mm
from aquagrid.operators import algebra as A, grid as G, records as R, zonal as Z
from aquagrid.operators.polygons import clip_points


@dataclass(frozen=True)
class Balance:
    """Pumping kept where total water / ET lies in [low, high]. Surface water counts only
    with ``surface``, up to ``last_year``."""

    low: float
    high: float
    surface: bool = True
    last_year: int = 2020


@dataclass(frozen=True)
class Range:
    """Pumping (mm) kept inside [lower, upper]."""

    lower: float
    upper: float


# The source pipeline's rule per region; None keeps every value.
REGION_RULES = {"NV": None, "AZ": Range(0.0, 1500.0),
                "CO": Balance(0.7, 1.5, last_year=2019), "KS": Balance(0.7, 1.5, surface=False)}


def well_totals(records, rights, water, value="af"):
    """Cleaned records summed per well and year. Everything after this step works on one
    row per well and year, so a well with very many records costs nothing extra."""
    kept = R.pad_short_ids(R.filter_categories(records, rights, water))
    return kept.groupBy("well_id", "year").agg(F.sum(value).alias(value))


def gridded_pumping(records, registry, grid: GridSpec, rights, water, zones=None, tiles=None,
                    value="af"):
    """``(year, row, col, af, mm)`` from well records: filter, locate, optionally clip to
    irrigation zones, sum per cell, convert to depth."""
    wells = G.points_to_cells(R.latest_registry(registry), grid)
    if zones is not None:
        wells = clip_points(wells, zones, tiles, "well_id")
    # a well off the grid, outside the zones or without coordinates adds nothing to a cell
    placed = well_totals(records, rights, water, value).join(wells, "well_id")
    cells = G.sum_points(placed, ["year", "row", "col"], value)
    return cells.withColumn("mm", af_to_mm(value))


def _kept(df, rule, surface):
    """``df`` with column ``_kept``: the value where the rule lets it stand."""
    df = df.withColumn("_kept", F.col("value"))
    if isinstance(rule, Range):
        return A.range_filter(df, rule.lower, rule.upper, "_kept")
    if rule is None:
        return df
    return A.water_balance_filter(df, "_kept", sw="sw" if surface and rule.surface else None,
                                  low=rule.low, high=rule.high, sw_last_year=rule.last_year)


def training_layer(regions, peff, et, low=None, high=None, surface=None, exclude=None,
                   no_data=None, keys=("year", "row", "col"), rules=None):
    """Regional pumping layers (mm) to one training layer: the plausibility filter per
    region, priority combine, then removal of excluded cells. ``rules`` names each region's
    filter (``Balance``, ``Range`` or None for no filter, as in ``REGION_RULES``); without
    it, ``low`` and ``high`` are the balance limits of all regions."""
    if rules is None:
        rules = dict.fromkeys(regions, Balance(low, high))
    inputs = {"peff": peff, "et": et}
    if surface is not None:
        inputs["sw"] = surface
    # all regions meet the climate layers in one join, and the same cell key serves the
    # combination that follows
    tagged = A.stack([layer.select(*keys, F.lit(i).alias("_rank"), F.lit(name).alias("region"),
                                   "value")
                      for i, (name, layer) in enumerate(regions.items())])
    if no_data is not None:
        tagged = tagged.join(no_data, ["region", "year"], "left_anti")
    checked = tagged.join(A.align(inputs, keys), list(keys), "left").withColumn(
        "_value", F.lit(None))
    for rule in dict.fromkeys(rules[name] for name in regions):
        ruled = F.col("region").isin([name for name in regions if rules[name] == rule])
        checked = _kept(checked, rule, surface is not None).withColumn(
            "_value", F.when(ruled, F.col("_kept")).otherwise(F.col("_value"))).drop("_kept")
    checked = checked.withColumn("value", F.col("_value")).filter("value > 0")
    combined = checked.groupBy(*keys).agg(A.first_by_rank(len(regions)))
    if exclude is None:
        return combined
    return combined.join(exclude.select("row", "col").distinct(), ["row", "col"], "left_anti")


def consumptive_use(pumping, efficiency, keys=("year", "row", "col")):
    return A.product(pumping, efficiency, keys)


def basin_pumping(records, registry, basins, grid: GridSpec, cell_basin, rights, water):
    """Annual pumping per basin from well records, in one plan over all years."""
    cells = gridded_pumping(records, registry, grid, rights, water)
    pixels = cells.join(cell_basin, ["row", "col"]).select(
        "basin_code", "year", null_to_zero(zero_to_null("mm")).alias("pumping_mm"))
    return Z.annual_totals(pixels, basins, ("pumping",))
