"""Basin summaries of cell layers. One plan covers all basins and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.constants import GridSpec
from aquagrid.functions.numeric import null_to_zero, total_or_zero, zero_to_null
from aquagrid.functions.units import af_to_m3, af_to_mean_mm, m3_to_af, mm_to_m3
from aquagrid.operators.algebra import align
from aquagrid.operators.grid import with_centres
from aquagrid.operators.joins import hot_join
from aquagrid.operators.polygons import cells_in_polygons


def clip_to_basins(layer, edges, grid: GridSpec, basin="basin_code"):
    """The layer's cells with the basins they lie in; ``edges`` is keyed by basin."""
    return layer.join(cells_in_polygons(edges, grid, basin), ["row", "col"])


def compare_pixels(predicted, actual, cell_basin, keys=("row", "col"), basin="basin_code",
                   grid: GridSpec | None = None, pred_cap=C.MAX_PREDICTED_MM, by=()):
    """Predicted and actual per basin, year and cell; missing reads as 0, and predictions
    above the cap are set to 0. ``by`` are further columns of both layers, such as a run."""
    both = align({"predicted": predicted, "actual": actual}, [*keys, "year", *by],
                 partition_by=keys)
    table = both.join(cell_basin.select(*keys, basin), list(keys))
    pred = null_to_zero("predicted")
    table = table.select(
        basin, "year", *by, *keys, F.when(pred > pred_cap, F.lit(0.0)).otherwise(pred)
        .alias("pred_pumping_mm"), null_to_zero("actual").alias("actual_pumping_mm"))
    return table if grid is None else with_centres(table, grid)


def annual_totals(pixels, basins, names=("pred_pumping", "actual_pumping"),
                  basin="basin_code", cell_area_mm2=C.CELL_AREA_MM2, by=()):
    """Basin-year totals of ``<name>_mm`` columns as mm, m3, acre-feet and mean mm.

    Pixels are summed before the basin table is joined, so the join sees one row per basin
    and year. A basin-year without any valid cell totals 0. A basin that the basin table lacks
    keeps its totals, without a mean depth.
    """
    sums = pixels.groupBy(basin, "year", *by).agg(
        *[total_or_zero(f"{n}_mm").alias(f"{n}_mm") for n in names])
    out = sums.join(basins.select(basin, "area_m2"), basin, "left")
    for n in names:
        m3 = mm_to_m3(f"{n}_mm", cell_area_mm2)
        out = out.withColumn(f"{n}_m3", m3).withColumn(f"{n}_AF", m3_to_af(f"{n}_m3"))
        out = out.withColumn(f"mean_{n}_mm", af_to_mean_mm(f"{n}_AF", "area_m2"))
    return out.drop("area_m2")


def totals_against_reports(totals, reported, basins, first_year=2000, basin="basin_code",
                           reported_af="Irrigation_AF"):
    """Predicted totals next to reported withdrawals; years of either side are kept."""
    pred = totals.select(basin, "year", "pred_pumping_mm", "pred_pumping_m3",
                         "pred_pumping_AF")
    rep = reported.select(basin, "year", F.col(reported_af).alias("actual_pumping_AF"))
    both = pred.join(rep, [basin, "year"], "full").filter(F.col("year") >= first_year)
    return (both.join(basins.select(basin, "area_m2"), basin)
            .withColumns({
                "actual_pumping_m3": af_to_m3("actual_pumping_AF"),
                "mean_pred_pumping_mm": af_to_mean_mm("pred_pumping_AF", "area_m2"),
                "mean_actual_pumping_mm": af_to_mean_mm("actual_pumping_AF", "area_m2")})
            .drop("area_m2"))


def field_totals(fields, basin="basin_code", value="pumping_AF", out="Irrigation_AF"):
    """Field records summed to basin and year, in the layout of reported withdrawals."""
    return fields.groupBy(basin, "year").agg(total_or_zero(value).alias(out))


def overlap_weights(small_cells, large_cells, low=0.20, full=0.95, small="small_id",
                    large="basin_code"):
    """Share of each small polygon inside each large one, from counts of cell centres.

    Up to ``low`` counts as 0 and from ``full`` as 1. The cell grid sets the accuracy.
    """
    size = small_cells.groupBy(small).agg(F.count("*").alias("_all"))
    both = (small_cells.join(large_cells, ["row", "col"]).groupBy(small, large)
            .agg(F.count("*").alias("_in")))
    share = F.col("_in") / F.col("_all")
    weight = F.when(share <= low, 0.0).when(share >= full, 1.0).otherwise(share)
    return both.join(size, small).select(small, large, share.alias("share"),
                                         weight.alias("weight"))


def area_weighted_transfer(values, weights, small="small_id", large="basin_code",
                           value="value", out="transferred"):
    """Sum of weight x value per large polygon and year; ``values`` is long by year."""
    return (hot_join(values, weights, [small])
            .groupBy(large, "year").agg(total_or_zero(F.col(value) * F.col("weight")).alias(out)))


def join_annual_series(left, right, basins, left_af="pred_pumping_AF",
                       right_af="reported_AF", basin="basin_code"):
    """Two annual series by basin and year, with volumes in m3 and mean mm."""
    both = left.select(basin, "year", left_af).join(
        right.select(basin, "year", right_af), [basin, "year"], "full")
    out = both.join(basins.select(basin, "area_m2"), basin)
    for af in (left_af, right_af):
        stem = af.removesuffix("_AF")
        out = out.withColumns({f"{stem}_m3": af_to_m3(af),
                               f"mean_{stem}_mm": af_to_mean_mm(af, "area_m2")})
    return out.drop("area_m2")


def count_positive(pixels, columns=("pred_pumping_mm", "actual_pumping_mm"),
                   basin="basin_code", basins=None):
    """Cells above 0 per basin and year; years outside a basin's window are dropped."""
    counts = pixels.groupBy(basin, "year").agg(
        *[F.count_if(F.col(c) > 0).alias(f"n_{c}") for c in columns])
    return counts if basins is None else in_year_window(counts, basins, basin)


def interval_totals(pixels, basins, low="low_mm", high="high_mm", basin="basin_code"):
    """Basin-year totals of the lower and upper bound layers."""
    bounds = pixels.select(basin, "year", F.col(low).alias("low_mm"),
                           F.col(high).alias("high_mm"))
    return annual_totals(bounds, basins, ("low", "high"), basin)


def compile_basins(totals, basins, intervals=None, basin="basin_code"):
    """All basins under one another with names; zeros become missing; with intervals, only
    basin-years that have one are kept."""
    measures = [c for c in totals.columns if c not in (basin, "year", "run")]
    named = totals.join(basins.select(basin, "basin"), basin).withColumns(
        {c: zero_to_null(c) for c in measures})
    if intervals is None:
        return named
    bounds = intervals.select(basin, "year", *[c for c in intervals.columns
                                               if c not in (basin, "year")])
    return named.join(bounds, [basin, "year"])


def in_year_window(df, basins, basin="basin_code", exclude=()):
    """Rows inside each basin's own first..last year; basins in ``exclude`` are dropped.
    Meant for basin-year tables; for cells use :func:`cells_in_year_window`."""
    window = basins.select(basin, "first_year", "last_year").filter(
        ~F.col(basin).isin(list(exclude)))
    return (df.join(window, basin)
            .filter(F.col("year").between(F.col("first_year"), F.col("last_year")))
            .drop("first_year", "last_year"))


def cells_in_year_window(df, basins, basin="basin_code", exclude=()):
    """As :func:`in_year_window` on cell rows, where one basin may hold most of the rows."""
    window = basins.select(basin, "first_year", "last_year").filter(
        ~F.col(basin).isin(list(exclude)))
    return (hot_join(df, window, [basin])
            .filter(F.col("year").between(F.col("first_year"), F.col("last_year")))
            .drop("first_year", "last_year"))


def region_values(layer, cell_region, keys=("row", "col"), region="region", value="value"):
    """(region, value) rows: the input of distribution comparisons."""
    return (layer.filter(F.col(value).isNotNull())
            .join(cell_region.select(*keys, region), list(keys)).select(region, value))
