"""Map algebra on long cell tables. Layers share cell keys such as ``(year, row, col)``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.functions.numeric import (
    as_col, clamp_low, first_valid, keep_between, null_to_zero, ratio, zero_to_null)
from aquagrid.operators.joins import hot_join


def stack(layers):
    """Layers with the same columns under one another."""
    return reduce(lambda a, b: a.unionByName(b), layers)


def align(layers, keys, value="value", how="full", partition_by=None):
    """Named layers side by side, one column per name.

    Done as union and conditional aggregation: one shuffle for any number of layers, and a
    cell missing from some of them is still one row. With ``how='inner'`` only cells present
    in every layer are kept. ``partition_by`` (a part of the keys) lets a later join on those
    columns reuse the shuffle.
    """
    tagged = stack([df.select(*keys, F.lit(name).alias("_layer"), F.col(value).cast("double")
                              .alias("_v")) for name, df in layers.items()])
    if partition_by:
        tagged = tagged.repartition(*partition_by)
    there = [F.max(F.col("_layer") == n).alias(f"_has_{i}") for i, n in enumerate(layers)]
    wide = tagged.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_layer") == n, F.col("_v"))).alias(n) for n in layers],
        *(there if how == "inner" else []))
    if how == "inner":
        for i in range(len(layers)):
            wide = wide.filter(F.col(f"_has_{i}")).drop(f"_has_{i}")
    return wide


def within(cells, ref, keys=("row", "col")):
    """Cells on the reference grid."""
    return cells.join(ref.select(*keys), list(keys), "left_semi")


def on_grid(ref, layer, keys=("row", "col")):
    """Every reference cell, with the layer where it has one."""
    return ref.select(*keys).join(layer, list(keys), "left")


def reference_cells(layer, value="value", keys=("row", "col")):
    """The valid cells of a layer, as a reference grid."""
    return layer.filter(F.col(value).isNotNull()).select(*keys)


def sum_layers(layers, keys, ref=None, ref_keys=("row", "col"), value="value"):
    """Cell-wise sum; missing is ignored, and a cell that is missing everywhere sums to 0."""
    total = stack(layers).groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    return total if ref is None else within(total, ref, ref_keys)


def mean_layers(layers, keys, value="value"):
    """Cell-wise mean over all n layers; missing in any layer gives missing."""
    n = len(layers)
    return stack(layers).groupBy(*keys).agg(
        F.when(F.count(value) == n, F.sum(value) / n).alias(value))


def mean_of_all(df, keys, layer, value="value"):
    """As :func:`mean_layers` for layers told apart by a column: one scan, n is counted."""
    n = df.agg(F.count_distinct(layer)).scalar()
    return df.groupBy(*keys).agg(
        F.when(F.count(value) == n, F.sum(value) / n).alias(value))


def threshold(df, lower, upper=None, assign=None, value="value"):
    """Keep (or set to ``assign``) values in [lower, upper]; the rest becomes 0."""
    v = F.col(value)
    ok = v >= lower if upper is None else v.between(lower, upper)
    kept = v if assign is None else F.lit(float(assign))
    return df.withColumn(value, F.when(ok, kept).otherwise(F.lit(0.0)))


def mosaic(tiles, keys, method="first", priority="priority", value="value"):
    """Overlay tiles: the value of the lowest priority number, or the min or max."""
    valid = tiles.filter(F.col(value).isNotNull())
    if method != "first":
        pick = {"min": F.min, "max": F.max}[method]
        return valid.groupBy(*keys).agg(pick(value).alias(value))
    # equal priorities give the smaller value. Two hash aggregates on one shuffle: a minimum
    # over (priority, value) pairs would make Spark sort the tiles instead
    placed = valid.repartition(*keys).groupBy(*keys, priority).agg(F.min(value).alias(value))
    return placed.groupBy(*keys).agg(F.min_by(value, priority).alias(value))


def overlay(base, patch, keys, value="value"):
    """Patch values win where they are valid and not 0; a 0 in the base reads as missing."""
    both = align({"base": base, "patch": patch}, keys, value)
    return both.select(*keys, first_valid(zero_to_null("patch"), zero_to_null("base"))
                       .alias(value))


def water_balance_filter(df, pump="pump", peff="peff", et="et", sw=None, low=0.5, high=1.5,
                         sw_last_year=2020, year="year"):
    """Pumping kept where (effective rain + pumping [+ surface water]) / ET is plausible.

    Surface water takes part up to ``sw_last_year``; other cells become missing.
    """
    water = as_col(peff) + as_col(pump)
    if sw is not None:
        water = F.when(as_col(year) <= sw_last_year, water + as_col(sw)).otherwise(water)
    share = ratio(F.when(water > 0, water), F.when(as_col(et) > 1e-6, as_col(et)))
    return df.withColumn(pump, F.when(share.between(low, high), zero_to_null(pump)))


def range_filter(df, lower, upper, value="value"):
    return df.withColumn(value, keep_between(value, lower, upper))


def first_by_rank(ranks, value="value", rank="_rank"):
    """Aggregate: the value of the lowest rank present, for a few ranks 0..n-1. One plain
    maximum per rank, which keeps the aggregation hash-based."""
    return F.coalesce(*[F.max(F.when(F.col(rank) == i, F.col(value)))
                        for i in range(ranks)]).alias(value)


def combine_by_priority(layers, keys, no_data=None, region="region", year="year",
                        value="value", mask=None, mask_keys=("row", "col")):
    """One layer from regional layers, first name wins; only values above 0 count.

    ``no_data`` lists (region, year) pairs to skip; ``mask`` keeps only its cells.
    """
    ranked = stack([
        df.select(*keys, F.lit(name).alias(region), F.lit(i).alias("_rank"), value)
        for i, (name, df) in enumerate(layers.items())]).filter(F.col(value) > 0)
    if no_data is not None:
        ranked = ranked.join(no_data, [region, year], "left_anti")
    combined = ranked.groupBy(*keys).agg(first_by_rank(len(layers), value))
    return combined if mask is None else within(combined, mask, mask_keys)


def product(a, b, keys, value="value"):
    """Cell-wise product where both are valid."""
    both = align({"a": a, "b": b}, keys, value)
    return both.select(*keys, (F.col("a") * F.col("b")).alias(value)).filter(
        F.col(value).isNotNull())


def quotient(a, b, keys, value="value"):
    """Cell-wise a/b where both are valid and b is not 0."""
    both = align({"a": a, "b": b}, keys, value)
    return both.select(*keys, ratio("a", "b").alias(value)).filter(F.col(value).isNotNull())


def difference(a, b, keys, value="value", floor=None):
    """Cell-wise a-b where both are valid, optionally held above ``floor``."""
    both = align({"a": a, "b": b}, keys, value)
    gap = F.col("a") - F.col("b")
    gap = gap if floor is None else clamp_low(gap, floor)
    return both.select(*keys, gap.alias(value)).filter(F.col(value).isNotNull())


def _group_case(code, groups, ids):
    out = None
    for name, members in groups.items():
        test = F.col(code).isin(list(members))
        out = F.when(test, ids[name]) if out is None else out.when(test, ids[name])
    return out


def reclassify(df, code, groups=None, ids=None, out="group_id"):
    """Class code to group number; codes in no group become missing."""
    groups, ids = groups or C.CLIMATE_GROUPS, ids or C.CLIMATE_GROUP_ID
    return df.withColumn(out, _group_case(code, groups, ids))


def one_hot(df, code, groups=None):
    """A 1/0 column per group; missing where the code is missing."""
    groups = groups or C.CLIMATE_GROUPS
    return df.withColumns({
        name: F.when(F.col(code).isNotNull(), F.col(code).isin(list(members)).cast("int"))
        for name, members in groups.items()})


def classify_irrigated(cells, zone_cells, keys=("row", "col"), value="value",
                       inside=C.IRRIGATED_FRACTION_BASIN_RANGE,
                       outside=C.IRRIGATED_FRACTION_ELSEWHERE):
    """1 where the irrigated fraction passes its zone's threshold, else missing."""
    flagged = cells.join(zone_cells.select(*keys).distinct().withColumn("_in", F.lit(True)),
                         list(keys), "left")
    cut = F.when(F.col("_in"), F.lit(inside)).otherwise(F.lit(outside))
    return flagged.withColumn(value, F.when(F.col(value) > cut, F.lit(1))).drop("_in")


def fill_on_grid(ref, layer, keys=("row", "col"), value="value"):
    """Every reference cell, 0 where the layer has none."""
    return on_grid(ref, layer, keys).withColumn(value, null_to_zero(value))


def normalise(df, by, value="value"):
    """Min-max scaling inside each ``by`` group; a constant group becomes missing. The
    bounds come from a partial aggregate, not from a window over the whole group, and the rows of
    a hot group meet them in many tasks."""
    bounds = df.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"),
                                 F.count("*").alias("n"))
    scaled = ratio(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return (hot_join(df, bounds.drop("n"), list(by), counts=bounds)
            .withColumn(value, scaled).select(*df.columns))


def dominated_class(df, predicted, keys=("row", "col"), value="value",
                    cut=C.GROUNDWATER_DOMINATED_PCT, pred_value="value"):
    """1 at or above the cut, 0 below, only for cells with a prediction in any year."""
    ever = predicted.filter(F.col(pred_value).isNotNull()).select(*keys).distinct()
    flag = F.when(F.col(value) >= cut, 1).otherwise(0)
    return df.withColumn(value, flag).join(ever, list(keys), "left_semi")


def blank_unmasked(pred, mask, keys, value="predicted"):
    """Predictions outside the mask become missing."""
    hit = mask.select(*keys).distinct().withColumn("_hit", F.lit(True))
    return (pred.join(hit, list(keys), "left")
            .withColumn(value, F.when(F.col("_hit"), F.col(value))).drop("_hit"))


def clamp_negative(df, value="predicted"):
    return df.withColumn(value, clamp_low(value, 0.0))
