"""Cleaning and reshaping of well and withdrawal records."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.functions.numeric import recode, zero_to_null
from aquagrid.functions.projection import utm_to_lonlat
from aquagrid.operators.joins import hot_join


def filter_categories(df, rights=tuple(C.IRRIGATION_RIGHTS), water=C.GROUNDWATER,
                      right_col="right_type", water_col="water_type"):
    return df.filter(F.col(right_col).isin(list(rights)) & (F.col(water_col) == F.lit(water)))


def pad_short_ids(df, col="well_id"):
    """Five-character ids get one leading zero; other ids stay."""
    c = F.col(col).cast("string")
    return df.withColumn(col, F.when(F.length(c) == 5, F.concat(F.lit("0"), c)).otherwise(c))


def pad_ids(df, col, width=7):
    """Left-pad with zeros to ``width``; longer ids keep all their characters."""
    c = F.col(col).cast("string")
    return df.withColumn(col, F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c))


def latest_registry(registry, key="well_id", order="load_order"):
    """One coordinate pair per well: the row loaded last, larger coordinates on a tie."""
    best = F.max(F.struct(F.col(order), F.col("lon"), F.col("lat"))).alias("_best")
    return (registry.filter(F.col(key).isNotNull()).groupBy(key).agg(best)
            .select(key, F.col("_best.lon").alias("lon"), F.col("_best.lat").alias("lat")))


def attach_coordinates(df, registry, key="well_id", order="load_order"):
    """Coordinates by id; records of unknown wells stay, with missing coordinates."""
    return hot_join(df, latest_registry(registry, key, order), [key], "left")


def join_well_table(df, wells, key, cap=C.MAX_WELL_AF, value="af_pumped"):
    """Left join to the well table, then keep values up to the cap. A record matches every
    row of its well; missing values do not pass the cap."""
    return hot_join(df, wells, [key], "left").filter(F.col(value) <= cap)


def map_names(df, col, mapping=None, out=None):
    """Recode names; a name outside the mapping becomes missing."""
    return df.withColumn(out or col, recode(col, mapping or C.AREA_NAMES))


def wide_years_to_long(df, ids, prefixes):
    """Year-suffixed columns (``AF_USED_2000`` ...) to one row per id and year.

    ``prefixes`` maps output column to column prefix. All measures are unpivoted by one
    generator, so they need no join afterwards; missing values are kept.
    """
    years = sorted({c[-4:] for c in df.columns for p in prefixes.values()
                    if c.startswith(p) and c[-4:].isdigit()})
    entries = [F.struct(F.lit(int(y)).alias("year"),
                        *[(F.col(f"{p}{y}") if f"{p}{y}" in df.columns else F.lit(None))
                          .cast("double").alias(out) for out, p in prefixes.items()])
               for y in years]
    return df.select(*ids, F.inline(F.array(*entries)))


def split_members(df, list_col, value, member="member", sep="_"):
    """Share a value equally over the ids in a joined list: one row per id."""
    members = F.split(F.col(list_col), sep)
    keep = [c for c in df.columns if c not in (list_col, value)]
    return df.select(*keep, (F.col(value) / F.size(members)).alias(value),
                     F.explode(members).alias(member))


def join_locations(df, locations, key):
    """Rows whose id has a location; missing ids match nothing."""
    return hot_join(df.filter(F.col(key).isNotNull()), locations, [key], "inner")


def with_lonlat(df, easting="utm_x", northing="utm_y", zone=12):
    lon, lat = utm_to_lonlat(easting, northing, zone)
    return df.withColumn("lon", lon).withColumn("lat", lat)


def within_years(df, first, last, col="year"):
    return df.filter(F.col(col).between(first, last))


def drop_unavailable(df, no_data, keys):
    """Remove the (region, year) pairs listed as having no data. The list is a setting of a
    few rows per region; adaptive execution picks the join from its measured size."""
    return df.join(no_data, list(keys), "left_anti")


def fold_states(df, col="state_id", fold=None):
    fold = fold or C.STATE_FOLD
    out = F.col(col)
    for target in sorted(set(fold.values())):
        sources = [k for k, v in fold.items() if v == target]
        out = F.when(F.col(col).isin(sources), F.lit(target)).otherwise(out)
    return df.withColumn(col, out)


def complete_rows(df, cols=None):
    return df.na.drop(subset=cols)


def fill_missing(df, cols, value=0.0):
    return df.na.fill(value, subset=list(cols))


def zeros_to_missing(df, cols):
    return df.withColumns({c: zero_to_null(c) for c in cols})


def fill_with_unit_mean(df, unit, value, last_year=None, carry_to=None, year="year"):
    """Zeros become missing and missing years take the unit's mean over its other years;
    years after ``last_year`` up to ``carry_to`` repeat the last year."""
    seen = df.withColumn(value, zero_to_null(value))
    means = seen.groupBy(unit).agg(F.avg(value).alias("_mean"), F.count("*").alias("n"))
    filled = (hot_join(seen, means.drop("n"), [unit], "left", counts=means.select(unit, "n"))
              .withColumn(value, F.coalesce(value, "_mean")).drop("_mean"))
    if last_year is None:
        return filled
    copies = F.when(F.col(year) == last_year,
                    F.sequence(F.lit(last_year), F.lit(carry_to))).otherwise(
                        F.array(F.col(year)))
    return filled.withColumn(year, F.explode(copies))


def sort_columns(df, first=()):
    """Columns in name order, so every fit and score sees the same layout."""
    return df.select(*first, *sorted(c for c in df.columns if c not in first))


def deduplicate(df, keys, order):
    """One whole row per key: the smallest by the ordering columns, then by all columns."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in rest if c not in order]]
    pick = F.min(F.struct(*ordered)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])
