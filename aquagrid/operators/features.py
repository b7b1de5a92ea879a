"""Feature tables, splits, scaling and bootstrap draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from aquagrid import constants as C
from aquagrid.functions.numeric import hash_slot, portable_hash
from aquagrid.operators.ordering import hash_rank, sample_by_hash
from aquagrid.operators.records import fold_states


def widen(cells, names, keys, var="var", value="value", partition_by=None):
    """Long layers to one column per variable, in one shuffle for all variables.

    ``partition_by`` (a part of the keys) lets a later join on those columns reuse the
    shuffle; nothing is lost, as there is one row per key and variable to combine.
    """
    rows = cells.filter(F.col(var).isin(list(names)))
    if partition_by:
        rows = rows.repartition(*partition_by)
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col(var) == n, F.col(value))).alias(n) for n in names])


def feature_table(annual, static, annual_names, static_names, cell=("pixel_id",),
                  crop_fraction="irr_crop_frac", min_fraction=C.MIN_IRRIGATED_CROP_FRACTION):
    """One complete row per cell and year: annual layers side by side, static layers
    repeated for every year; rows with any missing value are dropped.

    Both inputs are long ``(var, cell, [year,] value)`` with one row per variable and cell.
    """
    wide = widen(annual, annual_names, [*cell, "year"], partition_by=cell)
    fixed = widen(static, static_names, list(cell))
    table = wide.join(fixed, list(cell)).na.drop()
    if crop_fraction is None:
        return table
    return table.filter(F.col(crop_fraction) >= min_fraction)


def prediction_table(ref, years, annual, static, annual_names, static_names,
                     cell=("pixel_id",)):
    """Every reference cell for every year; missing inputs become 0 and ``valid`` tells
    whether all inputs were there."""
    wide = widen(annual, annual_names, [*cell, "year"])
    fixed = widen(static, static_names, list(cell))
    every = ref.select(*cell).withColumn(
        "year", F.explode(F.array(*[F.lit(int(y)) for y in years])))
    names = [*annual_names, *static_names]
    table = every.join(fixed, list(cell), "left").join(wide, [*cell, "year"], "left")
    complete = F.lit(True)
    for n in names:
        complete = complete & F.col(n).isNotNull()
    return table.withColumn("valid", complete).na.fill(0.0, subset=names)


def _label(rank, total, test, validation):
    n_test = F.ceil(F.lit(float(test)) * total)
    n_val = F.ceil(F.lit(float(validation)) * (total - n_test))
    return (F.when(rank <= n_test, "test").when(rank <= n_test + n_val, "validation")
            .otherwise("train"))


def row_split(df, keys, test=0.3, validation=0.0, strata=(), seed=0):
    """Label rows train/validation/test by hash order, with exact shares per stratum.
    ``keys`` identify a row."""
    hashed = df.withColumn("_h", portable_hash(seed, *keys))
    ranked = hash_rank(hashed, list(strata), "_h", list(keys), "_r", "_t")
    return ranked.withColumn("split", _label(F.col("_r"), F.col("_t"), test, validation)).drop(
        "_h", "_r", "_t")


def pixel_split(df, pixel="pixel_id", state="state_id", test=0.3, validation=0.0, seed=42,
                fold=None):
    """As :func:`row_split`, but all years of a pixel get one label, stratified by state."""
    folded = fold_states(df, state, fold)
    pixels = folded.select(pixel, state).distinct()
    labels = row_split(pixels, [pixel], test, validation, [state], seed)
    return folded.join(labels, [pixel, state])


def holdout_rows(df, cell_basin, cell=("pixel_id",), basin="basin_code"):
    """Rows inside each basin, tagged with the fold they are held out in."""
    return df.join(cell_basin.select(*cell, F.col(basin).alias("fold")), list(cell))


def fit_rows(df, cell_basin, fold, cell=("pixel_id",), basin="basin_code"):
    """Rows outside one basin: what the model of that fold may see."""
    inside = cell_basin.filter(F.col(basin) == F.lit(fold)).select(*cell).distinct()
    return df.join(inside, list(cell), "left_anti")


def with_basins(df, cell_basin, cell=("pixel_id",), basin="basin_code"):
    """Every row with the basins of its cell as an array ``_basins``, met in one join, for
    :func:`fit_rows_of_basin` and :func:`holdout_rows_of_basin`."""
    own = cell_basin.groupBy(*cell).agg(F.collect_list(basin).alias("_basins"))
    return df.join(own, list(cell), "left")


def fit_rows_of_basin(rows, fold):
    """:func:`fit_rows` of one fold, from rows that have their basins."""
    inside = F.coalesce(F.array_contains("_basins", F.lit(fold)), F.lit(False))
    return rows.filter(~inside).drop("_basins")


def holdout_rows_of_basin(rows, fold):
    """:func:`holdout_rows` of one fold, from rows that have their basins."""
    own = F.filter("_basins", lambda b: b == F.lit(fold))
    return rows.withColumn("fold", F.explode(own)).drop("_basins")


def fit_rows_of_folds(df, cell_basin, cell=("pixel_id",), basin="basin_code"):
    """:func:`fit_rows` of every basin, tagged with the fold they fit: each row meets the few
    basins of its own cell and is repeated for all others."""
    own = cell_basin.groupBy(*cell).agg(F.collect_set(basin).alias("_own"))
    every = cell_basin.agg(F.collect_set(basin)).scalar()
    others = F.array_except(every, F.coalesce("_own", F.array().cast(own.schema["_own"].dataType)))
    return (df.join(own, list(cell), "left").withColumn("fold", F.explode(others))
            .drop("_own"))


def fold_sizes(df, cell_basin, cell=("pixel_id",), basin="basin_code"):
    """Rows to fit on and rows held out, per fold. Cells lie in at most one basin."""
    held = holdout_rows(df, cell_basin, cell, basin).groupBy("fold").agg(
        F.count("*").alias("n_holdout"))
    total = df.agg(F.count("*")).scalar()
    return held.select("fold", "n_holdout", (total - F.col("n_holdout")).alias("n_fit"))


def scaling_stats(df, cols):
    """(variable, mean, std) with the population std, all variables in one aggregate."""
    one = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"m_{c}").alias("mean"),
                              F.col(f"s_{c}").alias("std")) for c in cols])
    return one.select(F.inline(rows))


def standardise(df, stats, cols):
    """(x - mean) / std with stored statistics; a constant variable becomes missing."""
    wide = stats.agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.struct("mean", "std")))).alias("m"))  # one entry per column
    table = wide.scalar()
    return df.withColumns({
        c: (F.col(c) - table[c]["mean"]) / F.nullif(table[c]["std"], F.lit(0.0))
        for c in cols})


def bootstrap_weights(df, keys, members, seed=0):
    """How often each row is drawn in each bootstrap sample of the table's own size.

    Rows are numbered once by hash order; draw k of member b takes row ``hash(b, k) mod N``.
    Draws are generated from the numbered rows themselves (one per row and member), counted
    per row before anything is joined, and undrawn rows are left out.
    """
    hashed = df.select(*keys).withColumn("_h", portable_hash(seed, *keys))
    numbered = hash_rank(hashed, [], "_h", list(keys), "_r", "_t").select(
        *keys, (F.col("_r") - 1).alias("_i"), "_t")
    draws = numbered.select(
        "_i", "_t", F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("member"))
    # 60 bits: positions beyond 2^32 must be drawn too, and all alike
    target = hash_slot(portable_hash(seed, "member", "_i", digits=15), F.col("_t"))
    weights = draws.groupBy("member", target.alias("_i")).agg(F.count("*").alias("weight"))
    return weights.join(numbered.drop("_t"), "_i").select("member", *keys, "weight")


def sample_rows(df, keys, n, seed=0):
    """A repeatable random sample of n rows."""
    return sample_by_hash(df, keys, n, seed)


def assign_folds(df, keys, k=10, seed=0, out="fold"):
    return df.withColumn(out, hash_slot(portable_hash(seed, *keys), k).cast("int"))
