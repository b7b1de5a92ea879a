"""Joins that stay balanced when a key is hot, and joins that treat NULL keys as equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from aquagrid.functions.numeric import hash_slot

HOT_KEYS = 1000           # a key outside the 1000 largest holds at most 1/1000 of the rows
HOT_MIN_ROWS = 1_000_000  # below this a key fits a task anyway
SALTS = 64


def hot_keys(counts, keys, limit=HOT_KEYS, min_rows=HOT_MIN_ROWS):
    """The largest keys, from a table of keys and row counts ``n``: at most ``limit`` rows,
    which is what makes the result safe to broadcast. Ties are broken by key, so every use of
    the list sees the same keys."""
    return (counts.filter(F.col("n") > min_rows).orderBy(F.col("n").desc(), *keys)
            .limit(limit).select(*keys))


def hot_join(left, right, keys, how="inner", salt_on=None, counts=None, salts=SALTS,
             min_rows=HOT_MIN_ROWS, expanded=False):
    """Equi-join for a left side that may keep a large share of its rows under one key.

    Rows of hot keys are spread over ``salts`` sub-keys by the hash of ``salt_on`` (default:
    all left columns); the matching right rows are repeated once per sub-key. All other rows
    join as usual. ``how`` may be inner, left, left_semi or left_anti: those keep each left
    row's outcome independent of the salt. ``counts`` (keys and ``n``) saves the counting
    pass where the caller has it. ``expanded``: see :func:`shuffled`.
    """
    if counts is None:
        counts = left.groupBy(*keys).agg(F.count("*").alias("n"))
    hot = F.broadcast(hot_keys(counts, keys, min_rows=min_rows).withColumn("_hot", F.lit(True)))
    spread = hash_slot(F.xxhash64(*(salt_on or left.columns)), salts).cast("int")
    # a missing key matches nothing, so such rows may go anywhere
    unkeyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salted_left = (left.join(hot, keys, "left")
                   .withColumn("_salt", F.when(F.col("_hot") | unkeyed, spread)
                               .otherwise(F.lit(0)))
                   .drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0)))
    salted_right = (right.join(hot, keys, "left")
                    .withColumn("_salt", F.explode(copies)).drop("_hot"))
    if expanded:
        salted_right = shuffled(salted_right)
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


def shuffled(df):
    """``df`` as a join side that is never broadcast, nor is the other one. For rows expanded from
    few: Spark's estimate does not count an explode, and a join planned as a broadcast by it stays
    one when the real size is known, as any other plan would shuffle more."""
    return df.hint("merge")


def null_safe_join(left, right, keys, how="inner"):
    """Join on ``keys`` with NULL equal to NULL; the left key columns are kept."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])
