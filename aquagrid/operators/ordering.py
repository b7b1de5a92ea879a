"""Exact ranks, running counts and quantiles without a window over a whole group.

A group may hold a third of all rows, so no window here is partitioned by the group alone,
apart from windows over block totals. Values are cut into blocks of about equally many rows at
bounds read from a quantile sketch (:func:`range_bounds`); a window runs inside each block, and
the block totals, few per group, are prefix-summed and joined back. The sketch is one small job
run when the plan is made. Its bounds stand in the plan as literals, so all parts of a plan, and
tasks that are run again, cut alike; results do not depend on where the cuts are. Rows are read
more than once: values whose last bits depend on the order of a sum are stored first
(:func:`aquagrid.session.stored`).
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Window, functions as F, types as T

from aquagrid.functions.numeric import portable_hash

EXPLODE_CHUNK = 65_536
BLOCKS_PER_PARTITION = 5
SKETCHES = 256


def _blocks(df):
    """How many blocks: some for each shuffle partition of the cluster."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return BLOCKS_PER_PARTITION * max(partitions, 8)


def _sketch(df, value, parts, by=()):
    """``parts - 1`` approximate quantiles of a double column as an array ``_at``, per ``by``.

    Tasks meet in at most 256 sketches, whose quantiles are merged with their row counts as
    weights, so no reducer reads the sketches of all tasks.
    """
    at = "array(" + ", ".join(f"{i / parts!r}D" for i in range(1, parts)) + ")"
    parted = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(SKETCHES)))
    some = parted.groupBy(*by, "_part").agg(
        F.count("*").alias("_n"),
        F.expr(f"percentile_approx({value}, {at}, {4 * parts})").alias("_q"))
    points = some.select(*by, "_n", F.explode("_q").alias("_q"))
    return points.groupBy(*by).agg(F.expr(f"percentile(_q, {at}, _n)").alias("_at"))


def _numbers(df, **columns):
    """The columns as doubles, without rows in which the first is missing or no number."""
    first = next(iter(columns))
    return (df.select(*[F.col(c).cast("double").alias(k) for k, c in columns.items()])
            .filter(F.col(first).isNotNull() & ~F.isnan(first)))


def range_bounds(df, value):
    """Ascending bounds that cut the rows of ``df`` by value into about equal blocks. A value
    that fills several blocks is a bound once."""
    found = _sketch(_numbers(df, _v=value), "_v", _blocks(df)).first()["_at"]
    return sorted(set(found or []))


def pair_bounds(df, value, tie):
    """As :func:`range_bounds`, by (value, tie): a value that fills several blocks is cut by
    the quantiles of its ties."""
    rows = _numbers(df, _v=value, _t=tie)
    found = _sketch(rows, "_v", _blocks(df)).first()["_at"]
    fills = {v: len(list(run)) for v, run in groupby(sorted(found or []))}
    hot = [v for v, n in fills.items() if n > 1]
    bounds = [(v, float("-inf")) for v in fills]
    if hot:
        parts = max(fills.values()) + 1
        ties = _sketch(rows.filter(F.col("_v").isin(hot) & F.col("_t").isNotNull()), "_t", parts,
                       ["_v"]).collect()
        for r in ties:
            n = fills[r["_v"]]
            bounds += {(r["_v"], r["_at"][i * len(r["_at"]) // n]) for i in range(n)}
    return sorted(bounds)


def block_of(bounds, value, tie=None):
    """How many of the bounds lie below the value (or pair), found by halving steps. It never
    decreases as the value grows, and is 0 for a missing value."""
    def number(x):
        return f"double('{x!r}')"

    if not bounds:
        return F.lit(0)
    v = F.col(value).cast("double")
    if tie is None:
        probe, literals = v, [number(b) for b in bounds]
    else:
        probe = F.struct(v.alias("v"), F.col(tie).cast("double").alias("t"))
        literals = [f"named_struct('v', {number(b)}, 't', {number(t)})" for b, t in bounds]
    table = F.expr(f"array({', '.join(literals)})")
    steps = [F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*steps), F.lit(0), lambda at, step: F.when(
        F.get(table, at + step - 1) < probe, at + step).otherwise(at))


def _keyed(df, group):
    """Non-missing stand-ins for the group columns, and their names.

    A missing group is a group of its own, and a null-safe join would shuffle rows by other
    expressions than the windows do. With plain keys the windows, the block totals and the
    joins below all use one partitioning.
    """
    added = {}
    for i, c in enumerate(group):
        kind = df.schema[c].dataType
        blank = (F.lit("") if isinstance(kind, T.StringType)
                 else F.lit(0).cast(kind) if isinstance(kind, T.NumericType) else None)
        if blank is None:
            added[f"_g{i}"] = F.coalesce(F.col(c).cast("string"), F.lit(""))
        else:
            added[f"_g{i}"] = F.coalesce(F.col(c), blank)
        added[f"_g{i}_none"] = F.col(c).isNull()
    return (df.withColumns(added) if added else df), list(added)


def _block_offsets(df, keys, block, weights, value=None):
    """Per (keys, block): sum of each weight in earlier blocks and in the whole group, and
    with ``value`` the first value of the next block."""
    lowest = [F.min(value).alias("_low")] if value else []
    totals = df.groupBy(*keys, block).agg(
        *[F.sum(w).alias(f"_t_{w}") for w in weights], *lowest)
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *keys, block,
        *[F.coalesce(F.sum(f"_t_{w}").over(earlier), F.lit(0)).alias(f"_before_{w}")
          for w in weights],
        *[F.sum(f"_t_{w}").over(whole).alias(f"total_{w}") for w in weights],
        *([F.lead("_low").over(whole.orderBy(block)).alias("_after")] if value else []))


def running_totals(df, group, value, weights, following=None, bounds=None):
    """Add ``below_<w>`` (sum of w at smaller values of the group) and ``total_<w>``; with
    ``following``, also the next larger value under that name.

    ``df`` has one row per (group, value). ``bounds`` are those of :func:`range_bounds`, where
    the caller has them or can read them from something cheaper than ``df``.
    """
    bounds = range_bounds(df, value) if bounds is None else bounds
    blocked, keys = _keyed(df.withColumn("_block", block_of(bounds, value)), group)
    order = Window.partitionBy(*keys, "_block").orderBy(value)
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    ahead = [F.lead(value).over(order).alias("_next")] if following else []
    local = blocked.select(
        "*", *[F.coalesce(F.sum(w).over(inside), F.lit(0)).alias(f"_in_{w}") for w in weights],
        *ahead)
    offsets = _block_offsets(blocked, keys, "_block", weights, value if following else None)
    joined = local.join(offsets, [*keys, "_block"])
    return joined.select(
        *df.columns,
        *[(F.col(f"_in_{w}") + F.col(f"_before_{w}")).alias(f"below_{w}") for w in weights],
        *[F.col(f"total_{w}") for w in weights],
        *([F.coalesce("_next", "_after").alias(following)] if following else []))


def value_counts(df, group, value):
    """Rows per distinct non-missing value; partial counts are combined before the shuffle."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
            .agg(F.count("*").alias("n")))


def counted(df, group, value, following=None, bounds=None):
    """Distinct values with ``n``, ``below_n`` and ``total_n``. The bounds are read from the
    rows: blocks of equally many rows hold at most as many distinct values."""
    bounds = range_bounds(df, value) if bounds is None else bounds
    return running_totals(value_counts(df, group, value), group, value, ["n"], following, bounds)


def _rank_by_blocks(df, group, order, rank, total):
    """1-based rank in each group by ``order``, within which ``_block`` never decreases."""
    blocked, keys = _keyed(df, group)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    local = blocked.withColumn("_pos", F.row_number().over(inside))
    offsets = _block_offsets(blocked.withColumn("_one", F.lit(1)), keys, "_block", ["_one"])
    return local.join(offsets, [*keys, "_block"]).select(
        *[c for c in df.columns if c != "_block"],
        (F.col("_pos") + F.col("_before__one")).alias(rank), F.col("total__one").alias(total))


def row_rank(df, group, value, tie, rank="rank", total="total"):
    """1-based rank of every row by (value, tie) in its group, plus the group size.

    ``tie`` is a numeric id that is unique within the group. Blocks are cut by (value, tie), so
    even one value held by a third of the rows stays distributed. Rows with a missing value are
    dropped.
    """
    rows = df.filter(F.col(value).isNotNull())
    blocked = rows.withColumn("_block", block_of(pair_bounds(rows, value, tie), value, tie))
    return _rank_by_blocks(blocked, group, [value, tie], rank, total)


def hash_rank(df, strata, key_hash, tie, rank="rank", total="total"):
    """1-based rank by (32-bit hash, tie) in each stratum. The hash is uniform, so its top
    bits are balanced blocks."""
    shift = max(32 - (_blocks(df) - 1).bit_length(), 0)
    block = F.coalesce(F.shiftright(F.col(key_hash), shift), F.lit(0).cast("bigint"))
    return _rank_by_blocks(df.withColumn("_block", block), strata, [key_hash, *tie], rank, total)


def sample_by_hash(df, keys, n, seed=0, top=100_000):
    """The n rows that come first by hash. A small sample is a top-n per task; a larger one
    is cut by distributed rank, so it never passes through the driver."""
    hashed = df.withColumn("_h", portable_hash(seed, *keys))
    if n <= top:
        return hashed.orderBy("_h", *keys).limit(n).drop("_h")
    return hash_rank(hashed, [], "_h", list(keys), "_r", "_t").filter(
        F.col("_r") <= n).select(*df.columns)


def exact_quantiles(df, group, value, quantiles, weight=None):
    """Linear-interpolation quantiles per group. ``quantiles`` maps output name to fraction. With
    ``weight``, a row stands for so many rows.

    Spark's ``percentile`` keeps a value map of the whole group in one task; here a quantile
    is a lookup of two ranks among the distinct values.
    """
    if weight is None:
        ranked = counted(df, group, value)
    else:
        sums = (df.filter(F.col(value).isNotNull()).groupBy(*group, value)
                .agg(F.sum(weight).alias("n")))
        ranked = running_totals(sums, group, value, ["n"], bounds=range_bounds(df, value))
    picks = []
    for name, p in quantiles.items():
        pos = (F.col("total_n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (F.col("below_n") <= at) & (at < F.col("below_n") + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{side}_{name}"))
        picks.append(F.max(pos - F.floor(pos)).alias(f"_f_{name}"))
    found = ranked.groupBy(*group).agg(*picks, F.max("total_n").alias("n"))
    return found.select(
        *group, "n",
        *[(F.col(f"_lo_{q}") + (F.col(f"_hi_{q}") - F.col(f"_lo_{q}")) * F.col(f"_f_{q}"))
          .alias(q) for q in quantiles])


def repeat_rows(df, count, index, chunk=EXPLODE_CHUNK):
    """One output row per 1..count of each input row. Counts are cut into chunks, and the
    chunks are spread over tasks before they are expanded, so one huge run is shared out."""
    one, size = F.lit(1).cast("bigint"), F.col(count).cast("bigint")
    starts = df.withColumn("_start", F.explode(F.sequence(one, size, F.lit(chunk).cast("bigint"))))
    stop = F.least(F.col("_start") + chunk - 1, F.col(count))
    return (starts.repartition(*df.columns, "_start")
            .withColumn(index, F.explode(F.sequence(F.col("_start"), stop))).drop("_start"))
