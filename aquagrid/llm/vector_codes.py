"""Vector code compression: product codes whose nearest entries come from bitmasks.

A vector is cut into equal parts and each part is replaced by the nearest entry of its
position's codebook. The search slices and intersects: in every dimension the entries'
coordinates are sorted, and each place of the order carries a mask of the entries before it.
The distance to a first guess (the entry nearest in the widest dimension) is a radius; in each
dimension the entries within it are the difference of two prefix masks, and the AND over the
dimensions is a set that holds every entry as near as the guess. Distances are taken to those
candidates only, so the result is exact, ties to the lower index.

Codebooks are refined in rounds: tasks sum the parts they assign (at most one row a task, part
and entry), Spark adds those sums, and the driver divides them. Only codebooks (parts x entries
x width numbers, at most 64 entries a part) reach the driver or a task whole.

All arithmetic is on integers and exact: 64-bit where the squared distances of a batch fit,
Python integers beyond. Rows whose vector is missing, holds a missing or non-finite component or
one that leaves 64 bits when scaled are dropped, as are vectors that cannot be cut into equal
parts or differ in length from the first that can (by id). Missing ids and repeated rows are
coded like all others; a missing id comes last among the ids. An error past 64 bits is missing,
and so is the sum of a label that holds one or leaves 64 bits itself.
With fewer rows than entries the codebooks are smaller. An empty table gives no rows. Columns
besides id, vector and label are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aquagrid.llm.common import by_batch, stored, table
from aquagrid.operators.joins import hot_join

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SLICE = 16_384
LIMIT = 2 ** 63


def _widest(x):
    """The greatest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


class Slices:
    """The entries of one part position, sorted in each dimension with prefix masks."""

    def __init__(self, entries):
        self.entries = np.array(entries, np.int64)
        count, width = self.entries.shape
        if count > 64:
            raise ValueError("a mask holds at most 64 entries")
        order = np.argsort(self.entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.entries, order, axis=0)
        self.by_order = order
        self.prefix = np.zeros((width, count + 1), np.uint64)
        self.prefix[:, 1:] = np.bitwise_or.accumulate(
            np.uint64(1) << order.T.astype(np.uint64), axis=1)
        spread = self.sorted[-1].astype(object) - self.sorted[0].astype(object)
        self.widest = max(range(width), key=lambda d: spread[d])

    def distance(self, x, entry):
        """Squared distance of each row of ``x`` to an entry (one, or one a row)."""
        away = np.abs(x - self.entries[entry]) if x.dtype != object else x - self.entries[entry].astype(object)
        return (away * away).sum(axis=1)

    def within(self, x, radius):
        """Mask of the entries within ``radius`` of each row in every dimension."""
        mask = np.full(len(x), ~np.uint64(0))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            mask &= self.prefix[d, high] ^ self.prefix[d, low]
        return mask

    def guess(self, x):
        """The entry nearest in the widest dimension, or a neighbour of it."""
        line = self.sorted[:, self.widest]
        at = np.searchsorted(line, x[:, self.widest]).clip(0, len(line) - 1)
        return self.by_order[at, self.widest]

    def nearest(self, x):
        """Code and squared distance of each row."""
        widest = max(_widest(x), _widest(self.entries))
        if x.shape[1] * (2 * widest + 1) ** 2 >= LIMIT:
            x = x.astype(object)
        code = self.guess(x)
        best = self.distance(x, code)
        if x.dtype == object:
            radius = np.array([int(b ** 0.5 * (1 + 1e-9)) + 1 for b in best], object)
        else:
            radius = np.sqrt(best.astype(np.float64)).astype(np.int64) + 1
        mask = self.within(x, radius)
        for e in range(len(self.entries)):
            rows = np.flatnonzero((mask >> np.uint64(e)) & np.uint64(1))
            if len(rows):
                away = self.distance(x[rows], e)
                nearer = (away < best[rows]) | ((away == best[rows]) & (e < code[rows]))
                best[rows[nearer]], code[rows[nearer]] = away[nearer], e
        return code, best


def integer_vectors(vectors: DataFrame, key="vec_id", vector="embedding", label="label",
                    parts=PARTS, scale=SCALE) -> DataFrame:
    """Usable rows as (id, label, v): floor(scale * x) of each component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x.cast("double") * scale) >= float(LIMIT)))
    whole = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
    return (vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)
                           & (F.size(vector) % parts == 0) & ~bad)
            .select(F.col(key).alias("id"), F.col(label).alias("label"), whole.alias("v")))


def _matrix(column):
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(values, books):
    """Codes (rows x parts) and distances (list of rows, per part)."""
    width = values.shape[1] // len(books)
    found = [book.nearest(values[:, p * width:(p + 1) * width]) for p, book in enumerate(books)]
    return np.stack([c for c, _ in found], axis=1), [d for _, d in found]


def _pieces(batch, column):
    for first in range(0, batch.num_rows, SLICE):
        piece = batch.slice(first, SLICE)
        yield piece, _matrix(piece.column(column))


SUMS = "part int, entry int, n bigint, sums array<decimal(38,0)>"


def partial_sums(books):
    """For ``mapInArrow``: number and sum of the parts each entry takes, once a task."""
    def run(batches):
        totals, counts = {}, {}
        for batch in batches:
            for _, values in _pieces(batch, 0):
                codes, _ = _assign(values, books)
                width = values.shape[1] // len(books)
                small = len(values) * _widest(values) < LIMIT
                for p in range(len(books)):
                    own = values[:, p * width:(p + 1) * width]
                    for e in np.unique(codes[:, p]).tolist():
                        taken = own[codes[:, p] == e]
                        added = (taken if small else taken.astype(object)).sum(axis=0)
                        totals[p, e] = totals.get((p, e), 0) + added.astype(object)
                        counts[p, e] = counts.get((p, e), 0) + len(taken)
        if totals:
            keys = sorted(totals)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in keys], pa.int32()), pa.array([e for _, e in keys], pa.int32()),
                 pa.array([counts[k] for k in keys], pa.int64()),
                 pa.array([[Decimal(int(s)) for s in totals[k]] for k in keys],
                          pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"])
    return run


def refine(rows: DataFrame, books):
    """Codebooks after one round: every entry moves to the floor of its parts' mean."""
    width = books[0].entries.shape[1]
    sums = rows.select("v").mapInArrow(partial_sums(books), SUMS).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[d]) for d in range(width)]).alias("sums"))
    moved = [book.entries.copy() for book in books]
    for r in sums.collect():        # at most parts x entries rows
        moved[r["part"]][r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
    return [Slices(m) for m in moved]


def first_books(rows: DataFrame, parts=PARTS, entries=ENTRIES):
    """Codebooks from the vectors of the smallest ids."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    values = np.array([r["v"] for r in first], np.int64)
    return [Slices(part) for part in np.split(values, parts, axis=1)]


def digest(books):
    numbers = (int(x) for book in books for x in book.entries.ravel())
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def _coder(books):
    def run(batch):
        codes, errors = [], []
        for _, values in _pieces(batch, 2):
            code, away = _assign(values, books)
            codes += [row.tobytes().hex() for row in code.astype(np.uint8)]
            total = sum(a.astype(object) for a in away)
            errors += [e if e < LIMIT else None for e in total.tolist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(codes, pa.string()),
             pa.array(errors, pa.int64())], ["id", "label", "code", "error"])
    return by_batch(run)


def compress(vectors: DataFrame, key="vec_id", vector="embedding", label="label", parts=PARTS,
             entries=ENTRIES, rounds=ROUNDS, scale=SCALE):
    """(key, code, error, label_error, codebooks_sha256) of every usable row."""
    rows = integer_vectors(vectors, key, vector, label, parts, scale)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select(F.size("v")).first()
    rows = stored(rows.filter(F.size("v") == (first[0] if first else 0)))
    books = first_books(rows, parts, entries) if first else []
    for _ in range(rounds if first else 0):
        books = refine(rows, books)
    kind = rows.schema
    coded = stored(rows.mapInArrow(_coder(books), (
        f"id {kind['id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, "
        "code string, error bigint")))
    # missing labels are one group: a flag and a stand-in make them a plain key
    keyed = coded.withColumns({"_none": F.col("label").isNull(),
                               "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    keys = ["_none", "_label"]
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")
    sums = keyed.groupBy(*keys).agg(
        F.when(F.count("error") == F.count("*"), total).alias("label_error"), F.count("*").alias("n"))
    return (hot_join(keyed, sums.drop("n"), keys, salt_on=["id", "code"], counts=sums.select(*keys, "n"))
            .select(F.col("id").alias(key), "code", "error", "label_error",
                    F.lit(digest(books)).alias("codebooks_sha256")))


def _oracle():
    rounds = []
    for r in range(ROUNDS + 1):
        rounds.append(f"""
a{r} as materialized (select t, p, x, e, d from (
  select *, row_number() over (partition by t, p order by d, e) as k from (
    select v.t, v.p, v.x, b.e, list_sum(list_transform(list_zip(v.x, b.y),
      lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
    from parts v join b{r} b using (p))) where k = 1)""")
        if r < ROUNDS:
            rounds.append(f"""
m{r} as (select p, e, list(f order by i) as y from (
  select p, e, i, cast(floor(cast(sum(x[i]) as double) / count(*)) as bigint) as f
  from a{r}, unnest(range(1, len(x) + 1)) u(i) group by p, e, i) group by p, e),
b{r + 1} as materialized (select b.p, b.e, coalesce(m.y, b.y) as y from b{r} b left join m{r} m using (p, e))""")
    return f"""
with kept as (select row_number() over (order by vec_id) as t, vec_id, label,
    list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (select t, p, list_slice(v, p * (len(v) // {PARTS}) + 1, (p + 1) * (len(v) // {PARTS})) as x
  from kept, unnest(range({PARTS})) q(p)),
b0 as (select p, t - 1 as e, x as y from parts where t <= {ENTRIES}),{",".join(rounds)},
coded as (select t, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error
  from a{ROUNDS} group by t),
books as (select sha256(string_agg(array_to_string(y, ','), ',' order by p, e)) as codebooks_sha256
  from b{ROUNDS}),
labels_ as (select label, cast(sum(error) as bigint) as label_error from coded join kept using (t) group by label)
select k.vec_id, c.code, c.error, l.label_error, b.codebooks_sha256
from kept k join coded c using (t) join labels_ l on k.label is not distinct from l.label, books b
"""


ORACLE = _oracle()


def op13(spark, folder):
    return compress(table(spark, folder, "embeddings"))
