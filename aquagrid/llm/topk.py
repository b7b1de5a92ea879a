"""Exact top-k inner-product search by no-random-access aggregation.

Candidates are dealt into blocks by a hash. In a block, every component is a list sorted by
value, read from the high end where the query's component is positive and from the low end
where it is negative. All lists are read to the same depth. A component of a candidate that
has been read counts exactly; one that has not is bounded above by the value at the reading
front and below by the far end of its list. That gives each candidate a lower and an upper
score. Reading stops for a query when few candidates have an upper score that reaches the k-th
best lower score; those candidates' final scores are then resolved exactly. The bounds of all
queries of a block are matrix products.

A stated query set meets all rows in blocks: candidates go to each query block and queries to
each candidate block. Best lists are merged in two steps, first over bundles of blocks.

Vectors that are missing, hold a missing or non-finite component, or have no id take no part.
Vectors are compared with vectors of the same length only. A repeated query row is answered
once; repeated candidate rows count each. Scores are exact; one past 64 bits is an error. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from aquagrid.llm.common import table

CANDIDATE_BLOCK, QUERY_BLOCK = 2_048, 1_024
BUNDLE = 64


def integer_vectors(vectors: DataFrame, key="vec_id", vector="embedding", scale=1024) -> DataFrame:
    """Usable rows as (id, v): floor(scale * x) of each component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x)
                   | (F.abs(x.cast("double")) == float("inf")))
    return (vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad)
            .select(F.col(key).alias("id"), F.transform(
                vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("bigint"))
                .alias("v")))


def _widest(x):
    """The greatest absolute value."""
    return max(int(x.max(initial=0)), -int(x.min(initial=0)))


def block_top(ids, exact, query_ids, exact_queries, k):
    """Top k of one block for every query: positions into ``ids`` and scores, by NRA.

    Vectors are whole numbers. Where a score may pass the whole numbers of doubles, bounds are
    widened by what doubles may lose, and final scores are taken in 64-bit integers; where those
    do not suffice either, in Python's."""
    n, width = exact.shape
    values, queries = exact.astype(np.float64), exact_queries.astype(np.float64)
    most = width * _widest(exact) * _widest(exact_queries)
    slack = np.zeros(len(queries))
    if most < 2 ** 53:
        exact, exact_queries = values, queries
    else:
        slack = np.abs(queries).sum(axis=1) * float(_widest(exact)) * width * 2.0 ** -50
        if most >= 2 ** 63:
            exact, exact_queries = exact.astype(object), exact_queries.astype(object)
    order = np.sort(values, axis=0)
    low, high = (order[0], order[-1]) if n else (None, None)
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    own = query_ids[:, None] == ids[None, :]
    best = {}

    def resolve(row, chosen):
        chosen = chosen[~own[row, chosen]]
        score = exact[chosen] @ exact_queries[row]
        first = (np.lexsort((ids[chosen], -score)) if score.dtype != object else
                 np.array(sorted(range(len(chosen)), key=lambda i: (-score[i], ids[chosen[i]])), int))[:k]
        best[row] = (chosen[first], score[first])

    open_rows, depth = np.arange(len(queries)), max(n // 32, 1)
    while len(open_rows) and n:
        depth = min(depth, n)
        front_high, front_low = order[n - depth], order[depth - 1]
        p, m = plus[open_rows].T, minus[open_rows].T
        upper = np.maximum(values, front_high) @ p + np.minimum(values, front_low) @ m
        lower = (np.where(values >= front_high, values, low) @ p
                 + np.where(values <= front_low, values, high) @ m)
        upper, lower = upper + slack[open_rows], lower - slack[open_rows]
        lower[own[open_rows].T] = -np.inf
        if n > k:
            reach = np.partition(lower, n - k, axis=0)[n - k]
        else:
            reach = np.full(len(open_rows), -np.inf)
        rivals = upper >= reach
        done = (rivals.sum(axis=0) <= max(8 * k, n // 16)) | (depth >= n)
        for i in np.flatnonzero(done):
            resolve(open_rows[i], np.flatnonzero(rivals[:, i]))
        open_rows, depth = open_rows[~done], depth * 2
    return best


def top_k(vectors: DataFrame, is_query, k=10, key="vec_id", vector="embedding",
          candidate_block=CANDIDATE_BLOCK, query_block=QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows where ``is_query`` (an expression over
    ``id``) holds, against all other rows; ties go to the smaller id."""
    rows = integer_vectors(vectors, key, vector).withColumn("dim", F.size("v"))
    queries = rows.filter(is_query).dropDuplicates(["id", "v"])
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    n_blocks = max(1, -(-sizes["n"] // candidate_block))
    q_blocks = max(1, -(-sizes["q"] // query_block))

    # the two sides share their source, so the queries get column names of their own
    queries = queries.select(F.col("id").alias("ask"), F.col("v").alias("wanted"),
                             F.size("v").alias("dim"))

    def dealt(df, names, own, n_own, other, n_other):
        slot = F.pmod(F.xxhash64(*names), F.lit(n_own)).cast("int")
        return df.withColumn(own, slot).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    keys = ["dim", "block", "query_block"]
    left = dealt(rows, ["id", "v"], "block", n_blocks, "query_block", q_blocks).groupBy(*keys)
    right = dealt(queries, ["ask", "wanted"], "query_block", q_blocks, "block", n_blocks).groupBy(*keys)

    def search(group, cands: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "block", "vec_id", "score"]
        if not len(cands) or not len(asks):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        width = int(group[0])
        values = np.array(cands["v"].to_list(), dtype=np.int64).reshape(len(cands), width)
        wanted = np.array(asks["wanted"].to_list(), dtype=np.int64).reshape(len(asks), width)
        ids, query_ids = cands["id"].to_numpy(np.int64), asks["ask"].to_numpy(np.int64)
        found = block_top(ids, values, query_ids, wanted, k)
        parts = [(np.full(len(at), query_ids[row]), ids[at], score)
                 for row, (at, score) in found.items() if len(at)]
        if not parts:
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in columns})
        q, v, s = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"query_id": q, "block": int(group[1]), "vec_id": v,
                             "score": s.astype(np.int64)})

    found = left.cogroup(right).applyInPandas(
        search, "query_id bigint, block bigint, vec_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("vec_id")]
    bundle = Window.partitionBy("query_id", "bundle").orderBy(*order)
    whole = Window.partitionBy("query_id").orderBy(*order)
    return (found.withColumn("bundle", F.floor(F.col("block") / BUNDLE))
            .withColumn("_r", F.row_number().over(bundle)).filter(F.col("_r") <= k)
            .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
with v as (select vec_id as id, list_transform(embedding,
             lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.id as query_id, c.id as vec_id,
        cast(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) as bigint)
          as score
      from (select distinct id, v from v where id % 100 = 0) q
      join v c on c.id <> q.id and len(c.v) = len(q.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank
      from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""


def op9(spark, folder):
    return top_k(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)
