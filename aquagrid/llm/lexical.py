"""Ranked lexical search for many items at once, with common parts of the items shared.

Terms are runs of ASCII letters, digits and characters outside ASCII; A-Z are lower-cased. An
item's score for a document is a sum over the item's terms, in whole numbers throughout.

Items are taken in blocks with a bounded number of terms. For each block:

1. One pass counts, in every task, the documents, terms and document frequencies; Spark adds the
   counts. Only numbers of the block's own terms come back.
2. Shared term sets are mined: terms that occur in the same items form one class. The classes of
   an item, commonest first, are a sequence; the neighbours that occur together most often over
   all items become a node of their own, again and again. Items end as sums of few nodes: a graph
   in which every common part occurs once.
3. A second pass gives every document one accumulator a class, adds up the graph from the
   classes to the items, and keeps each task's best documents of every item. Spark merges those
   lists. A document and an item never make a row unless the document is among a task's best.

Missing texts have no terms. Rows of one item id are one item with the terms of all of them; a
missing item id is an id. Items without terms have no rows. Repeated document rows count each.
Rows with a missing document id count in the statistics but are not returned. Equal scores go to
the smaller id. No document with a term, or no item: no rows. Other columns are ignored. Whole
texts are read; memory grows with the longest text and a block's terms, not with the tables.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aquagrid.llm.common import as_bytes, table, whole_text

BLOCK_TERMS = 50_000        # distinct terms of a block of items; one larger item is a block
TOP = 10
ROWS = 256                  # documents whose accumulators are held at once
BUNDLES = 64

_LETTERS = bytes(range(ord("0"), ord("9") + 1)) + bytes(range(ord("a"), ord("z") + 1))
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
FOLD = bytes(c if c in _LETTERS or c > 127 else c + 32 if c in _CAPITALS else 32 for c in range(256))


def terms(raw):
    """The terms of UTF-8 bytes."""
    return raw.translate(FOLD).split()


class Graph:
    """Items as sums of shared nodes. Nodes 0..classes-1 are classes of terms; node
    ``classes + i`` is the sum of the two nodes ``steps[i]``; ``items[j]`` is item j's node
    list, added up into one row at the end."""

    def __init__(self, item_terms):
        self.terms = sorted(set().union(*item_terms)) if item_terms else []
        holders = defaultdict(list)
        for j, own in enumerate(item_terms):
            for t in own:
                holders[t].append(j)
        groups = defaultdict(list)
        for t in self.terms:
            groups[tuple(holders[t])].append(t)
        shared = sorted(groups, key=lambda js: (-len(js), js))
        self.classes = len(shared)
        self.class_of = {t: c for c, js in enumerate(shared) for t in groups[js]}
        sequences = [[] for _ in item_terms]
        for c, js in enumerate(shared):             # commonest first in every item
            for j in js:
                sequences[j].append(c)
        self.steps = self._merge(sequences)
        self.items = sequences

    def _merge(self, sequences):
        """Replace the commonest pair of neighbours by a node of its own until none is shared."""
        where = defaultdict(set)
        for j, s in enumerate(sequences):
            for pair in zip(s, s[1:]):
                where[pair].add(j)
        heap = [(-len(js), pair) for pair, js in where.items() if len(js) > 1]
        heapq.heapify(heap)
        steps = []
        while heap:
            count, pair = heapq.heappop(heap)
            js = where.get(pair, ())
            if len(js) != -count:                   # out of date
                if len(js) > 1:
                    heapq.heappush(heap, (-len(js), pair))
                continue
            node, touched = self.classes + len(steps), set()
            steps.append(pair)
            for j in list(js):
                s = sequences[j]
                at = next(i for i in range(len(s)) if (s[i], s[i + 1]) == pair)
                for old in zip(s[max(at - 1, 0):at + 2], s[max(at - 1, 0) + 1:at + 3]):
                    where[old].discard(j)
                s[at:at + 2] = [node]
                for new in zip(s[max(at - 1, 0):at + 1], s[max(at - 1, 0) + 1:at + 2]):
                    where[new].add(j)
                    touched.add(new)
            for new in touched:
                if len(where[new]) > 1:
                    heapq.heappush(heap, (-len(where[new]), new))
        return steps

    def totals(self, accumulators):
        """Scores (items x documents) from the classes' accumulators (classes x documents)."""
        rows = np.empty((self.classes + len(self.steps), accumulators.shape[1]), np.int64)
        rows[:self.classes] = accumulators
        for i, (a, b) in enumerate(self.steps, self.classes):
            np.add(rows[a], rows[b], out=rows[i])
        return np.stack([rows[s].sum(axis=0) for s in self.items])


def _counted(texts, number_of):
    """(document, term number, count) arrays of the block's terms, and terms of each text."""
    doc, term, tf, sizes = [], [], [], []
    for i, raw in enumerate(texts):
        own = terms(raw)
        sizes.append(len(own))
        found = Counter(map(number_of.get, own))
        found.pop(None, None)
        doc += [i] * len(found)
        term += found.keys()
        tf += found.values()
    return (np.array(doc, np.int64), np.array(term, np.int64), np.array(tf, np.int64),
            np.array(sizes, np.int64))


def _slices(batches, rows=ROWS):
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            piece = batch.slice(first, rows)
            yield piece.column(0).to_pylist(), as_bytes(piece.column(1))


def statistics(source, number_of):
    """(documents with a term, terms, {term number: documents}) over all rows."""
    size = len(number_of)

    def run(batches):
        df, n, length = np.zeros(size, np.int64), 0, 0
        for _, texts in _slices(batches):
            _, term, _, sizes = _counted(texts, number_of)
            df += np.bincount(term, minlength=size)
            n, length = n + int((sizes > 0).sum()), length + int(sizes.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([n, length, *df[held].tolist()], pa.int64())],
            ["term", "n"])

    rows = source.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}     # at most the block's terms and two
    return found.pop(-2, 0), found.pop(-1, 0), found


def _best(items, ids, scores, top):
    """Rows of each item's best, from flat arrays."""
    order = np.lexsort((ids, -scores, items))
    items, ids, scores = items[order], ids[order], scores[order]
    start = np.flatnonzero(np.concatenate([[True], items[1:] != items[:-1]])) if len(items) else items
    rank = np.arange(len(items)) - np.repeat(start, np.diff(np.append(start, len(items))))
    keep = rank < top
    return items[keep], ids[keep], scores[keep]


def search_block(source, item_terms, top=TOP) -> DataFrame:
    """(item, doc_id, score): each task's best documents of a block's items."""
    graph = Graph(item_terms)
    number_of = {t: i for i, t in enumerate(graph.terms)}
    class_of = np.array([graph.class_of[t] for t in graph.terms], np.int64)
    n_docs, n_terms, df = statistics(source, number_of)
    weight = np.array([np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1)))
                       for i in range(len(number_of))]).astype(np.int64)

    def run(batches):
        items, ids, scores = (np.zeros(0, np.int64) for _ in range(3))
        bar = np.ones(len(item_terms), np.int64)        # the score a newcomer must reach
        for keys, texts in _slices(batches):
            doc, term, tf, sizes = _counted(texts, number_of)
            long = 100 - 90 + (90 * sizes * n_docs) // max(n_terms, 1)
            part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * long[doc]))
            accumulators = np.zeros((graph.classes, len(texts)), np.int64)
            np.add.at(accumulators, (class_of[term], doc), part)
            total = graph.totals(accumulators)
            total[:, [k is None for k in keys]] = 0
            item, at = np.nonzero(total >= bar[:, None])
            if len(item):
                names = np.array([k or 0 for k in keys], np.int64)
                items, ids, scores = _best(np.concatenate([items, item]), np.concatenate([ids, names[at]]),
                                           np.concatenate([scores, total[item, at]]), top)
                count = np.bincount(items, minlength=len(bar))
                last = np.cumsum(count) - 1
                bar = np.where(count == top, scores[last.clip(0)], 1) if len(items) else bar
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (items, ids, scores)],
                                         ["item", "doc_id", "score"])

    return source.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def item_blocks(items: DataFrame, key="item_id", text="text", block_terms=BLOCK_TERMS):
    """Blocks of (item id, its distinct terms), read in the order of ids."""
    block, held = [], set()
    rows = items.select(F.col(key).alias("item"), whole_text(text).alias("text"))
    united = rows.groupBy("item").agg(F.collect_set("text").alias("texts")).orderBy("item")
    for row in united.toLocalIterator():
        own = set().union(*(terms(t.encode()) for t in row["texts"]))
        if not own:
            continue
        if block and len(held | own) > block_terms:
            yield block
            block, held = [], set()
        block.append((row["item"], own))
        held |= own
    if block:
        yield block


def ranked(found: DataFrame, top=TOP):
    """Ranks 1..top of each item from lists of many tasks, merged in two steps."""
    order = [F.col("score").desc(), F.col("doc_id")]
    some = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(BUNDLES))).orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    return (found.withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= top)
            .withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= top))


def search(docs: DataFrame, items: DataFrame, key="doc_id", text="text", item_key="item_id",
           item_text="text", top=TOP, block_terms=BLOCK_TERMS) -> DataFrame:
    """(item id, rank, doc_id, score) of each item's best documents."""
    spark = docs.sparkSession
    kind = items.schema[item_key].dataType.simpleString()
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole_text(text).alias("text"))
    out = spark.createDataFrame([], f"`{item_key}` {kind}, rank int, doc_id bigint, score bigint")
    for block in item_blocks(items, item_key, item_text, block_terms):
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(block)],
                                      f"item bigint, `{item_key}` {kind}")
        best = ranked(search_block(source, [own for _, own in block], top), top)
        out = out.unionByName(best.join(names, "item").select(item_key, "rank", "doc_id", "score"))
    return out


ORACLE = r"""
with t as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
i as (select distinct item_id, unnest(regexp_extract_all(translate(text,
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select count(*) as n_docs, cast(sum(len(ts)) as bigint) as n_terms from t where len(ts) > 0),
p as (select r, term, count(*) as tf from (select r, unnest(ts) as term from t)
      where term in (select term from i) group by r, term),
w as (select term, cast(floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1))) as bigint) as w
      from p, s group by term, n_docs),
x as (select i.item_id, p.r, cast(sum(w.w * ((1000000000 * p.tf) //
        (1000 * p.tf + 8 * (100 - 90 + (90 * len(t.ts) * s.n_docs) // s.n_terms)))) as bigint) as score
      from i join p using (term) join w using (term) join t using (r), s group by i.item_id, p.r),
k as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
      from x join t using (r) where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from k where rank <= 10
"""


def op12(spark, folder):
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
