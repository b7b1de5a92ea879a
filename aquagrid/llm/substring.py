"""Removal of repeated passages by compaction of a word de Bruijn graph.

A window of ``k`` words is an edge from the node of its first ``k - 1`` words to the node of its
last ``k - 1``. An edge is repeated if two documents (ids) hold it. A word goes if one of its
document's windows covers it that also starts in a document with a smaller id.

1. Rows are numbered into chunks of about 2 MB of text and written once, bucketed by chunk, so
   that text is never shuffled again: later steps send their answers to the chunks.
2. Anchors: of the 5-word shingles of every node the one with the least hash. Equal nodes have
   equal anchors, so a node whose anchor lies in one document only has no repeated edge. This
   lets go of most unrepeated text for a fifth of its shingles, and of nothing else.
3. Each remaining node goes, once for each chunk, to a block of nodes, with the word before and
   the word after. A block finds repeated edges, the least document of each, and the nodes where
   repeated edges branch, and answers each chunk with three bits a node.
4. In the chunks, runs of repeated edges between branching nodes compact to paths. Equal paths
   are joined on their first edge and length; the occurrence in the least document is the
   source, and a digest of the words of every occurrence has to agree with it.

What is sent is one entry for each chunk and node, so a passage held by a third of all documents
adds at most one entry a chunk. Edges are told apart by 96 hash bits and every path is held
against its source; a disagreement stops the job with an error, it never alters a result.

Missing texts have no words. Rows with a missing id keep all their words and remove none: no id
is smaller than theirs or greater. Rows with equal ids are one document's, and each is returned.
A text shorter than a window keeps all words. Memory grows with the longest single text (about
60 bytes a word), never with a group. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from aquagrid.llm.common import table, whole_text
from aquagrid.session import ensure_checkpoint_dir

WINDOW = 13
ANCHOR = 5
CHUNK_BYTES = 1 << 21
BLOCK_ENTRIES = 1 << 20
SEGMENT = 1 << 18           # bytes hashed at a time

REPEATED, SMALLER, BRANCH = 1, 2, 4
U = np.uint64
STEP, SECOND = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def _mix(x):
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def _tables():
    """A number for each byte, and powers of an odd base and of its inverse."""
    base = U(0xA0761D6478BD642F)
    inverse = U(pow(int(base), -1, 1 << 64))
    powers = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(SEGMENT, x)]))
              for x in (base, inverse)]
    return _mix(np.arange(1, 257, dtype=U) * STEP), *powers


def word_spans(raw):
    """Where each word of a byte string starts and ends."""
    data = np.frombuffer(raw, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw, starts, ends):
    """A 64-bit hash of each word, from running sums over segments of the text."""
    codes, powers, inverse = _tables()
    data, out, first = np.frombuffer(raw, np.uint8), np.zeros(len(starts), U), 0
    while first < len(starts):
        low = starts[first]
        last = max(int(np.searchsorted(ends, low + SEGMENT, "right")), first + 1)
        high = ends[last - 1]
        if high - low > SEGMENT:        # one word longer than a segment
            digest = hashlib.blake2b(raw[low:high], digest_size=8).digest()
            out[first] = np.frombuffer(digest, U)[0]
        else:
            sums = np.zeros(high - low + 1, U)
            np.cumsum(codes[data[low:high]] * powers[:high - low], out=sums[1:])
            a, b = starts[first:last] - low, ends[first:last] - low
            out[first:last] = _mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(U))
        first = last
    return out


def shingles(words, k, step=STEP):
    """A hash of every ``k`` neighbours."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out = out * step + words[j:n + j]
    return _mix(out)


class Chunk:
    """The words of a chunk's rows as one array, with the nodes that lie inside a row."""

    def __init__(self, ids, texts, k=WINDOW):
        self.k, self.ids = k, ids
        self.raw = b"\n".join(texts)
        self.starts, self.ends = word_spans(self.raw)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(self.starts, begin)        # of each row, and the end
        self.words = word_hashes(self.raw, self.starts, self.ends)
        known = np.array([i is not None for i in ids], bool)
        lens = np.diff(self.first)
        self.doc = np.repeat(np.array([i or 0 for i in ids], np.int64), lens)
        left = np.repeat(self.first[1:], lens) - np.arange(len(self.words))
        self.left = np.where(np.repeat(known, lens), left, 0)   # words to the row's end

    def anchors(self):
        """(hash of the anchor of each node, which nodes lie inside a row)."""
        wide = self.k - 1
        small = shingles(self.words, ANCHOR)
        n = max(len(self.words) - wide + 1, 0)
        least = small[:n].copy()
        for j in range(1, wide - ANCHOR + 1):
            np.minimum(least, small[j:n + j], out=least)
        return least, self.left[:n] >= wide

    def entries(self, wanted):
        """Places of the wanted nodes that touch a wanted edge, and their three hashes.
        ``wanted`` is per node; an edge needs both of its nodes."""
        n = len(wanted)
        edge = np.zeros(n + 1, bool)            # edge[i] starts at node i
        m = max(n - 1, 0)
        edge[:m] = wanted[:m] & wanted[1:] & (self.left[:m] >= self.k)
        before = np.concatenate([[False], edge[:n]])[:n]
        at = np.flatnonzero(edge[:n] | before)
        node = shingles(self.words, self.k - 1)[at]
        other = shingles(self.words, self.k - 1, SECOND)[at]
        last, first = self.words[np.minimum(at + self.k - 1, len(self.words) - 1)], self.words[at - 1]
        after = (_mix(other * STEP + last) >> U(32)).astype(np.uint32) | np.uint32(1)
        front = (_mix(other * SECOND + first) >> U(32)).astype(np.uint32) | np.uint32(1)
        return at, node, np.where(before[at], front, 0).astype(np.uint32), \
            np.where(edge[at], after, 0).astype(np.uint32)


def _runs(*keys):
    """Sorting order by the keys and the number of the run of each sorted place."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    return order, new


def _planes(array):
    """Bytes of numbers, most alike ones together."""
    return np.ascontiguousarray(array.view(np.uint8).reshape(len(array), -1).T).tobytes()


def _unplane(raw, kind, n):
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def _blocks(blocks, count):
    """(block, slice) of arrays sorted by hash; a block is a range of hashes."""
    edges = np.searchsorted(blocks, np.arange(count + 1))
    return [(b, slice(edges[b], edges[b + 1])) for b in range(count) if edges[b] < edges[b + 1]]


def _block_of(hashes, count):
    return ((hashes >> U(32)) * U(count) >> U(32)).astype(np.int64)


def _chunk_rows(keyed):
    rows = keyed.to_pydict()
    return Chunk(rows["doc_id"], rows["text"]), rows


def number(docs: DataFrame, key="doc_id", text="text", chunk_bytes=CHUNK_BYTES):
    """Rows (chunk, n, doc_id, text as bytes, words), written once and bucketed by chunk."""
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("bigint").alias("doc_id"),
                         whole_text(text).cast("binary").alias("text"))

    def run(batches):
        chunk, n, size = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            chunks, places, words = [], [], []
            for raw in batch.column(1).to_pylist():
                if size and size + len(raw) > chunk_bytes:
                    chunk, n, size = chunk + 1, 0, 0
                chunks.append(chunk)
                places.append(n)
                words.append(len(raw.split()))
                n, size = n + 1, size + len(raw) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array(places, pa.int32()), batch.column(0),
                 batch.column(1), pa.array(words, pa.int64())],
                ["chunk", "n", "doc_id", "text", "words"])

    name = f"chunks_{uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (source.mapInArrow(run, "chunk bigint, n int, doc_id bigint, text binary, words bigint")
     .write.bucketBy(buckets, "chunk").option("compression", "zstd")
     .option("path", f"{ensure_checkpoint_dir(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def _by_chunk(fn, *names):
    """A function of (chunk, rows, answers) for a cogroup, from one of (chunk number, rows,
    answers by block)."""
    def run(group, rows, answers):
        if not rows.num_rows:
            return pa.table({n: pa.array([], t) for n, t in names})
        told = dict(zip(answers["block"].to_pylist(), answers["answer"].to_pylist()))
        return fn(group[0].as_py(), rows, told)
    return run


ENTRY = (("block", pa.int64()), ("chunk", pa.int64()), ("size", pa.int64()), ("entries", pa.binary()))
ANSWER = "block bigint, chunk bigint, answer binary"


def _unique_anchors(part):
    """Sorted distinct anchors of a chunk with the least and greatest document of each."""
    least, inside = part.anchors()
    keys, doc = least[inside], part.doc[:len(inside)][inside]
    order, new = _runs(keys, doc)
    keys, doc = keys[order], doc[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else new
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(keys))[:len(first)] - 1
    return least, inside, keys[first], doc[first], doc[last]


def _send(chunk, blocks, count, *arrays):
    rows = [(b, chunk, s.stop - s.start, b"".join(_planes(a[s]) for a in arrays))
            for b, s in _blocks(blocks, count)]
    return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*rows) if rows else [[]] * 4, ENTRY)],
                    names=[n for n, _ in ENTRY])


def _receive(rows, *kinds):
    """Entries of all chunks of a block, and the chunk and size of each part."""
    parts = [[] for _ in kinds]
    sizes = rows["size"].to_pylist()
    for n, raw in zip(sizes, rows["entries"].to_pylist()):
        at = 0
        for i, kind in enumerate(kinds):
            width = np.dtype(kind).itemsize * n
            parts[i].append(_unplane(raw[at:at + width], kind, n))
            at += width
    return [np.concatenate(p) for p in parts], rows["chunk"].to_pylist(), sizes


def _reply(block, chunks, sizes, values, pack):
    cuts = np.split(values, np.cumsum(sizes)[:-1])
    return pa.table({"block": pa.array([block] * len(chunks), pa.int64()),
                     "chunk": pa.array(chunks, pa.int64()),
                     "answer": pa.array([pack(c) for c in cuts], pa.binary())})


def repeated_anchors(chunks, count):
    """(block, chunk, bits): which distinct anchors of a chunk lie in two documents."""
    def send(group, rows):
        part, _ = _chunk_rows(rows)
        _, _, keys, low, high = _unique_anchors(part)
        return _send(group[0].as_py(), _block_of(keys, count), count, keys, low, high)

    def judge(group, rows):
        (keys, low, high), own, sizes = _receive(rows, U, np.int64, np.int64)
        order, new = _runs(keys)
        at = np.flatnonzero(new)
        spread = np.minimum.reduceat(low[order], at) < np.maximum.reduceat(high[order], at)
        bits = np.zeros(len(keys), bool)
        bits[order] = spread[np.cumsum(new) - 1]
        return _reply(group[0].as_py(), own, sizes, bits, lambda x: np.packbits(x).tobytes())

    sent = chunks.groupBy("chunk").applyInArrow(
        send, "block bigint, chunk bigint, size bigint, entries binary")
    return sent.groupBy("block").applyInArrow(judge, ANSWER)


def _told_bits(told, blocks, count):
    bits = np.zeros(len(blocks), bool)
    for b, s in _blocks(blocks, count):
        bits[s] = np.unpackbits(np.frombuffer(told[b], np.uint8), count=s.stop - s.start)
    return bits


def _unique_nodes(part, told, count):
    """Distinct (node, before, after) of the chunk's nodes with a repeated anchor, the least
    document of each, whether it has another, and which entry each place belongs to."""
    least, inside, keys, _, _ = _unique_anchors(part)
    bits = _told_bits(told, _block_of(keys, count), count)
    wanted = np.zeros(len(least), bool)
    wanted[inside] = bits[np.searchsorted(keys, least[inside])]
    at, node, before, after = part.entries(wanted)
    order, new = _runs(node, before, after)
    number_of = np.empty(len(at), np.int64)
    number_of[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    doc = part.doc[at][order]
    low, high = ((np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first))
                 if len(first) else (doc, doc))
    pick = order[first]
    return at, number_of, node[pick], before[pick], after[pick], low, (low < high).astype(np.uint8)


def _edges(node, word, low, many):
    """For each entry: whether its edge (node, word) lies in two documents, and whether it also
    lies in a document smaller than the entry's least."""
    order, new = _runs(node, word)
    at, group = np.flatnonzero(new), np.cumsum(new) - 1
    least = np.minimum.reduceat(low[order], at)
    twice = (least < np.maximum.reduceat(low[order], at)) | (np.maximum.reduceat(many[order], at) > 0)
    real = word[order] > 0
    repeated, smaller = np.zeros(len(node), bool), np.zeros(len(node), bool)
    repeated[order] = twice[group] & real
    smaller[order] = (least[group] < low[order]) & real
    # repeated edges of each node, counted at the first entry of the edge
    distinct = np.zeros(len(node), np.int64)
    distinct[order] = (new & repeated[order]).astype(np.int64)
    return repeated, smaller, distinct


def judge_nodes(chunks, anchors, anchor_blocks, node_blocks):
    """(block, chunk, bytes): three bits for each distinct entry of a chunk."""
    def send(chunk, rows, told):
        part, _ = _chunk_rows(rows)
        _, _, node, before, after, low, many = _unique_nodes(part, told, anchor_blocks)
        return _send(chunk, _block_of(node, node_blocks), node_blocks, node, before, after, low, many)

    def judge(group, rows):
        (node, before, after, low, many), own, sizes = _receive(
            rows, U, np.uint32, np.uint32, np.int64, np.uint8)
        out, smaller, leaving = _edges(node, after, low, many)
        _, _, entering = _edges(node, before, low, many)
        order, new = _runs(node)
        at, group_of = np.flatnonzero(new), np.cumsum(new) - 1
        branch = ((np.add.reduceat(leaving[order], at) > 1)
                  | (np.add.reduceat(entering[order], at) > 1))
        bits = (out * REPEATED + smaller * SMALLER).astype(np.uint8)
        bits[order] |= (branch[group_of] * BRANCH).astype(np.uint8)
        return _reply(group[0].as_py(), own, sizes, bits, lambda x: x.tobytes())

    sent = chunks.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(
        _by_chunk(send, *ENTRY), "block bigint, chunk bigint, size bigint, entries binary")
    return sent.groupBy("block").applyInArrow(judge, ANSWER)


def _digest(part, a, b):
    raw = hashlib.sha256(b" ".join(part.raw[x:y] for x, y in zip(part.starts[a:b], part.ends[a:b])))
    return np.frombuffer(raw.digest()[:16], np.int64).tolist()


RESULT = (("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
          ("kept_sha256", pa.string()), ("gone", pa.list_(pa.int32())),
          ("paths", pa.list_(pa.struct([(c, pa.int64()) for c in (
              "node", "after", "start", "n", "d1", "d2")]))))
RESULT_TYPE = ("doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, gone array<int>, "
               "paths array<struct<node:bigint,after:bigint,start:bigint,n:bigint,d1:bigint,d2:bigint>>")


def cut(chunks, anchors, anchor_blocks, nodes, node_blocks):
    """Per row: counts, digest of the kept words, removed places as (start, end, start, ...), and
    the compacted paths of repeated edges it holds."""
    answers = (anchors.withColumn("block", -1 - F.col("block")).unionByName(nodes))

    def run(chunk, rows, told):
        part, columns = _chunk_rows(rows)
        n = len(part.words)
        at, entry, node, _, after, low, _ = _unique_nodes(
            part, {-1 - b: a for b, a in told.items() if b < 0}, anchor_blocks)
        bits = np.zeros(len(node), np.uint8)
        for b, s in _blocks(_block_of(node, node_blocks), node_blocks):
            bits[s] = np.frombuffer(told[b], np.uint8)
        own = bits[entry]
        repeated = (own & REPEATED) > 0
        gone_at = at[repeated & (((own & SMALLER) > 0) | (part.doc[at] > low[entry]))]
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, gone_at, 1)
        np.add.at(edge, np.minimum(gone_at + part.k, n), -1)
        removed = np.cumsum(edge[:n]) > 0
        # paths: runs of repeated edges, cut where the node between two of them branches
        places, codes = at[repeated], entry[repeated]
        joins = np.zeros(len(places), bool)
        joins[1:] = (places[1:] == places[:-1] + 1) & ((own[repeated][1:] & BRANCH) == 0)
        heads = np.flatnonzero(~joins)
        tails = np.append(heads[1:], len(places))[:len(heads)] - 1
        whose = np.searchsorted(part.first, places[heads], "right") - 1
        paths = [[] for _ in part.ids]
        for h, t, row in zip(heads.tolist(), tails.tolist(), whose.tolist()):
            a, b, e = int(places[h]), int(places[t]) + part.k, codes[h]
            d1, d2 = _digest(part, a, b)
            paths[row].append({"node": int(node[e].astype(np.int64)), "after": int(after[e]),
                               "start": a - int(part.first[row]), "n": b - a, "d1": d1, "d2": d2})
        out = []
        for i, key in enumerate(part.ids):
            a, b = int(part.first[i]), int(part.first[i + 1])
            mask = removed[a:b]
            keep = np.flatnonzero(~mask) + a
            sha = hashlib.sha256(b" ".join(
                part.raw[x:y] for x, y in zip(part.starts[keep].tolist(), part.ends[keep].tolist())))
            turns = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            out.append((key, b - a, int(mask.sum()), sha.hexdigest(), turns.tolist(), paths[i]))
        return pa.table([pa.array(c, t) for c, (_, t) in zip(zip(*out), RESULT)],
                        names=[c for c, _ in RESULT])

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _by_chunk(run, *RESULT), RESULT_TYPE)


def _occurrences(rows):
    return rows.select("doc_id", F.inline("paths"))


def sources(rows):
    """One row for each compacted path: its source, the occurrence in the least document, how
    often it occurs, and whether the words of all occurrences agree."""
    keys = ["node", "after", "n"]
    found = _occurrences(rows)
    least = found.groupBy(*keys).agg(
        F.min("doc_id").alias("source"), F.count("*").alias("times"),
        ((F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2"))).alias("verified"))
    return least


def repeated_spans(docs: DataFrame, key="doc_id", text="text"):
    """(doc_id, start, n, source, source_start): every compacted repeated path of every document,
    joined to its source coordinates."""
    rows = remove_repeats(docs, key, text)
    found = _occurrences(rows)
    keys = ["node", "after", "n"]
    at_source = (found.join(sources(rows).withColumnRenamed("source", "doc_id"), [*keys, "doc_id"])
                 .groupBy(*keys).agg(F.min("doc_id").alias("source"), F.min("start").alias("source_start")))
    return found.join(at_source, keys).select("doc_id", "start", "n", "source", "source_start")


def remove_repeats(docs: DataFrame, key="doc_id", text="text", chunk_bytes=CHUNK_BYTES):
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256, the removed
    places and the repeated paths. Written once, as its paths are verified from it."""
    spark = docs.sparkSession
    chunks = number(docs, key, text, chunk_bytes)
    words = chunks.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    anchor_blocks = max(1, words // (4 * BLOCK_ENTRIES) + 1)
    node_blocks = max(1, words // BLOCK_ENTRIES + 1)
    folder = f"{ensure_checkpoint_dir(spark)}/repeats-{uuid4().hex}"

    def kept(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    anchors = kept(repeated_anchors(chunks, anchor_blocks), "anchors")
    nodes = kept(judge_nodes(chunks, anchors, anchor_blocks, node_blocks), "nodes")
    return kept(cut(chunks, anchors, anchor_blocks, nodes, node_blocks), "rows")


ORACLE = r"""
with w as (select row_number() over () as r, doc_id, list_filter(
             string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws
           from documents),
g as (select r, doc_id, unnest(range(len(ws) - 12)) as i, ws from w where len(ws) >= 13),
e as (select r, doc_id, i, array_to_string(list_slice(ws, i + 1, i + 13), ' ') as win from g),
f as (select win, min(doc_id) as least from e group by win),
hit as (select distinct r, unnest(range(i, i + 13)) as p from e join f using (win)
        where least < doc_id),
gone as (select r, list(p) as ps from hit group by r),
k as (select doc_id, ws, coalesce(ps, []) as ps from w left join gone using (r))
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ps) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(len(ws)),
    lambda i: not list_contains(ps, i)), lambda i: ws[i + 1]), ' '), '')) as kept_sha256
from k
"""


def op11(spark, folder):
    rows = remove_repeats(table(spark, folder, "documents"))
    wrong = sources(rows).filter(~F.col("verified")).agg(F.count("*")).scalar()
    checked = F.when(wrong > 0, F.raise_error("paths of equal hashes differ in words").cast("long"))
    return rows.select("doc_id", "n_words", F.coalesce(checked, "n_removed").alias("n_removed"),
                       "kept_sha256")
