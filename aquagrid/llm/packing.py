"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first, and its nearly full bins are
final. Underfull bins are items of the next round: they meet in a sixteenth of the partitions
and are packed best-fit again, and so on up a tree. A round never has fewer partitions than
its bins need (``bins_per_task``), so no task's share grows with the data; the tree ends when
one partition is left or a round no longer saves bins. A bin travels as one row that lists its
pieces, so places inside a bin only shift when it is laid into another.

Only documents longer than a bin are cut, into bin-sized pieces; the last may be shorter.
A missing text counts as empty, which is one piece holding the end id alone. Repeated rows are
packed each. Equal lengths are taken in order of id and piece, so results do not depend on how
rows arrive. Other columns of the input are ignored; an empty table gives no sequence.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from aquagrid.llm.common import WordCache, as_bytes, slices, table, whole_text
from aquagrid.session import cut_lineage

TOKENIZER = "word_bpe_49k.json"
CAPACITY, END_ID = 4096, 1
FAN_IN, BINS_PER_TASK, NEARLY_FULL = 16, 20_000, 63 / 64

WORD_END = "\0"
PLAIN = re.compile(r"[!-~\xa1-\xff]+")


@lru_cache(maxsize=2)
def _byte_of():
    """The byte-level alphabet: printable bytes stand for themselves, the rest for 256 and up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def word_ids(path):
    """A cache from words (blank-free byte strings) to their packed little-endian ids.

    Words of ASCII and Latin-1 letters, digits and signs are merged by a rank table built from
    the tokenizer's own vocabulary, whose ids are its merge order, with the end of a word as
    a byte of its own; all other words go through the library.
    """
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path) as file:
        spec = json.load(file)
    byte_of, ranks = _byte_of(), {}
    for token, number in spec["model"]["vocab"].items():
        body, end = (token[:-4], b"\0") if token.endswith("</w>") else (token, b"")
        ranks[bytes(byte_of[c] for c in body) + end] = number
    merger = tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks,
                               special_tokens={})._core_bpe
    split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    matches = regex.compile(split)

    def compute(words):
        out, odd = [None] * len(words), []
        for i, word in enumerate(words):
            text = word.decode()
            tail = text[-1] if text[-1] in ".,!" else ""
            body = text[:-1] if tail else text
            if not (body.isalpha() and body.isascii()):     # all but the plainest words
                if not PLAIN.fullmatch(text) or "<|" in text:
                    odd.append(i)
                    continue
                if not body.isalpha():
                    body, tail = WORD_END.join(matches.findall(text.lower())), ""
            marked = body.lower() + WORD_END + (tail and tail + WORD_END)
            out[i] = array("I", merger.encode_ordinary(marked)).tobytes()
        if odd:
            found = library.encode_batch_fast([words[i].decode() for i in odd],
                                              add_special_tokens=False)
            for i, e in zip(odd, found):
                out[i] = array("I", e.ids).tobytes()
        return out

    return WordCache(compute)


def encode(path, texts, end_id=END_ID):
    """Packed ids of every text (bytes), the end id included."""
    cache, end = word_ids(path), end_id.to_bytes(4, "little")
    for first in range(0, len(texts), 500):
        words = [t.split() for t in texts[first:first + 500]]
        cache.prepare(set().union(*words))
        for own in words:
            yield b"".join(map(cache.__getitem__, own)) + end


def best_fit(lengths, capacity):
    """Bin number of every item. Items are taken longest first; each goes to the fullest bin
    that has room. Open bins are stacked by free room, and one integer with a bit per
    non-empty stack finds the right one."""
    stacks = [[] for _ in range(capacity + 1)]
    held, bins, where = 0, 0, [0] * len(lengths)
    for i in np.argsort(-np.asarray(lengths), kind="stable").tolist():
        size = int(lengths[i])
        fits = held >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = stacks[free].pop()
            if not stacks[free]:
                held ^= 1 << free
        else:
            number, free = bins, capacity
            bins += 1
        where[i] = number
        left = free - size
        if left:
            if not stacks[left]:
                held |= 1 << left
            stacks[left].append(number)
    return np.array(where, dtype=np.int64), bins


def _pack(items: pa.Table, capacity):
    """Items (``used`` and their list of pieces) packed into fewer of the same."""
    items = items.combine_chunks()
    used = items["used"].to_numpy()
    pieces = items["pieces"].combine_chunks()
    pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
    values, bounds = pieces.flatten(), pieces.offsets.to_numpy() - pieces.offsets[0].as_py()
    where, bins = best_fit(used, capacity)
    order = np.argsort(where, kind="stable")
    counts, sizes = np.diff(bounds)[order], used[order]
    totals = np.bincount(where, weights=used, minlength=bins).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(totals)[:-1]]) if bins else np.zeros(0, np.int64)
    shift = np.concatenate([[0], np.cumsum(sizes)[:-1]]) - first[where[order]]
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    index = np.repeat(bounds[:-1][order] - starts, counts) + np.arange(counts.sum())
    taken = values.take(pa.array(index))
    fields = {f.name: taken.field(f.name) for f in taken.type}
    fields["offset"] = pa.array(fields["offset"].to_numpy() + np.repeat(shift, counts))
    lists = np.concatenate([[0], np.cumsum(np.bincount(where[order], weights=counts,
                                                       minlength=bins))]).astype(np.int32)
    merged = pa.ListArray.from_arrays(pa.array(lists), pa.StructArray.from_arrays(
        list(fields.values()), names=list(fields)))
    return pa.table({"used": pa.array(totals), "pieces": merged})


def _schema(kind):
    return (f"used bigint, pieces array<struct<doc: {kind}, piece: int, start: bigint, "
            "length: bigint, ids_crc32: bigint, offset: bigint>>")


def _first_round(path, capacity, end_id):
    def run(batches):
        parts = []
        for batch in slices(batches):
            rows, piece, start, length, crc = [], [], [], [], []
            for row, ids in enumerate(encode(path, as_bytes(batch.column(1)), end_id)):
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at:at + 4 * capacity]
                    rows.append(row)
                    piece.append(number)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
            parts.append(pa.table({
                "doc": batch.column(0).take(pa.array(rows, pa.int64())),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}))
        if not parts or not sum(map(len, parts)):
            return
        flat = pa.concat_tables(parts)
        flat = flat.sort_by([("length", "descending"), ("doc", "ascending"),
                             ("piece", "ascending")]).combine_chunks()
        flat = flat.append_column("offset", pa.array(np.zeros(len(flat), np.int64)))
        struct = pa.StructArray.from_arrays(
            [flat[c].combine_chunks() for c in flat.column_names], names=flat.column_names)
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32)), struct)
        yield from _pack(pa.table({"used": flat["length"], "pieces": one}),
                         capacity).to_batches(max_chunksize=2_000)
    return run


def _later_round(capacity):
    def run(batches):
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        items = pa.concat_tables(parts)
        lead = pc.list_element(items["pieces"], 0).combine_chunks()
        names = ["doc", "piece", "ids_crc32"]
        keys = pa.table([pc.struct_field(lead, n) for n in names], names=names)
        by = pc.sort_indices(keys, [(n, "ascending") for n in names])
        yield from _pack(items.take(by), capacity).to_batches(max_chunksize=2_000)
    return run


def pack(docs: DataFrame, path=None, capacity=CAPACITY, end_id=END_ID, key="doc_id",
         text="text", fan_in=FAN_IN, bins_per_task=BINS_PER_TASK,
         nearly_full=NEARLY_FULL) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    path = path or public_tokenizers.path(TOKENIZER)
    source = docs.select(F.col(key).alias("doc"), whole_text(text).alias("text"))
    schema = _schema(source.schema["doc"].dataType.simpleString())
    bins = cut_lineage(source.mapInArrow(_first_round(path, capacity, end_id), schema))
    tasks, done = max(1, bins.rdd.getNumPartitions()), []
    full = F.col("used") >= int(capacity * nearly_full)
    number, before = 0, None
    while True:
        open_bins = bins.filter(~full)
        n = open_bins.count()
        # a single partition, or a round that saved nothing, ends the tree
        if tasks == 1 or n < 2 or (before is not None and n > 0.998 * before
                                   and tasks <= -(-n // bins_per_task)):
            break
        done.append(bins.filter(full))
        tasks, before = max(-(-tasks // fan_in), -(-n // bins_per_task)), n
        lead = F.col("pieces")[0]
        place = F.xxhash64(lead["doc"], lead["piece"], lead["ids_crc32"], F.lit(number))
        bins = cut_lineage(open_bins.repartition(tasks, place)
                           .mapInArrow(_later_round(capacity), schema))
        number += 1
    for part in done:
        bins = bins.unionByName(part)
    # the bins are stored, so the numbers are the same whenever they are read
    return (bins.withColumn("sequence_id", F.monotonically_increasing_id())
            .select("sequence_id", F.explode("pieces").alias("p"))
            .select(F.col("p.doc").alias(key), "p.piece", "p.start", "p.length", "p.ids_crc32",
                    "sequence_id", "p.offset"))


def op2(spark, folder):
    return pack(table(spark, folder, "documents"))
