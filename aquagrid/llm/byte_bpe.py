"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until a part has at most ``leaf`` characters. Leaves are encoded on their own
and neighbours are joined: a window around the seam grows on both sides until each of its ends
is the end of the part or a place where the pattern starts a new match in every context (after
a letter, a digit or any other non-blank comes a blank; after a letter comes no letter; after
a digit comes no digit). Outside such a window no match, hence no token, depends on the other
part, so only the window is encoded again. The join is associative with the empty text as its
unit: any split gives the same ids. Decoding concatenates the bytes of halves up a tree.

A missing text counts as empty: no ids. Repeated rows give repeated rows. Other columns of the
input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from aquagrid.llm.common import by_batch, table, whole_text

LEAF = 512
FIRST_WINDOW = 32
RANKS = "byte_bpe_multi_50k.tiktoken"
STABLE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=[^\p{L}\s])|(?<=\p{N})(?=[^\p{N}\s])")


@lru_cache(maxsize=4)
def load(path, pattern=public_tokenizers.PATTERN):
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _digits(size):
    return [str(i) for i in range(size)]


def _window(text, low, seam, high):
    """The smallest window around the seam that ends at stable places, by doubling."""
    reach = FIRST_WINDOW
    while True:
        start = max(low, seam - reach)
        found = None if start == low else STABLE.search(text, start, seam)
        if found or start == low:
            a = found.start() if found else low
            break
        reach *= 2
    reach = FIRST_WINDOW
    while True:
        stop = min(high, seam + reach)
        # a place counts only with the character after it in sight
        found = [m.start() for m in STABLE.finditer(text, seam, stop) if m.start() > seam]
        if found or stop == high:
            return a, (found[-1] if found else high)
        reach *= 2


def encode(encoding, text, leaf=LEAF):
    """Ids of one text."""
    def node(low, high):
        if high - low <= max(leaf, 1):
            return encoding.encode_ordinary(text[low:high])
        seam = (low + high) // 2
        left, right = node(low, seam), node(seam, high)
        a, z = _window(text, low, seam, high)
        cut = len(left) - len(encoding.encode_ordinary(text[a:seam]))
        skip = len(encoding.encode_ordinary(text[seam:z]))
        return left[:cut] + encoding.encode_ordinary(text[a:z]) + right[skip:]

    return node(0, len(text))


def decode(encoding, ids, leaf=LEAF):
    """Bytes of a list of ids."""
    if len(ids) <= max(leaf, 1):
        return encoding.decode_bytes(ids)
    half = len(ids) // 2
    return decode(encoding, ids[:half], leaf) + decode(encoding, ids[half:], leaf)


def encode_documents(docs: DataFrame, path=None, key="doc_id", text="text", leaf=LEAF) -> DataFrame:
    """Key and ``ids`` (array of int) of every row."""
    path = path or public_tokenizers.path(RANKS)
    source = docs.select(F.col(key), whole_text(text).alias("_text"))

    def run(batch):
        encoding = load(path)
        ids = [encode(encoding, t, leaf) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(by_batch(run), f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path=None, key="doc_id", ids="ids", leaf=LEAF) -> DataFrame:
    """Key and ``decoded`` (binary) of every row; missing ids count as none."""
    path = path or public_tokenizers.path(RANKS)
    source = encoded.select(F.col(key), F.col(ids))

    def run(batch):
        encoding = load(path)
        out = [decode(encoding, x or [], leaf) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                          [key, "decoded"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(by_batch(run), f"`{key}` {kind}, decoded binary")


def digest(docs: DataFrame, path=None, key="doc_id", text="text", leaf=LEAF) -> DataFrame:
    """Token count and digests of ids and of the decoded bytes, without the ids leaving the
    task that made them."""
    path = path or public_tokenizers.path(RANKS)
    source = docs.select(F.col(key), whole_text(text).alias("_text"))

    def run(batch):
        encoding = load(path)
        names = _digits(encoding.n_vocab)
        counts, of_ids, of_bytes = [], [], []
        for t in batch.column(1):
            ids = encode(encoding, t.as_py(), leaf)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(
                ",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(decode(encoding, ids, leaf)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
             pa.array(of_bytes, pa.string())],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(
        by_batch(run), f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op10(spark, folder):
    return digest(table(spark, folder, "documents"))
