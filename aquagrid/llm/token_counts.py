"""Token counts of whole texts by overlap resynchronisation.

A text of more than ``window`` characters is encoded in overlapping windows with offsets. Two
neighbours are spliced at a boundary that is proven stable for both: a place between a
character that is not a blank and a blank. The tokenizer's pattern starts a new match there in
every context, and what follows depends only on the text after it, so tokens before the place
are those of the left window and tokens after it those of the right one. Where an overlap has
no such place, the right window starts earlier (its overlap doubles) until one is found or the
window reaches back to the left one's start, which is exact too.

Texts within one window are one encoding. There the same fact lets a worker remember the
count of each blank-separated piece. A text with a blank outside ASCII or with ``<|`` (a
special token may lie in it) is handed to the library as it is.

A missing text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated rows. Other
columns of the input are ignored.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from aquagrid.llm.common import WordCache, as_bytes, by_batch, table, whole_text

WINDOW, OVERLAP = 65_536, 1_024
TOKENIZER = "byte_bpe_50k.json"

PIECES = re.compile(rb" ?\S+|\s+(?!\S)|\s+")
STABLE = re.compile(r"(?<=[^ \t\n\r\x0b\x0c])(?=[ \t\n\r\x0b\x0c])")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")    # a task has one core
ODD_ASCII = re.compile(rb"[\x1c-\x1f]")
#: UTF-8 beginnings of all blanks outside ASCII, and of special tokens.
ODD = (b"<|", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80\x80")


@lru_cache(maxsize=4)
def load(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kind = type(tokenizer.pre_tokenizer).__name__
    if kind != "ByteLevel" or tokenizer.normalizer is not None:
        raise ValueError(f"stable boundaries are proven for byte-level tokenizers only: {path}")
    return tokenizer


@lru_cache(maxsize=4)
def _counts(path):
    tokenizer = load(path)

    def compute(pieces):
        return [len(e) for e in tokenizer.encode_batch_fast(
            [p.decode() for p in pieces], add_special_tokens=False)]

    return WordCache(compute)


def _starts(tokenizer, text):
    return np.array([a for a, _ in tokenizer.encode(text, add_special_tokens=False).offsets],
                    dtype=np.int64)


def _common(text, low, high, left, left_from, right, right_from):
    """A stable place in (low, high) where both windows start a token."""
    for found in STABLE.finditer(text, low + 1, high):
        place = found.start()
        i = np.searchsorted(left, place - left_from)
        j = np.searchsorted(right, place - right_from)
        if (i < len(left) and left[i] + left_from == place
                and j < len(right) and right[j] + right_from == place):
            return place, int(i), int(j)
    return None


def spliced_count(tokenizer, text, window=WINDOW, overlap=OVERLAP):
    """Tokens of one text by overlapping windows."""
    begin, end = 0, min(window, len(text))
    left, total, skip = _starts(tokenizer, text[:end]), 0, 0
    while end < len(text):
        reach = overlap
        while True:
            start = max(end - reach, begin)
            stop = min(len(text), end + window)
            right = _starts(tokenizer, text[start:stop])
            if start == begin:      # the right window holds the left one whole
                place = (begin, 0, 0)
                break
            place = _common(text, start, end, left, begin, right, start)
            if place and place[1] >= skip:
                break
            reach *= 2
        if start > begin:
            total += place[1] - skip
            skip = place[2]
        begin, end, left = start, stop, right
    return total + len(left) - skip


def counter(path, window=WINDOW, overlap=OVERLAP):
    """A function from byte strings to their token counts."""
    tokenizer, cache = load(path), _counts(path)

    def count(texts):
        pieces, plain, out = [], [], [0] * len(texts)
        for n, raw in enumerate(texts):
            text = None if len(raw) <= window else raw.decode()
            if text is not None and len(text) > window:
                out[n] = spliced_count(tokenizer, text, window, overlap)
            elif ODD_ASCII.search(raw) or any(x in raw for x in ODD):
                out[n] = len(tokenizer.encode(raw.decode(), add_special_tokens=False))
            else:
                plain.append(n)
                pieces.append(PIECES.findall(raw))
        for first in range(0, len(plain), 500):
            some = pieces[first:first + 500]
            cache.prepare(set().union(*some))
            for n, own in zip(plain[first:first + 500], some):
                out[n] = sum(map(cache.__getitem__, own))
        return out

    return count


def count_tokens(docs: DataFrame, path=None, limit=1024, key="doc_id", text="text",
                 window=WINDOW, overlap=OVERLAP) -> DataFrame:
    """Key, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row."""
    path = path or public_tokenizers.path(TOKENIZER)
    source = docs.select(F.col(key), whole_text(text).alias("_text"))

    def run(batch):
        raw = as_bytes(batch.column(1))
        n = counter(path, window, overlap)(raw)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(n, pa.int64()),
             pa.array([x > limit for x in n], pa.bool_())],
            [key, "n_bytes", "n_tokens", "over_limit"])

    kind = source.schema[key].dataType.simpleString()
    return source.mapInArrow(
        by_batch(run), f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op6(spark, folder):
    return count_tokens(table(spark, folder, "documents"))
