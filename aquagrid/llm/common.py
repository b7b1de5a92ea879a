"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import weakref
from itertools import filterfalse
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from aquagrid.session import stored  # noqa: F401  (handed on to the operators)

#: Word separators: the six ASCII blanks. ``bytes.split()`` cuts at exactly these.
BLANKS = r"[\x20\x09-\x0D]+"
CACHE_BYTES = 64 << 20      # what a worker keeps in a word cache before it starts a new one
ROWS = 1_000                # rows of a batch that are turned into Python values at a time


def table(spark, folder, name) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_slot(key, modulus) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a missing id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(modulus))


def whole_text(text="text") -> Column:
    """The text, empty where it is missing."""
    return F.coalesce(F.col(text), F.lit(""))


def as_bytes(column):
    """An Arrow string column as a list of UTF-8 byte strings, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def give_back():
    """Hand freed memory back to the system. A worker outlives its task; what its allocators keep
    would be added to the memory of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc only
    if trim:
        trim(0)


def slices(batches, rows=ROWS):
    """Parts of the batches of at most ``rows`` rows. At the end of the task, which the worker
    outlives, word caches are emptied and freed memory is given back."""
    try:
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                yield batch.slice(first, rows)
    finally:
        batch = None
        WordCache.forget()
        give_back()


def by_batch(fn):
    """An iterator function for ``mapInArrow`` from a function of one record batch."""
    def run(batches):
        for batch in slices(batches):
            yield fn(batch)
    return run


class WordCache(dict):
    """word -> value, filled for a whole batch at a time and bounded in bytes. When half of the
    bound is full the words become the old generation, which is asked before a value is computed
    anew and dropped at the next turn; so results never depend on the cache, only time does."""

    live = weakref.WeakValueDictionary()

    def __init__(self, compute, limit=CACHE_BYTES):
        super().__init__()
        self.compute, self.limit, self.size, self.old = compute, limit, 0, {}
        WordCache.live[id(self)] = self

    @classmethod
    def forget(cls):
        for cache in list(cls.live.values()):
            cache.clear()
            cache.size, cache.old = 0, {}

    def prepare(self, words):
        """Make sure every word of the set ``words`` has a value."""
        missing = list(filterfalse(self.__contains__, words))
        if not missing:
            return
        if 2 * self.size > self.limit:
            self.old = dict(self)
            self.clear()
            self.size, missing = 0, list(words)
        new = list(filterfalse(self.old.__contains__, missing))
        values = dict(zip(new, self.compute(new))) if new else {}
        if len(new) < len(missing):
            values.update((w, self.old[w]) for w in missing if w not in values)
        self.update(values)
        self.size += sum(map(getsizeof, values)) + 100 * len(values) + sum(
            getattr(v, "nbytes", len(v) if isinstance(v, bytes) else 0)
            for v in values.values() if v is not None)
