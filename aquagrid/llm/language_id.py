"""Language identification by rank-order profiles.

A language's profile is its most frequent letter n-grams (1 to 3 characters, words padded with
one blank on each side), in order, counted over all training texts. A document's own ranking
is compared with each profile by the out-of-place distance: how far each of its n-grams sits
from its place in the profile, or the profile's length where it is absent.

n-grams are 63-bit numbers (21 bits a character), so a text is ranked by array operations.
Counts are taken per distinct word first and summed by Spark; only profiles (``depth`` n-grams
for each language) reach the driver.

Equal counts are ranked by n-gram, equal distances go to the language first in order. A text
that is missing or has no letter is ``und`` with score 0, as is every text where there is no
profile. Rows with a missing language do not train. Repeated rows count each; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aquagrid.llm.common import as_bytes, by_batch, id_slot, slices, table, whole_text

DEPTH = 400
BLANK = 0x5F
UNDECIDED = "und"
DISTINCT_WORDS = 300_000    # words a task counts before it sends its n-grams
WORDS_AT_ONCE = 20_000      # words whose n-grams are held at a time


@lru_cache(maxsize=1)
def _letters():
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _codes(text):
    """Letters of the text with single blanks around words, whether each is a letter, and the
    place of each in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]             # a blank only right after a letter
    place = np.flatnonzero(keep)
    is_letter = letter[place]
    codes = np.where(is_letter, raw[place], BLANK).astype(np.int64)
    # one blank in front, and one behind where the text ends with a letter
    ends = int(len(is_letter) > 0 and is_letter[-1])
    padded = [np.full(len(x) + 1 + ends, fill, x.dtype)
              for x, fill in ((codes, BLANK), (is_letter, False), (place, 0))]
    for whole, x in zip(padded, (codes, is_letter, place)):
        whole[1:len(x) + 1] = x
    return padded


def ngrams(text):
    """All n-grams of a text as numbers, and the place in the text of a letter of each."""
    codes, letter, place = _codes(text)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    two = (codes[:-1] << 21) | codes[1:]
    three = (two[:-1] << 21) | codes[2:]
    middle = letter[1:-1]
    at_two = np.where(letter[:-1], place[:-1], place[1:])      # a letter of the pair
    return (np.concatenate([codes[letter], two, three[middle]]),
            np.concatenate([place[letter], at_two, place[1:-1][middle]]))


def ranked(text, depth):
    """The text's most frequent n-grams, by count and then number."""
    found, counts = np.unique(ngrams(text)[0], return_counts=True)
    return found[np.lexsort((found, -counts))[:depth]]


def _summed(grams, weights):
    """Distinct n-grams in order and the sum of their weights."""
    order = np.argsort(grams)
    grams, weights = grams[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]])) if len(grams) else []
    return (grams[first], np.add.reduceat(weights, first)) if len(grams) else (grams, weights)


def _word_grams(words, at_once=WORDS_AT_ONCE):
    """Summed n-grams of a Counter of words (bytes): arrays of n-gram and count."""
    total, pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64)), iter(words.items())
    while some := list(islice(pairs, at_once)):
        counts = np.fromiter((n for _, n in some), np.int64, len(some))
        text = b" ".join(name for name, _ in some).decode().lower()
        raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        word = np.cumsum(raw == 32)
        found, place = ngrams(text)
        own = _summed(found, counts[word[place]])
        total = _summed(*(np.concatenate(x) for x in zip(total, own)))
    return total


def _count(batches):
    def flush(words):
        for lang, own in words.items():
            grams, n = _word_grams(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)],
                ["lang", "gram", "n"])

    words = defaultdict(Counter)
    for batch in slices(batches, 200):
        for lang, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
            words[lang].update(raw.split())
            if len(words[lang]) > DISTINCT_WORDS:
                yield from flush({lang: words.pop(lang)})
        if sum(map(len, words.values())) > DISTINCT_WORDS:
            yield from flush(words)
            words = defaultdict(Counter)
    yield from flush(words)


def learn(docs: DataFrame, lang="lang", text="text", depth=DEPTH):
    """{language: n-grams in order} over all rows with a language and a text."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = (rows.mapInArrow(_count, "lang string, gram bigint, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = [F.col("n").desc(), F.col("gram")]
    some = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(64))).orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    top = (counts.withColumn("r", F.row_number().over(some)).filter(F.col("r") <= depth)
           .withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= depth))
    profiles = defaultdict(list)
    for row in sorted(top.select("lang", "r", "gram").collect()):
        profiles[row["lang"]].append(row["gram"])
    return dict(profiles)


class Profiles:
    """Profiles as one sorted table of n-grams with a rank for each language."""

    def __init__(self, profiles, depth=DEPTH):
        self.names, self.depth = sorted(profiles), depth
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.ranks = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            at = np.searchsorted(self.grams, np.array(profiles[name], np.int64))
            self.ranks[i, at] = np.arange(len(at))

    def distances(self, own):
        """Out-of-place distance to each language, as a share of the greatest."""
        at = np.searchsorted(self.grams, own)
        at = np.where((at < len(self.grams))
                      & (self.grams[np.minimum(at, len(self.grams) - 1)] == own),
                      at, len(self.grams))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.depth, np.abs(ranks - np.arange(len(own))))
        return np.minimum(away, self.depth).sum(axis=1) / (self.depth * len(own))

    def predict(self, text):
        own = ranked(text.lower(), self.depth)
        if not len(own) or not self.names:
            return UNDECIDED, 0.0
        away = self.distances(own)
        best = int(np.argmin(away))
        return self.names[best], float(1 - away[best])


def identify(docs: DataFrame, profiles, keep=("doc_id",), text="text", depth=DEPTH) -> DataFrame:
    """The kept columns, ``lang_pred`` and ``score`` of every row."""
    model = Profiles(profiles, depth)
    source = docs.select(*keep, whole_text(text).alias("_whole"))
    names = source.columns[:-1]

    def run(batch):
        found = [model.predict(t) for t in batch.column(len(names)).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(len(names))]
            + [pa.array([f[0] for f in found], pa.string()),
               pa.array([f[1] for f in found], pa.float64())], [*names, "lang_pred", "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(by_batch(run), f"{fields}, lang_pred string, score double")


def op7(spark, folder):
    """Learns from the documents whose id slot of 4 is not 2, predicts all."""
    docs = table(spark, folder, "documents").withColumn("held_out", id_slot("doc_id", 4) == 2)
    return identify(docs, learn(docs.filter(~F.col("held_out"))), ("doc_id", "held_out"))


def keep_identified(docs: DataFrame, profiles=None) -> DataFrame:
    """The documents (all their columns) that have a language; profiles are learnt from them
    where none are given."""
    model = Profiles(learn(docs) if profiles is None else profiles)
    at = docs.columns.index("text")

    def run(batch):
        found = [model.predict(t or "")[0] for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array([name != UNDECIDED for name in found], pa.bool_()))

    return docs.mapInArrow(by_batch(run), docs.schema)
