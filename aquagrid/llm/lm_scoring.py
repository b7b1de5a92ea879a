"""Log-bilinear language model, trained with noise-contrastive estimation.

Words are predicted through classes: the most frequent words are classes of their own, all
others fall into tail classes by their ending, and the end of a text is a class. A vector of
the previous class, turned by a matrix, meets the vector of the next class: score
``(r_h C) . o_w + b_w``. Spark counts class pairs over all training texts; numpy fits the
model to these counts with noise-contrastive estimation, where both terms of the objective
are sums over the whole pair matrix. One product of matrices and a log-sum-exp then gives
normalised log-probabilities of every class after every class. Inside a tail class a word has
its add-one share of the class.

On top of the vectors every pair of frequent words that training saw has a
weight of its own, and a word a weight for the words it has no pair with. So what the
model holds of the corpus grows with it; no number of pairs is fixed. Such a weight is touched
by its own pairs only, so its noise-contrastive optimum is known outright: the score at which
data and noise meet is the log of the pair's share after its first word (counts less
``DISCOUNT``). The probabilities after a word, over all words and the unseen one, sum to 1.

Counts of frequent words (at most ``hot``, a bound by a count threshold) go to every task;
counts of all other words are joined, so the vocabulary has no limit. Rare words are never
hot keys, as their counts lie under that threshold; they have no pairs of their own. Weights of
frequent pairs (at most ``HOT_PAIRS``) go to every task; the counts of all others are joined, as
what else their weights are made of is known in the task that asks. The tables of counts lie in
buckets of the key of that join, so it shuffles what texts ask for and nothing else.
Texts the model was counted on need that join only where a pair may have been seen twice, which a
bitmap of fixed size tells: else the text itself is the one place of the pair.

A missing text counts as empty: one end token. A missing id trains. Repeated rows are scored
and counted each; ties between words are settled by the word. Other columns of the input are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aquagrid.llm.common import as_bytes, give_back, id_slot, slices, table, whole_text
from aquagrid.session import bucketed, shuffles_freed

WORD_CLASSES, TAIL_CLASSES, HOT = 960, 63, 250_000
WIDTH, NOISE, STEPS, SEED = 32, 8, 240, 7
DISTINCT_WORDS = 400_000
DISCOUNT = 0.75             # what is held back of the count of a pair
HOT_PAIRS, BITMAP_BITS, HOT_BITS = 1_000_000, 27, 22
TOKENS = 2_000_000          # pairs a task gathers before it adds them up
END = b"\n"                 # never a word
ENDING = 3                  # bytes of a word that choose its tail class


def tokens(raw):
    """Words of a text (bytes), A-Z lower-cased, then the end."""
    words = raw.lower().split()
    words.append(END)
    return words


def _tail(word):
    return zlib.crc32(word[-ENDING:]) % TAIL_CLASSES


def _emit(words):
    return pa.RecordBatch.from_arrays(
        [pa.array(list(words), pa.binary()), pa.array(words.values(), pa.int64())], ["word", "n"])


def _count(batches):
    words = Counter()
    for batch in batches:
        for raw in as_bytes(batch.column(0)):
            words.update(tokens(raw))
        if len(words) > DISTINCT_WORDS:
            yield _emit(words)
            words = Counter()
    if words:
        yield _emit(words)


def count_words(docs: DataFrame, text="text") -> DataFrame:
    """(pair, word, n) over all texts, words as bytes. ``pair`` is the key of the word among pairs;
    rows are shuffled by it alone, as tasks have added up their words before."""
    return (docs.select(whole_text(text).alias("t")).mapInArrow(_count, "word binary, n bigint")
            .withColumn("pair", _key(F.col("word"), F.lit(-1))).repartition("pair")
            .groupBy("pair", "word").agg(F.sum("n").alias("n")))


def _least_count(counts: DataFrame, bound):
    """The smallest ``n`` whose rows, and all of greater n, are at most ``bound``; None if none."""
    with shuffles_freed(counts.sparkSession):
        sizes = counts.groupBy("n").agg(F.count("*").alias("k")).collect()
    least, held = None, 0
    for row in sorted(sizes, reverse=True):
        held += row["k"]
        if held > bound:
            break
        least = row["n"]
    return least


class Vocabulary:
    """Frequent words with counts and classes, and the totals of the corpus."""

    def __init__(self, counts: DataFrame, hot=HOT, word_classes=WORD_CLASSES):
        totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.total, self.distinct = totals["n"] or 0, totals["v"]
        self.least = least = _least_count(counts.filter(F.col("n") > 1), hot)
        rows = counts.filter(F.col("n") >= least).toArrow() if least else None
        ordered = sorted(zip((-rows["n"].to_numpy()).tolist(), rows["word"].to_pylist())) if least else []
        rows = None
        self.index = {word: i for i, (_, word) in enumerate(ordered)}
        self.counts = np.array([-n for n, _ in ordered], dtype=np.int64)
        named = [word for _, word in ordered if word != END][:word_classes]
        self.end = len(named)
        self.classes = self.end + 1 + TAIL_CLASSES
        own = {word: i for i, word in enumerate(named)} | {END: self.end}
        self.class_of = np.array([own.get(word, self.end + 1 + _tail(word))
                                  for _, word in ordered], dtype=np.int64)
        ending = F.pmod(F.crc32(F.expr(f"substring(word, -{ENDING}, {ENDING})")),
                        F.lit(TAIL_CLASSES))
        self.tail_n, self.tail_v = (np.zeros(TAIL_CLASSES, np.int64) for _ in range(2))
        for row in counts.groupBy(ending.alias("t")).agg(
                F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.tail_n[row["t"]], self.tail_v[row["t"]] = row["n"], row["v"]
        for word in own:
            if word in self.index:
                self.tail_n[_tail(word)] -= self.counts[self.index[word]]
                self.tail_v[_tail(word)] -= 1

    def places(self, words):
        """Places of words among the frequent ones, -1 for others."""
        return np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))

    def pairs(self, places):
        """Pairs of neighbours both of which are frequent."""
        before, after = places[:-1], places[1:]
        return (before * len(self.index) + after)[(before >= 0) & (after >= 0)]

    def inside(self):
        """log10 share of each frequent word in its class."""
        tail = self.class_of - self.end - 1
        share = np.log10(self.tail_n + self.tail_v + 1.0)
        return np.where(tail >= 0, np.log10(self.counts + 1.0) - share[np.maximum(tail, 0)], 0.0)

    def classes_at(self, places, words):
        """Classes of words whose places are known."""
        classes = np.empty(len(places), np.int64)
        hit = places >= 0
        classes[hit] = self.class_of[places[hit]]
        classes[~hit] = [self.end + 1 + _tail(words[i]) for i in np.flatnonzero(~hit)]
        return classes

    def classes_of(self, words):
        """Classes of words."""
        return self.classes_at(self.places(words), words).tolist()


def pair_counts(docs: DataFrame, vocabulary, text="text"):
    """One scan of all texts for the matrix of class pairs (previous, next) and the stored table
    (pair, n) of pairs of frequent words. ``pair`` is the place of the first word times their
    number plus the place of the second. A text starts after an end."""
    k = vocabulary.classes
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def emit(pairs, n):
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

    def run(batches):
        own = shared.value
        classes, parts, held = np.zeros(k * k, np.int64), [], 0
        for batch in slices(batches, 500):
            words = [END]
            for raw in as_bytes(batch.column(0)):
                words += tokens(raw)        # each ends with the end, which starts the next
            at = own.places(words)
            row = own.classes_at(at, words)
            classes += np.bincount(row[:-1] * k + row[1:], minlength=k * k)
            parts.append(own.pairs(at))
            held += len(parts[-1])
            if held > TOKENS:
                yield emit(*np.unique(np.concatenate(parts), return_counts=True))
                parts, held = [], 0
        if parts:
            yield emit(*np.unique(np.concatenate(parts), return_counts=True))
        found = np.flatnonzero(classes)
        yield emit(-1 - found, classes[found])      # class pairs go below zero

    sums = bucketed(    # as files: each of the scans that follow reads the columns it needs
        docs.select(whole_text(text).alias("t")).mapInArrow(run, "pair bigint, n bigint")
        .groupBy("pair").agg(F.sum("n").alias("n")), "pair")
    ofclass = sums.filter("pair < 0").toArrow()     # k * k rows at most
    matrix = np.zeros(k * k)
    matrix[-1 - ofclass["pair"].to_numpy()] = ofclass["n"].to_numpy()
    return matrix.reshape(k, k), sums.filter("pair >= 0")


def _slots(pairs, bits=BITMAP_BITS):
    """Places of pairs in a table of 2 ** bits, by default the bitmap."""
    mixed = np.asarray(pairs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class HotPairs:
    """Gains of sorted pairs. A table of slots gives the last pair of each slot; the few others
    are searched."""

    def __init__(self, pairs, gains):
        self.pairs, self.gains = pairs, gains
        slots, at = _slots(pairs, HOT_BITS), np.arange(len(pairs), dtype=np.int32)
        self.table = np.full(1 << HOT_BITS, -1, np.int32)
        self.table[slots] = at
        self.others = at[self.table[slots] != at]
        self.rest = pairs[self.others]

    def find(self, wanted):
        """For each wanted pair its place, or -1."""
        at = self.table[_slots(wanted, HOT_BITS)]
        taken = np.flatnonzero(at >= 0)
        taken = taken[self.pairs[at[taken]] != wanted[taken]]
        at[taken] = -1
        if len(self.others) and len(taken):
            own, asked = self.rest, wanted[taken]
            spot = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            hit = own[spot] == asked
            at[taken[hit]] = self.others[spot[hit]]
        return at


class DirectWeights:
    """Weights of word pairs (log10). ``free`` holds the weight, by first word, of the words it
    has no pair with; ``hot`` and ``gains`` the weights of frequent pairs over that, ``rest``
    (pair, n) the counts of all others. ``discount`` lies between 0 and 1."""

    def __init__(self, pairs: DataFrame, vocabulary, likely, discount=DISCOUNT, hot=HOT_PAIRS):
        shared = pairs.sparkSession.sparkContext.broadcast(
            (vocabulary, likely, vocabulary.inside()))
        size = max(len(vocabulary.index), 1)

        def expected(batch):
            own, known, inside = shared.value
            pair, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            before, after = pair // size, pair % size
            base = known[own.class_of[before], own.class_of[after]] + inside[after]
            return pair, before, (n - discount) / own.counts[before], base

        def taken(batches):
            for batch in batches:
                _, before, share, base = expected(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(before), pa.array(share), pa.array(10.0 ** base)],
                    ["before", "share", "base"])

        with shuffles_freed(pairs.sparkSession):
            sums = (pairs.mapInArrow(taken, "before bigint, share double, base double")
                    .groupBy("before").agg(F.sum("share").alias("share"), F.sum("base").alias("base"))
                    .toArrow())             # a row for each frequent word at most
        left = np.maximum(1.0 - sums["share"].to_numpy(), 1e-12)
        free = np.zeros(size)
        free[sums["before"].to_numpy()] = np.log10(
            left / np.maximum(1.0 - sums["base"].to_numpy(), 1e-12))
        # the two shares add up to 1 but for the floors above, so this division is exact
        self.free = free
        own_free = pairs.sparkSession.sparkContext.broadcast(free)

        def weights(batches):
            for batch in batches:
                pair, before, share, base = expected(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair), pa.array(np.log10(share) - base - own_free.value[before])],
                    ["pair", "gain"])

        def slots(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_slots(batch.column(0).to_numpy()))], ["slot"])

        least = _least_count(pairs.filter(F.col("n") > 1), hot)
        frequent = F.col("n") >= least if least else F.lit(False)
        rows = pairs.filter(frequent).mapInArrow(weights, "pair bigint, gain double").toArrow()
        order = np.argsort(rows["pair"].to_numpy())
        self.hot, self.gains = rows["pair"].to_numpy()[order], rows["gain"].to_numpy()[order]
        self.found = HotPairs(self.hot, self.gains)
        self.rest = pairs.filter(~frequent)
        with shuffles_freed(pairs.sparkSession):
            marks = (pairs.filter(~frequent & (F.col("n") > 1)).select("pair")
                     .mapInArrow(slots, "slot bigint")
                     .groupBy(F.shiftright("slot", 6).alias("at"))
                     .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
                     .toArrow())            # a row for each number of the bitmap at most
        self.bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
        self.bitmap[marks["at"].to_numpy()] = marks["bits"].to_numpy()
        self.discount, self.once = discount, np.log10(1 - discount)

    def arrays(self):
        """What every task needs: bounded by the words and pairs held and the bitmap."""
        return self.free, self.found, self.bitmap, self.once


def _direct(arrays, own, likely, inside, plain, places, trained):
    """Sum of the weights known here, and the pairs whose counts must be looked up, with how often
    they occur and what their weights take from the log of the count. Texts the model was counted on
    have taken that already, as all their pairs are found."""
    free, hot, bitmap, once = arrays
    pairs = own.pairs(places)
    total = float(free[places[1:][places[1:] >= 0]].sum())      # the start is an end, too
    if len(hot.pairs):
        at = hot.find(pairs)
        hit = at >= 0
        total, pairs = total + float(hot.gains[at[hit]].sum()), pairs[~hit]

    def less(pairs):
        before, after = np.divmod(pairs, max(len(own.index), 1))
        return (plain[before] + free[before] + likely[own.class_of[before], own.class_of[after]]
                + inside[after])

    if trained:
        slot = _slots(pairs)
        marked = (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1
        total += float(once * (len(pairs) - marked.sum()) - less(pairs).sum())
        pairs = pairs[marked]
    pairs, n = np.unique(pairs, return_counts=True)
    return total, pairs, n, np.zeros(len(pairs)) if trained else less(pairs)


def train(pairs, width=WIDTH, noise=NOISE, steps=STEPS, seed=SEED, rate=0.03):
    """(r, C, o, b) by noise-contrastive estimation against add-one unigram noise."""
    k = len(pairs)
    after, before = pairs.sum(axis=0) + 1.0, pairs.sum(axis=1)
    total = max(pairs.sum(), 1.0)
    chance = after / after.sum()
    data = (pairs / total).astype(np.float32)
    fake = (noise * np.outer(before / total, chance)).astype(np.float32)
    level = np.log(noise * chance).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (k, width)), np.eye(width), rng.normal(0, 0.3, (k, width)),
              np.log(chance)]
    params = [p.astype(np.float32) for p in params]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        r, turn, o, b = params
        q = r @ turn
        delta = q @ o.T + (b - level)
        true = 1 / (1 + np.exp(-np.clip(delta, -30, 30)))
        push = fake * true - data * (1 - true)
        to_q = push @ o
        grads = [to_q @ turn.T, r.T @ to_q, push.T @ q, push.sum(axis=0)]
        pace = rate * min(1.0, 2.0 * (1 - (step - 1) / steps))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            ahead = (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.99 ** step)) + 1e-8)
            params[i] = params[i] - np.float32(pace) * ahead.astype(np.float32)
    return params


def log_probabilities(params):
    """log10 of the probability of each class after each class, rows summing to 1."""
    r, turn, o, b = (p.astype(np.float64) for p in params)
    scores = (r @ turn) @ o.T + b
    top = scores.max(axis=1, keepdims=True)
    return (scores - top - np.log(np.exp(scores - top).sum(axis=1, keepdims=True))) / np.log(10)


def _key(word, pair):
    """The pair, or a number below zero that is drawn from the word. It has 31 bits, as it is
    shuffled with every row; words that share one are told apart by themselves."""
    return F.when(pair < 0, -1 - F.shiftrightunsigned(F.xxhash64(word), 33)).otherwise(pair)


def score(docs: DataFrame, counts: DataFrame, vocabulary, table_, keep=("doc_id",),
          text="text", direct=None, trained=None) -> DataFrame:
    """The kept columns with n_tokens, n_known, base_score and score of every text. ``direct``
    adds the weights of word pairs; ``trained``, a column, says which rows these were counted on
    (none, if not given: then all pairs that are not held in the tasks are looked up)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(
        (vocabulary, table_, direct.arrays() if direct else None))
    seen = F.lit(False) if trained is None else F.coalesce(trained, F.lit(False))
    source = docs.select(F.monotonically_increasing_id().alias("_row"), *keep,
                         seen.alias("_seen"), whole_text(text).alias("_text"))
    names = source.columns[1:-2]
    width = len(source.columns)

    def run(batches):
        own, likely, arrays = shared.value
        share = np.log10(own.tail_n + own.tail_v + 1.0)
        logs, plain = np.log10(own.counts + 1.0), np.log10(np.maximum(own.counts, 1))
        known = own.counts > 0, own.inside(), logs, plain
        for batch in slices(batches):
            yield scored(batch, own, likely, arrays, share, *known)

    def scored(batch, own, likely, arrays, share, known, inside, logs, plain):
        tail = own.end + 1
        first = own.places([END])
        n_tokens, n_known, base, total, rare_words, rare = [], [], [], [], [], []
        blank = first[:0]
        for raw, seen in zip(as_bytes(batch.column(width - 1)), batch.column(width - 2).to_pylist()):
            words = tokens(raw)
            at = own.places(words)
            hit = at >= 0
            held = at[hit]
            unseen = [words[i] for i in np.flatnonzero(~hit)]
            classes = np.empty(len(words) + 1, np.int64)
            classes[0] = own.end
            classes[1:][hit] = own.class_of[held]
            ends = np.array([_tail(w) for w in unseen], dtype=np.int64)
            classes[1:][~hit] = ends + tail
            n_tokens.append(len(words))
            n_known.append(int(known[held].sum()))
            base.append(float(logs[held].sum()))
            total.append(float(likely[classes[:-1], classes[1:]].sum() + inside[held].sum()
                               - share[ends].sum()))
            found, pairs, n, less = Counter(unseen), at[:0], at[:0], logs[:0]
            if arrays:
                direct_, pairs, n, less = _direct(arrays, own, likely, inside, plain,
                                                  np.concatenate([first, at]), seen)
                total[-1] += direct_
            blank = np.full(len(found), -1)
            rare_words += found
            rare.append((np.fromiter(map(len, found), np.int32, len(found)), pairs * 0,
                         blank, pairs, np.fromiter(found.values(), np.int64, len(found)), n,
                         np.zeros(len(found)), less))
        # words first, then pairs, whose word is empty; a word's pair is below zero
        size = pa.array(np.concatenate([[0], np.cumsum(
            [len(x) for one in rare for x in one[2:4]])])[::2].astype(np.int32))
        lengths, keys, times, taken = (
            np.concatenate([blank[:0], *[x for one in rare for x in one[i:i + 2]]]) for i in (0, 2, 4, 6))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(keys), [
            None, pa.py_buffer(ends), pa.py_buffer(b"".join(rare_words))])
        entries = pa.StructArray.from_arrays(
            [words, pa.array(keys.astype(np.int64)), pa.array(times.astype(np.int64)),
             pa.array(taken.astype(np.float64))],
            names=["word", "pair", "k", "less"])
        return pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(width - 2)]
            + [pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()),
               pa.array(base, pa.float64()), pa.array(total, pa.float64()),
               pa.ListArray.from_arrays(size, entries)],
            ["_row", *names, "n_tokens", "_known", "_base", "_score", "rare"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2])
    local = source.mapInArrow(run, fields + (
        ", n_tokens bigint, _known bigint, _base double, _score double, "
        "rare array<struct<word: binary, pair: bigint, k: bigint, less: double>>"))
    once = [*names, "n_tokens", "_known", "_base", "_score"]
    # a row for each rare word and pair; the text's own figures ride on the first one only. A text
    # without any has a key drawn from its row
    key = F.coalesce(_key(F.col("r.word"), F.col("r.pair")), _key(F.col("_row"), F.lit(-1)))
    spread = (local.select("_row", *once, F.posexplode_outer("rare").alias("at", "r"))
              .select("_row", F.col("r.word").alias("word"), key.alias("pair"), F.col("r.k").alias("k"),
                      F.col("r.less").alias("less"),
                      F.when(F.coalesce("at", F.lit(0)) == 0, F.struct(*once)).alias("own")))
    # the one key is a number, which Spark sorts by its digits; two words may share it, so words
    # are compared as well, in a form that does not make them a second key
    known = counts if vocabulary.least is None else counts.filter(F.col("n") < vocabulary.least)
    known = known.select(F.col("pair").alias("_key"), F.col("word").alias("_word"), F.col("n").alias("_c"))
    same = ~((F.col("word") < F.col("_word")) | (F.col("word") > F.col("_word")))
    joined = spread.join(known, (F.col("pair") == F.col("_key")) & same, "left")
    found, gain = F.col("_c").isNotNull(), F.lit(0.0)
    if direct:
        # a pair training never saw is not found, and adds nothing
        joined = joined.join(direct.rest.select(F.col("pair").alias("_pair"), F.col("n").alias("_n")),
                             F.col("pair") == F.col("_pair"), "left")
        found = found | F.col("_n").isNotNull()
        gain = F.coalesce(F.log10(F.col("_n") - direct.discount) - F.col("less"), F.lit(0.0))
    c = F.coalesce("_c", F.lit(0))
    gathered = joined.filter(found | F.col("own").isNotNull()).groupBy("_row").agg(
        *[F.max(F.col("own").getField(x)).alias(x) for x in once],
        F.sum(F.col("k") * F.log10(c + 1.0)).alias("_rare"),
        F.sum(F.col("k") * gain).alias("_pairs"),
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("_rare_known"))
    rare = F.coalesce("_rare", F.lit(0.0))
    all_words = float(np.log10(vocabulary.total + vocabulary.distinct + 1.0))
    return gathered.select(
        *names, "n_tokens", (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("bigint").alias("train_tokens"),
        (F.col("_base") + rare - F.col("n_tokens") * F.lit(all_words)).alias("base_score"),
        (F.col("_score") + rare + F.coalesce("_pairs", F.lit(0.0))).alias("score"))


def op1(spark, folder):
    """Learns from the documents whose id slot of 7 is not 2, scores all."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", (id_slot("doc_id", 7) == 2).alias("held_out"))
    training = docs.filter(~F.col("held_out"))
    counts = bucketed(count_words(training), "pair")
    vocabulary = Vocabulary(counts)
    classes, pairs = pair_counts(training, vocabulary)
    likely = log_probabilities(train(classes))
    give_back()
    direct = DirectWeights(pairs, vocabulary, likely)
    give_back()     # the driver, too, keeps only what the scores need
    return score(docs, counts, vocabulary, likely, ("doc_id", "held_out"), direct=direct,
                 trained=~F.col("held_out"))
