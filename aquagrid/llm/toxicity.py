"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel compares words by their three-letter subsequences; a subsequence that spans more
characters counts less (``decay`` per character), so letters drawn apart or mixed with other
signs still match. Nyström landmarks are words that mark toxic training texts, and the words
of clean ones that come nearest to them. A sentence is described by its best word for every
landmark, and these similarities are turned by the inverse root of the landmarks' own kernel
matrix into features for a linear machine.

Labels belong to texts, so the machine is trained on sentences in rounds: all sentences of a
clean text are clean, and of a toxic text the sentence that scores highest is toxic. A text's
score is that of its highest sentence, through a logistic curve.

The machine is fitted on at most ``sample`` labelled texts of each class, first by hash; every
text is scored whole. Words have at most ``PIECE`` characters for the kernel: longer ones are
cut into overlapping pieces. A run of single letters is also read as one word.

A missing text counts as empty and scores like a text without a suspicious word. Labels that
are missing do not train; with no label of a class every score is 0. Repeated rows are scored
each; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aquagrid.llm.common import WordCache, by_batch, id_slot, slices, table, whole_text

SAMPLE, LANDMARKS, NEAREST = 3_000, 64, 24
DECAY, SPAN, PIECE, FLOOR = 0.6, 8, 24, 0.45
LEAST_TEXTS, LIFT = 4, 8.0

SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
SPACED = re.compile(r"(?<!\S)\w(?:[ \t]+\w){2,}(?!\S)")
#: Digits and signs that stand for letters.
ALIKE = str.maketrans("013457@", "oieasta")
SIZE = 1 << 15
WIDTHS = (5, 7, 8, 9, 10, 12, 14, 17, 20, PIECE)
PIECES_AT_ONCE = 4_000


def _letter_codes():
    """Five bits a letter: a-z have their own, other Latin letters share five, and those of all
    other scripts are spread over the 31."""
    codes = np.zeros(0x110000, np.int16)
    for i in range(0x40000):        # no letters beyond
        c = chr(i)
        if "a" <= c <= "z":
            codes[i] = ord(c) - 96
        elif c.isalpha():
            codes[i] = 27 + i % 5 if i < 0x250 else 1 + i % 31
    return codes


CODES = _letter_codes()


def pieces_of(word):
    """A word in letters, cut where it is longer than a piece."""
    word = word.translate(ALIKE)
    if len(word) <= PIECE:
        return [word]
    return [word[i:i + PIECE] for i in range(0, len(word) - PIECE // 2, PIECE // 2)]


def letter_rows(words, width):
    """Letter codes of words of at most ``width`` characters: one row a place, one column a word."""
    joined = np.frombuffer("".join([w.ljust(width) for w in words]).encode("utf-32-le"), np.uint32)
    return np.ascontiguousarray(CODES[joined].reshape(len(words), width).T, dtype=np.int64)


def _columns(letters):
    """For each step pattern: its weight, the places of its letters from the first on, and the
    codes of the subsequences (one column a word); a gap is a zero among the three letters."""
    width = len(letters)
    for a in range(1, min(SPAN - 1, width)):
        pairs = ((letters[:width - a] << 5) | letters[a:]) << 5
        for b in range(1, SPAN - a):
            n = width - a - b
            if n > 0:
                yield DECAY ** (a + b + 1), (0, a, a + b), pairs[:n] | letters[a + b:]


def subsequences(words, width=PIECE):
    """For each step pattern: its weight, and the codes of the subsequences of every word of at
    most ``width`` characters (one row a word; -1 where there is none)."""
    letters = letter_rows(words, width)
    known = letters > 0
    for weight, at, codes in _columns(letters):
        x, y, z = (known[i:i + len(codes)] for i in at)
        yield weight, np.where(x & y & z, codes, -1).T


def explicit(words):
    """Unit vectors of words in the space of all subsequences."""
    out = np.zeros((len(words), SIZE + 1))
    rows = np.arange(len(words))[:, None]
    for weight, codes in subsequences(words):
        np.add.at(out, (np.broadcast_to(rows, codes.shape), codes), weight)
    out = out[:, :SIZE]         # code -1 fell on the last place
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def _norms(every, rows):
    """Length of each word's vector: weights of equal subsequences are summed, then squared.
    ``every`` holds (weights, codes) of each step pattern."""
    if not every or not rows:
        return np.ones(rows)
    codes = np.hstack([c for _, c in every])
    weights = np.where(codes >= 0, np.concatenate([w for w, _ in every])[None, :], 0.0)
    order = np.argsort(codes, axis=1, kind="stable")
    codes, weights = (np.take_along_axis(x, order, axis=1) for x in (codes, weights))
    new = np.ones(codes.shape, bool)
    new[:, 1:] = codes[:, 1:] != codes[:, :-1]
    first = np.flatnonzero(new)
    summed = np.add.reduceat(weights.ravel(), first)
    squares = np.bincount(first // codes.shape[1], weights=summed ** 2, minlength=rows)
    return np.sqrt(np.maximum(squares, 1e-12))


class Kernel:
    """Similarities of words to landmarks, above the floor."""

    def __init__(self, landmarks):
        self.landmarks = landmarks
        vectors = explicit(landmarks)
        self.gram = vectors @ vectors.T
        # few subsequences are part of a landmark: for each code its landmarks and their values
        codes, self.marks = np.nonzero(vectors.T)
        self.values = vectors[self.marks, codes]
        self.starts = np.searchsorted(codes, np.arange(SIZE + 1))
        self.most = vectors.max(axis=0, initial=0)

    def raw(self, pieces):
        """Similarities of pieces to all landmarks, for those where one may pass the floor.
        Pieces are taken by length, so that short ones are not padded to the longest."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        near, values, shorter = [], [], -1
        for width in WIDTHS:
            own = np.flatnonzero((lengths > shorter) & (lengths <= width))
            shorter = width
            if len(own):
                at, found = self._raw([pieces[i] for i in own], width)
                near.append(own[at])
                values.append(found)
        return np.concatenate(near), np.concatenate(values)

    def _raw(self, pieces, width):
        letters = letter_rows(pieces, width)
        bound, least = np.zeros(len(pieces)), np.zeros(len(pieces))
        known = letters > 0
        for weight, at, codes in _columns(letters):
            # no landmark has a code with a gap in it, so these add nothing
            bound += weight * self.most[codes].sum(axis=0)
            x, y, z = (known[i:i + len(codes)] for i in at)
            least += weight ** 2 * (x & y & z).sum(axis=0)
        # the norm is at least what it would be if no subsequence came twice; what a word's best
        # subsequences could give at most decides who is looked at closely
        near = np.flatnonzero(bound > FLOOR * np.sqrt(np.maximum(least, 1e-12)))
        out = self._products(letters[:, near])
        # below the floor by the least norm is below it by the true one, which few words need
        norm = np.sqrt(np.maximum(least[near], 1e-12))
        over = np.flatnonzero(out.max(axis=1, initial=0) > FLOOR * norm)
        every = [(np.full(c.shape[1], w), c)
                 for w, c in subsequences([pieces[i] for i in near[over]], width)]
        norm[over] = _norms(every, len(over))
        return near, out / norm[:, None]

    def _products(self, letters):
        """Inner products of words (columns of letters) with all landmarks, from the
        subsequences they share."""
        words, many = letters.shape[1], len(self.landmarks)
        found = []
        for weight, _, codes in _columns(letters):
            codes = codes.ravel()
            hit = np.flatnonzero(self.most[codes])
            found.append((codes[hit], hit % max(words, 1), np.full(len(hit), weight)))
        if not found:
            return np.zeros((words, many))
        codes, word, weight = map(np.concatenate, zip(*found))
        first = self.starts[codes]
        times = self.starts[codes + 1] - first
        at = np.arange(times.sum()) + np.repeat(first - (np.cumsum(times) - times), times)
        return np.bincount(
            np.repeat(word * many, times) + self.marks[at],
            weights=np.repeat(weight, times) * self.values[at], minlength=words * many).reshape(words, many)

    def words(self, words):
        """For each word its similarities over the floor, or None where there are none."""
        pieces, owner = [], []
        for i, word in enumerate(words):
            for piece in pieces_of(word):
                pieces.append(piece)
                owner.append(i)
        found = [None] * len(words)
        for first in range(0, len(pieces), PIECES_AT_ONCE):
            near, values = self.raw(pieces[first:first + PIECES_AT_ONCE])
            values = np.maximum(values - FLOOR, 0) / (1 - FLOOR)
            for j in np.flatnonzero(values.any(axis=1)):
                i = owner[first + near[j]]
                # a copy: a row in a cache would hold all values of the slice
                found[i] = values[j].copy() if found[i] is None else np.maximum(found[i], values[j])
        return found


def _spaced(words):
    """Whether a run of single letters may be among the words."""
    return list(map(len, words)).count(1) > 2


def _words(text):
    words = text.split()
    if _spaced(words):
        words.extend("".join(run.split()) for run in SPACED.findall(text))
    return words


class Reader:
    """Sentence descriptions of texts."""

    def __init__(self, kernel):
        self.kernel = kernel
        self.cache = WordCache(kernel.words)

    def sentences(self, texts):
        """For each text the rows of its sentences that hold a similar word."""
        lowered = [t.lower() for t in texts]
        words, spaced = [], []
        for text in lowered:
            own = text.split()
            spaced.append(_spaced(own))
            words.append(set(_words(text) if spaced[-1] else own))
        every = set().union(*words)
        self.cache.prepare(every)
        get = self.cache.__getitem__
        similar = {w for w in every if get(w) is not None}
        for text, own, runs in zip(lowered, words, spaced):
            hits = own & similar
            if not hits:
                yield np.zeros((0, len(self.kernel.landmarks)), np.float32)
                continue
            rows, read = [], _words if runs else str.split
            # every end of a line ends a sentence; only lines with a hit are cut into sentences
            for line in text.split("\n"):
                if hits.isdisjoint(read(line)):
                    continue
                for sentence in SENTENCE.split(line):
                    found = [get(w) for w in hits.intersection(read(sentence))]
                    if found:
                        rows.append(reduce(np.maximum, found))
            # a run of single letters may cross sentences
            rows = rows or [reduce(np.maximum, map(get, hits))]
            yield np.array(rows, np.float32)


def _machine(x, y, cost=10.0, rounds=30):
    """Linear machine with squared hinge loss, by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    weight = cost * len(x) * share
    w, keep = np.zeros(x.shape[1]), np.diag([1.0] * (x.shape[1] - 1) + [1e-3])
    for _ in range(rounds):
        active = y * (x @ w) < 1
        xs = x[active] * weight[active][:, None]
        new = np.linalg.solve(keep + xs.T @ x[active], xs.T @ y[active])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w


def _curve(margin, y, rounds=50):
    """Slope and offset of a logistic curve, with softened targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    share = np.where(y > 0, 0.5 / max(pos, 1), 0.5 / max(neg, 1)) * len(y)
    x, w = np.column_stack([margin, np.ones(len(margin))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (share * (p - target)))
        w = w - np.clip(step, -2, 2)
    return w


class Model:
    """Landmarks, their weights after Nyström, and the logistic curve."""

    def __init__(self, kernel, weights, bias, curve):
        self.kernel, self.weights, self.bias, self.curve = kernel, weights, bias, curve
        self.reader = None

    def __getstate__(self):
        return self.__dict__ | {"reader": None}

    def margins(self, rows):
        return rows @ self.weights + self.bias

    def score(self, texts):
        if self.reader is None:
            self.reader = Reader(self.kernel)
        out = []
        for rows in self.reader.sentences(texts):
            margin = max([self.bias, *self.margins(rows)])
            out.append(1 / (1 + np.exp(-np.clip(self.curve[0] * margin + self.curve[1], -30, 30))))
        return out


def _sampled(docs, labels, sample, key, text, label):
    """At most ``sample`` labelled texts of each class, first by hash of the id."""
    ids = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key), F.col(label).alias("_toxic"))
    parts = [ids.filter(F.col("_toxic") == y).orderBy(F.xxhash64(key), key).limit(sample)
             for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])     # 2 * sample rows at most
    return docs.select(key, whole_text(text).alias("_text")).join(F.broadcast(chosen), key)


def _landmarks(sampled, count=LANDMARKS, nearest=NEAREST):
    """Words that mark toxic texts, each unlike those before, then the clean words nearest to
    them."""
    words = (sampled.select("_toxic", F.explode(F.array_distinct(F.split(
                F.lower("_text"), r"[\x20\x09-\x0D]+"))).alias("word"))
             .filter(F.length("word").between(3, PIECE)).groupBy("word")
             .agg(F.sum("_toxic").alias("bad"), F.count("*").alias("n")))
    lift = F.col("bad") / (F.col("n") - F.col("bad") + 1)
    marks = (words.filter((F.col("bad") >= LEAST_TEXTS) & (lift >= LIFT))
             .orderBy(F.col("bad").desc(), lift.desc(), "word").limit(20 * count).collect())
    chosen, vectors = [], np.zeros((count, SIZE), np.float32)
    for word in (r["word"].translate(ALIKE) for r in marks):
        if len(chosen) == count:
            break
        own = explicit([word])[0]
        if own.any() and (vectors @ own).max() <= 0.85:
            vectors[len(chosen)] = own
            chosen.append(word)
    if not chosen:
        return []
    common = (words.filter((F.col("bad") * 2 <= F.col("n")) & (F.col("n") >= LEAST_TEXTS))
              .orderBy(F.col("n").desc(), "word").limit(400 * count).collect())
    kernel, found = Kernel(chosen), []
    pool = [p for r in common for p in pieces_of(r["word"])]
    if pool:
        near, values = kernel.raw(pool)
        order = np.lexsort((near, -values.max(axis=1)))[:nearest]
        found = [pool[near[i]] for i in order if pool[near[i]] not in chosen]
    return chosen + list(dict.fromkeys(found))


def fit(docs: DataFrame, labels: DataFrame, sample=SAMPLE, key="doc_id", text="text",
        label="toxic"):
    """A Model, or None where a class has no labelled text or nothing tells the two apart."""
    sampled = _sampled(docs, labels, sample, key, text, label)
    landmarks = _landmarks(sampled)
    if not landmarks:
        return None
    kernel = Kernel(landmarks)

    def describe(batch):
        reader = Reader(kernel)
        rows = [r.ravel().tolist() for r in reader.sentences(batch.column(0).to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(rows, pa.list_(pa.float32()))], ["y", "rows"])

    described = (sampled.select("_text", F.col("_toxic").cast("int").alias("y"))
                 .mapInArrow(by_batch(describe), "y int, rows array<float>").toArrow())
    values, vectors = np.linalg.eigh(kernel.gram + 1e-3 * np.eye(len(landmarks)))
    nystroem = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    texts = sorted(((y.as_py(), r.values.to_numpy().tobytes())
                    for y, r in zip(described["y"], described["rows"])))
    labels_ = np.array([1.0 if y else -1.0 for y, _ in texts])
    if not (labels_ > 0).any() or not (labels_ < 0).any():
        return None
    empty = np.zeros((1, len(landmarks)))
    rows = [np.frombuffer(r, np.float32).reshape(-1, len(landmarks)).astype(np.float64) if r
            else empty for _, r in texts]
    weights, bias = np.ones(len(landmarks)), 0.0
    for _ in range(4):
        best = [r[[np.argmax(r @ weights)]] if y > 0 else np.vstack([r, empty])
                for r, y in zip(rows, labels_)]
        x, y = np.vstack(best), np.repeat(labels_, [len(b) for b in best])
        w = _machine(x @ nystroem, y)
        weights, bias = nystroem @ w[:-1], w[-1]
    margin = np.array([max(bias, (r @ weights + bias).max()) for r in rows])
    return Model(kernel, weights, bias, _curve(margin, labels_))


def score(docs: DataFrame, model, keep=("doc_id",), text="text") -> DataFrame:
    """The kept columns, ``score`` and ``predicted`` of every row."""
    source = docs.select(*keep, whole_text(text).alias("_whole"))
    names = source.columns[:-1]

    def run(batches):
        own = model
        for batch in slices(batches):
            texts = batch.column(len(names)).to_pylist()
            found = [0.0] * len(texts) if own is None else own.score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))]
                + [pa.array(found, pa.float64()),
                   pa.array([int(s >= 0.5) for s in found], pa.int32())],
                [*names, "score", "predicted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{fields}, score double, predicted int")


def op5(spark, folder):
    """Learns from labelled documents whose id slot of 5 is not 0, scores all."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(id_slot("doc_id", 5) != 0)
    return score(docs.withColumn("held_out", id_slot("doc_id", 5) == 0),
                 fit(docs, labels), ("doc_id", "held_out"))


def keep_clean(docs: DataFrame, model) -> DataFrame:
    """The documents (all their columns) that are not predicted toxic."""
    at = docs.columns.index("text")

    def run(batches):
        own = model
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [0.0] * len(texts) if own is None else own.score(texts)
            yield batch.filter(pa.array([s < 0.5 for s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
