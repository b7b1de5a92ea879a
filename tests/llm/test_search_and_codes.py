"""Ranked lexical search and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.llm import lexical, vector_codes

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["item", "term", "n", "rank", "score", "id", "v", "code", "error", "part"]


def plain_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, top=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in counts]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for _, c in counts for t in c)
    united = {}
    for i, t in items:
        united.setdefault(i, set()).update(plain_terms(t))
    out = []
    for item, own in united.items():
        scored = []
        for (key, c), size in zip(counts, sizes):
            score = 0
            for t in own & set(c):
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (10 + 90 * size * n // total)))
            if score > 0 and key is not None:
                scored.append((-score, key))
        out += [(item, r, key, -s) for r, (s, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def tables(seed=2):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "über", "漢字", "İx", "a-b", "THE", "the"]
    def text(k):
        return rng.choice([" ", ", ", "\n", "\x00"]).join(rng.choice(words[: rng.randint(3, 47)]) for _ in range(k))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, "the same text the w1 w2") for i in range(50)] + [(None, "w1 w2 w3 rare")]
    docs += [(7, "w1 w1 rare"), (7, "w1 w1 rare"), (9000, None), (9001, ""), (9002, "-- !!"),
             (9003, "w3 " * 900_000)]
    base = " ".join(words[:12])
    items = [(i, base + " " + text(rng.randint(0, 12))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "absent words only"), (53, "rare"), (53, "THE"), (None, "w5 w6")]
    return docs, items


@pytest.mark.parametrize("block_terms", [50_000, 20])
def test_search_equals_plain(spark, block_terms):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    d, i = (x.withColumns({c: F.lit("x") for c in CLASHING}) for x in (d, i))
    got = lexical.search(d, i, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs[:20], "doc_id bigint, text string")
    i = spark.createDataFrame(items[:3], "item_id bigint, text string")
    assert lexical.search(d.filter("false"), i).count() == 0
    assert lexical.search(d, i.filter("false")).count() == 0


def test_graph_shares_common_parts():
    rng = random.Random(4)
    common = {b"c%d" % i for i in range(30)}
    items = [common | {b"t%d" % rng.randint(0, 60) for _ in range(10)} for _ in range(40)]
    graph = lexical.Graph(items)
    assert len({graph.class_of[t] for t in common}) == 1        # one shared set, one accumulator
    plain = sum(len({graph.class_of[t] for t in own}) for own in items)
    assert graph.steps and len(graph.steps) + sum(map(len, graph.items)) < plain
    value = {t: rng.randint(1, 1000) for t in graph.terms}
    accumulators = np.zeros((graph.classes, 1), np.int64)
    for t, c in graph.class_of.items():
        accumulators[c] += value[t]
    assert graph.totals(accumulators)[:, 0].tolist() == [sum(value[t] for t in own) for own in items]


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    good = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(good[0][2]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, _, v in good]
    order = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, good[r][2]))
    books = [[cut[r][p] for r in order[:entries]] for p in range(parts)]
    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), e) for e, y in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(nearest(c[p], books[p])[1], []).append(c[p])
            for e, members in groups.items():
                books[p][e] = [sum(col) // len(members) for col in zip(*members)]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    labels = Counter()
    for (_, label, _), f in zip(good, found):
        labels[label] += sum(d for d, _ in f)
    small = {label: n for label, n in labels.items() if n < 2 ** 63}
    return sorted([(i, "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), small.get(label), sha)
                   for (i, label, _), f in zip(good, found)], key=repr)


@pytest.mark.parametrize("size, spread, width", [(400, 1.0, 16), (200, 1e5, 16), (9, 1.0, 8), (300, 0.002, 24)])
def test_codes_equal_plain(spark, size, spread, width):
    rng = random.Random(size)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, 2, None])) for i in range(size)]
    rows += [(size + i, rows[i % 5][1], 1) for i in range(20)]      # ties and repeated vectors
    rows += [rows[0], (None, rows[1][1], 2), (-3, None, 0), (-2, [None] * width, 0),
             (-1, [float("nan")] * width, 0), (-4, [float("inf")] + [0.0] * (width - 1), None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in CLASHING})
    got = vector_codes.compress(df)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_codes(rows)


def test_masks_hold_every_near_entry():
    rng = np.random.default_rng(0)
    entries, x = rng.integers(-50, 50, (40, 4)), rng.integers(-60, 60, (500, 4))
    slices = vector_codes.Slices(entries)
    away = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    for radius in (0, 5, 30):
        mask = slices.within(x, np.full(len(x), radius))
        held = (mask[:, None] >> np.arange(40, dtype=np.uint64)) & np.uint64(1)
        assert ((np.abs(x[:, None, :] - entries[None]).max(axis=2) <= radius) == held.astype(bool)).all()
    code, best = slices.nearest(x)
    assert (best == away.min(axis=1)).all() and (code == away.argmin(axis=1)).all()


def test_codes_of_odd_tables(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema)).count() == 0
    mixed = [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1), (3, [0.5] * 7, 1), (4, [], 1), (5, [1e300] * 8, 1)]
    got = vector_codes.compress(spark.createDataFrame(mixed, schema)).collect()
    assert [(r.vec_id, r.code, r.error) for r in got] == [(1, "00" * 8, 0)]
