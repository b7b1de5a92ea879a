"""Bounds of memory, and ids that are texts."""

import random
import tracemalloc
from collections import Counter
from pathlib import Path
from time import process_time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.llm import language_id, lm_scoring, near_dedup, packing, toxicity
from aquagrid.llm.common import WordCache, slices
from aquagrid.session import stored


def test_word_grams_hold_few_words_at_a_time():
    rng = random.Random(1)
    words = Counter({"".join(rng.choice("abcdefghijklmnopqrstuéà") for _ in range(rng.randint(3, 12))).encode():
                     rng.randint(1, 9) for _ in range(300_000)})
    language_id._letters()
    tracemalloc.start()
    grams, counts = language_id._word_grams(words)
    assert tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()
    whole = language_id._word_grams(words, at_once=10 ** 9)
    assert np.array_equal(grams, whole[0]) and np.array_equal(counts, whole[1])


def test_profile_counts_equal_plain_counts(spark):
    rows = [("en", "The cat, the CAT!"), ("en", "a dog"), ("fr", "été là"), ("fr", None), (None, "x")]
    df = spark.createDataFrame(rows, "lang string, text string")
    plain = {}
    for lang, text in rows:
        if lang is None or text is None:
            continue
        for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
            padded = f"_{word}_"
            for k in (1, 2, 3):
                for i in range(len(padded) - k + 1):
                    gram = padded[i:i + k]
                    if gram.strip("_") and (k > 1 or gram != "_"):
                        plain.setdefault(lang, Counter())[gram] += 1
    def code(gram):
        n = 0
        for c in gram:
            n = (n << 21) | (language_id.BLANK if c == "_" else ord(c))
        return n
    got = language_id.learn(df, depth=1000)
    assert set(got) == set(plain)
    for lang, counts in plain.items():
        by_code = {code(g): n for g, n in counts.items()}
        assert got[lang] == sorted(by_code, key=lambda g: (-by_code[g], g))


def test_caches_are_bounded_and_emptied():
    cache = WordCache(lambda ws: [bytes(1000) for _ in ws], limit=100_000)
    for i in range(50):
        cache.prepare({f"w{i}-{j}" for j in range(20)})
        assert len(cache) < 120
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"a": list(range(2_500))})
    assert [b.num_rows for b in slices([batch])] == [1_000, 1_000, 500]
    assert len(cache) == 0


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing_takes_text_ids(spark, capacity):
    rows = [(k, "some words " * n) for k, n in [("", 3), ("b", 40), (None, 5), ("a", 90), ("a", 90)] * 20]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(9)
    got = packing.pack(df, capacity=capacity, fan_in=2, bins_per_task=4).collect()
    assert {r.doc_id for r in got} == {"", "b", None, "a"}
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= capacity


def test_freed_memory_goes_back_at_the_end_of_a_task():
    import pyarrow as pa

    def resident():
        with open("/proc/self/status") as lines:
            return next(int(line.split()[1]) for line in lines if line.startswith("VmRSS")) / 1024

    rows = iter(slices([pa.RecordBatch.from_pydict({"a": [1]})]))
    next(rows)
    held = [bytes(1_000) for _ in range(200_000)]
    pins = held[::100]              # what stays keeps the allocator from shrinking by itself
    del held
    before = resident()
    assert next(rows, None) is None
    assert before - resident() > 100
    assert len(pins) == 2_000


def test_cached_similarities_hold_no_other_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(3_000)]
    found = toxicity.Kernel(words[:5]).words(words)
    rows = [row for row in found if row is not None]
    assert len(rows) > 5 and all(row.base is None for row in rows)


def test_pairs_are_files_and_words_have_keys_of_their_own(spark):
    rows = [(i, f"the cat sat on the mat {i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    vocabulary = lm_scoring.Vocabulary(lm_scoring.count_words(docs), hot=8, word_classes=4)
    pairs = lm_scoring.pair_counts(docs, vocabulary)[1]
    assert pairs.inputFiles()       # each of the scans that follow reads the columns it needs
    words = spark.createDataFrame([(f"{i}".encode(), p) for i in range(500) for p in (-1, i)], "word binary, pair bigint")
    keys = [r[0] for r in words.select(lm_scoring._key(F.col("word"), F.col("pair"))).collect()]
    assert len(set(keys)) == 1_000 and sum(k < 0 for k in keys) == 500
    assert [k for k in keys if k >= 0] == list(range(500))


def test_hot_pairs_are_found_where_slots_are_shared():
    rng = np.random.default_rng(5)
    pairs = np.unique(rng.integers(0, 1 << 40, 1_500_000))
    held = lm_scoring.HotPairs(pairs[::2], np.arange(len(pairs[::2])) * 0.5)
    assert len(held.others) > 1_000
    at = held.find(pairs)
    assert (at[1::2] == -1).all() and np.array_equal(at[::2], np.arange(len(held.pairs)))


def test_words_meet_only_the_landmarks_they_share_letters_with():
    rng = random.Random(5)

    def some(letters, count, size=8):
        return list(dict.fromkeys("".join(rng.choice(letters) for _ in range(size)) for _ in range(count)))

    close, others = some("abcdefghijklm", 16), some("nopqrstuvwxyz", 1_500)
    words = [w[:7] + "aé"[i % 2] + "x" * (i % 9) for i, w in enumerate(close * 60)]

    def seconds(landmarks):
        kernel, best = toxicity.Kernel(landmarks), 1e9
        for _ in range(3):
            began = process_time()
            near, values = kernel.raw(words)
            best = min(best, process_time() - began)
        plain = toxicity.explicit([words[i] for i in near]) @ toxicity.explicit(landmarks).T
        over = plain > toxicity.FLOOR
        assert len(near) == len(words) and np.allclose(values[over], plain[over], atol=1e-6)
        assert (values[~over] <= toxicity.FLOOR + 1e-6).all()
        return best

    few = seconds(close)
    # landmarks of other letters cost a word the places of their results, and no products
    assert seconds(close + others) < 12 * few


def test_lines_without_a_similar_word_do_not_change_the_sentences():
    kernel = toxicity.Kernel(["hateful", "poison"])
    text = "All is well.\n\nYou hateful one! No.  \n h a t e f u l  thing. Poisons ; hatefull\nend. poison"
    lines = list(toxicity.Reader(kernel).sentences([text, "fine\n" * 9, "so hateful.Yes\n"]))
    get = dict(zip(words := ["hateful", "poisons", "hatefull", "poison"], kernel.words(words)))
    assert np.allclose(lines[0], np.array(
        [get["hateful"], get["hateful"], np.maximum(get["poisons"], get["hatefull"]), get["poison"]]))
    assert len(lines[1]) == 0 and len(lines[2]) == 1


def test_darts_of_short_texts_are_thrown_together(monkeypatch):
    rng = np.random.default_rng(4)
    sizes = [1, 1, 2, 3, 40, 700]
    sets = [rng.integers(0, 2 ** 63, n).astype(np.uint64) for n in sizes]
    weights = [rng.choice([0.3, 1.0, 2.5, 6.0], n) for n in sizes]
    mixed, calls, k = near_dedup.mixed, [], 350

    def plain(elements, weights):
        """One dart after another."""
        best, names, level = np.full(k, np.inf), np.zeros(k, np.uint64), (k * np.log(k) + 2 * k) / weights.sum()
        one = lambda x: mixed(np.array([x], np.uint64))[0]
        while np.isinf(best).any():
            best[:] = np.inf
            for element, weight in zip(elements, weights):
                for strip in range(max(int(np.ceil(np.log2(weight))), 0) + 1):
                    low, width = (0.0, 1.0) if strip == 0 else (2.0 ** (strip - 1),) * 2
                    region, height, i = one(element ^ one(np.uint64(strip))), 0.0, 0
                    while True:
                        i += 1
                        dart = one(region + np.uint64(i) * near_dedup.MIX[1])
                        height -= np.log(near_dedup.uniform(dart)) / width
                        if height > level:
                            break
                        place = one(dart ^ near_dedup.MIX[2])
                        slot = int(place >> np.uint64(40)) % k
                        across = float(place & np.uint64((1 << 40) - 1)) * 2.0 ** -40
                        if low + across * width < weight and height < best[slot]:
                            best[slot], names[slot] = height, dart
            level *= 2
        return names

    with np.errstate(over="ignore"):
        want = [plain(s, w) for s, w in zip(sets, weights)]
        ones = [plain(s, np.ones(len(s))) for s in sets]
    monkeypatch.setattr(near_dedup, "mixed", lambda x: calls.append(1) or mixed(x))
    assert (near_dedup.signatures(sets, weights, k) == np.array(want)).all()
    assert (near_dedup.signatures(sets, [np.ones(n) for n in sizes], k) == np.array(ones)).all()
    assert len(calls) < 600      # a text of one shingle alone has some 2,750 darts


def test_shuffle_files_of_stored_rows_are_removed(spark):
    status = spark.sparkContext._jsc.sc().env().blockManager()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)

    def shuffles(free):
        rows = spark.range(5_000).groupBy((F.col("id") % 700).alias("a")).agg(F.count("*").alias("n"))
        held = Path(status.diskBlockManager().localDirsString()[0])
        old = set(held.rglob("shuffle_*.data"))
        got = stored(rows, free=free)
        new = set(held.rglob("shuffle_*.data")) - old
        assert got.count() == 700 and got.agg(F.sum("n")).first()[0] == 5_000
        return len(new)

    assert shuffles(True) == 0 < shuffles(False)
    assert spark.conf.get(setting) == before


def _shuffle_files(spark):
    held = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()[0]
    return set(Path(held).rglob("shuffle_*.data"))


def test_scores_shuffle_only_what_texts_ask_for(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.5))}" for _ in range(30))) for i in range(60)]
    rows += [(60, ""), (61, None), (62, "w1 w1"), (63, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    training = docs.filter("doc_id % 4 <> 1")
    counts = lm_scoring.bucketed(lm_scoring.count_words(training), "pair")
    vocabulary = lm_scoring.Vocabulary(counts, hot=30, word_classes=8)
    classes, pairs = lm_scoring.pair_counts(training, vocabulary)
    likely = lm_scoring.log_probabilities(lm_scoring.train(classes, steps=20))
    old = _shuffle_files(spark)
    direct = lm_scoring.DirectWeights(pairs, vocabulary, likely, hot=5)
    assert not _shuffle_files(spark) - old      # its sums are with the driver
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        scores = lm_scoring.score(docs, counts, vocabulary, likely, direct=direct, trained=F.expr("doc_id % 4 <> 1"))
        plan = scores._jdf.queryExecution().executedPlan().toString()
        got = {r["doc_id"]: r for r in scores.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # texts to keys, and sums to texts; both tables are read where they lie
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") == 2
    everywhere = lm_scoring.score(docs, counts, vocabulary, likely, direct=direct).collect()
    assert len(got) == len(rows) == len(everywhere)
    for r in everywhere:        # the bitmap and the weights known beforehand change no score
        assert np.isclose(r["score"], got[r["doc_id"]]["score"], rtol=1e-12)
    words = Counter(w for _, t in training.collect() for w in lm_scoring.tokens((t or "").encode()))
    all_words = sum(words.values()) + len(words) + 1
    for key, t in rows:
        line = lm_scoring.tokens((t or "").encode())
        assert got[key]["n_tokens"] == len(line) and got[key]["n_known"] == sum(w in words for w in line)
        assert np.isclose(got[key]["base_score"], sum(np.log10((words[w] + 1) / all_words) for w in line))
