"""Removal of repeated passages against a brute-force version."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.llm import substring

CLASHING = ["chunk", "n", "block", "words", "node", "start", "source", "gone", "paths"]


def plain(rows, k=13):
    """The contract's columns of every row, by sets of windows."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for a in range(len(words) - k + 1):
            w = tuple(words[a:a + k])
            if i is not None:
                least[w] = min(least.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for a in range(len(words) - k + 1):
            if i is not None and least[tuple(words[a:a + k])] < i:
                gone.update(range(a, a + k))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed=5, n=160, vocabulary=9):
    """Texts of few words, with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    words = ["a", "bb", "ccc", "Über", "漢字", "x" * 40, "é é", "...", "0"][:vocabulary]
    def run(k):
        return [rng.choice(words) for _ in range(k)]
    passages = [run(rng.randint(13, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        text = run(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            text += rng.choice(passages)[rng.randint(0, 3):] + run(rng.randint(0, 20))
        rows.append((i * 7 % n, rng.choice([" ", "\n", "\t  ", "\x0b"]).join(text)))
    hot = " ".join(passages[0])
    rows += [(1000 + i, hot) for i in range(60)]                    # a large group of copies
    rows += [(2000 + i, hot + f" end{i}") for i in range(60)]       # and of near copies
    rows += [(5, rows[5][1]), (5, "another text of document five " + hot), (None, hot), (None, None),
             (3000, None), (3001, ""), (3002, " \n "), (3003, " ".join(["a"] * 400)),
             (3004, " ".join(["a"] * 13)), (3005, " ".join(["a"] * 12)), (-1, "b" * 600_000 + " " + hot)]
    return rows


@pytest.mark.parametrize("chunk_bytes, vocabulary", [(1 << 21, 9), (500, 9), (3000, 2)])
def test_equals_plain_windows(spark, chunk_bytes, vocabulary):
    rows = corpus(vocabulary=vocabulary)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in CLASHING})
    got = substring.remove_repeats(df, chunk_bytes=chunk_bytes)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()),
                  key=repr) == plain(rows)
    assert got.selectExpr("inline(paths)").count() > 0
    assert substring.sources(got).filter("not verified").count() == 0


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring.remove_repeats(empty).count() == 0
    assert substring.repeated_spans(empty).count() == 0


def test_spans_equal_their_source(spark):
    rows = [r for r in corpus(3) if r[0] is not None and r[0] != 5]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    spans = substring.repeated_spans(df).collect()
    covered = defaultdict(set)
    for s in spans:
        own = words[s.doc_id][s.start:s.start + s.n]
        assert s.n >= 13 and len(own) == s.n and s.source <= s.doc_id
        assert own == words[s.source][s.source_start:s.source_start + s.n]
        covered[s.doc_id].update(range(s.start, s.start + s.n))
    holders = defaultdict(set)
    for i, w in words.items():
        for a in range(len(w) - 12):
            holders[tuple(w[a:a + 13])].add(i)
    for i, w in words.items():
        want = {p for a in range(len(w) - 12) if len(holders[tuple(w[a:a + 13])]) > 1
                for p in range(a, a + 13)}
        assert covered[i] == want


def test_a_long_path_is_one_piece(spark):
    passage = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(1, "one two " + passage), (2, passage + " three"), (3, "zero " + passage)],
                               "doc_id bigint, text string")
    spans = sorted((s.doc_id, s.start, s.n, s.source, s.source_start)
                   for s in substring.repeated_spans(df).collect())
    assert spans == [(1, 2, 500, 1, 2), (2, 0, 500, 1, 2), (3, 1, 500, 1, 2)]


def test_hashes_do_not_depend_on_segments():
    rng = random.Random(1)
    raw = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 30)))
                   for _ in range(30_000)).encode() + b" " + b"y" * 300_000 + b" end"
    starts, ends = substring.word_spans(raw)
    whole = substring.word_hashes(raw, starts, ends)
    assert [raw[a:b] for a, b in zip(starts, ends)] == raw.split()
    by_word = {}
    for w, h in zip(raw.split(), whole.tolist()):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    tail = len(starts) - 5_000
    cut = raw[starts[tail]:]
    assert np.array_equal(substring.word_hashes(cut, *substring.word_spans(cut)), whole[tail:])
