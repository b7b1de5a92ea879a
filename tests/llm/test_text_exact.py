"""Large vectors, ids with several texts, and the kernel against explicit vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aquagrid.llm import byte_bpe, near_dedup, topk, toxicity


@pytest.mark.parametrize("spread", [1.0, 1e3, 1e5, 4e5])
def test_large_vectors_have_exact_scores(spark, spread):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(0, spread, 8)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [int(np.floor(1024 * x)) for x in v] for i, v in rows}
    want = []
    for q in (0, 100, 200, 300):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        if any(abs(s) >= 2 ** 63 for s, _ in scored):
            pytest.skip("a score leaves 64 bits")
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:10], 1)]
    got = topk.top_k(df, F.col("id") % 100 == 0, candidate_block=64, query_block=2)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_ids_with_two_texts_stand_for_one_of_them(spark):
    rng = random.Random(3)
    def text():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    def digest(t):
        import hashlib
        return hashlib.md5(" ".join(t.split()).encode()).digest()
    rows, want, chosen = [], {}, {}
    for i in range(24):
        first, second = text(), text()
        low, high = sorted((first, second), key=digest)
        rows += [(i, first), (i, second), (100 + i, low + " tail"), (200 + i, high + " tail")]
        want.update({i: i, 100 + i: i, 200 + i: 200 + i})
        chosen[i] = low
    alone = text()
    rows += [(50, None), (50, alone), (51, alone + " tail"), (52, ""), (52, "")]
    want.update({50: 50, 51: 50, 52: 52})
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    assert {r.doc_id: r.class_id for r in near_dedup.classes(df).collect()} == want
    kept = near_dedup.keep_one(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want.values()))
    assert all(r.text == chosen[r.doc_id] for r in kept if r.doc_id in chosen)
    assert next(r.text for r in kept if r.doc_id == 50) == alone


def test_raw_similarities_equal_explicit_vectors():
    landmarks = ["idiot", "banana", "scoundrel", "aaaa"]
    words = ["idiot", "idiotic", "i.d.i.o.t", "bananas", "banana", "bananabanana", "aaaaaa", "scoundrels"]
    near, values = toxicity.Kernel(landmarks).raw(words)
    want = toxicity.explicit(words) @ toxicity.explicit(landmarks).T
    got = np.zeros_like(want)
    got[near] = values
    over = want > toxicity.FLOOR
    assert over.any() and np.allclose(got[over], want[over], atol=1e-5)
    assert (got[~over] <= toxicity.FLOOR + 1e-5).all()


def test_most_texts_are_halved(spark):
    from aquagrid.llm.common import table
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    assert docs.agg(F.avg((F.length("text") > byte_bpe.LEAF).cast("int"))).first()[0] > 0.85
