"""The registered text queries on the small tables, and the pipeline stage by stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from aquagrid.llm import queries
from aquagrid.llm.common import table
from checks.run import compare, connect
from tests.llm.test_text_operators import _check_packing, _pieces, _plain_classes

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, FOLDER), queries.ORACLES[name], connect(FOLDER)) is None


@pytest.mark.parametrize("name", ["op5_toxicity", "op6_token_counts", "op7_language_id", "op10_byte_bpe",
                                  "op1_lm_scoring", "op8_near_dedup"])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r[0] for r in table(spark, FOLDER, "documents").select("doc_id").collect())
    assert sorted(r[0] for r in queries.QUERIES[name](spark, FOLDER).select("doc_id").collect()) == ids


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    langs = queries.QUERIES["op7_language_id"](spark, folder).filter("held_out").join(docs, "doc_id")
    assert langs.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    toxic = queries.QUERIES["op5_toxicity"](spark, folder).filter("held_out").join(labels, "doc_id")
    clean = toxic.filter("toxic = 0").agg(F.avg(1 - F.col("predicted"))).first()[0]
    assert clean > 0.97
    scores = queries.QUERIES["op1_lm_scoring"](spark, folder).filter("held_out")
    better = scores.agg((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).first()[0]
    assert better > 0.25        # log10 a token


def test_pipeline_stages(spark):
    docs = table(spark, FOLDER, "documents")
    named = dict(corpus_pipeline.STAGES)
    first = named["language"](spark, docs, FOLDER).cache()
    letters = docs.filter(F.col("text").rlike(r"\p{L}"))
    assert first.columns == docs.columns and first.count() == letters.count()
    second = named["toxicity"](spark, first, FOLDER).cache()
    assert second.columns == docs.columns and second.count() <= first.count()
    third = named["near_copies"](spark, second, FOLDER).cache()
    want = _plain_classes([(r["doc_id"], r["text"]) for r in second.collect()])
    assert third.columns == docs.columns
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(set(want.values()))
    last = named["packing"](spark, third, FOLDER).collect()
    _check_packing(last, 4096, _pieces([(r["doc_id"], r["text"]) for r in third.collect()], 4096))
    assert Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
