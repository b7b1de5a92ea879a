"""The corpus job: identify languages, drop toxic documents, keep one of each group of near
copies, pack what stays into training sequences.

Each stage reads what the one before it wrote. All but the last return documents with all their
columns.
"""

from __future__ import annotations

from aquagrid.llm import language_id, near_dedup, packing, toxicity
from aquagrid.llm.common import id_slot, table


def language_stage(spark, docs, sf_dir):
    """Documents without a language go."""
    return language_id.keep_identified(docs)


def toxicity_stage(spark, docs, sf_dir):
    """Documents predicted toxic go. The model learns from labels outside slot 0 of 5."""
    labels = table(spark, sf_dir, "labels").filter(id_slot("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def near_copy_stage(spark, docs, sf_dir):
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def packing_stage(spark, docs, sf_dir):
    """Where every piece of every document lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copy_stage),
    ("packing", packing_stage),
]
#: Learnt models and similarity classes are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
