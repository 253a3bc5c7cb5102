"""The pipeline's two stages that drop copies, where doc_ids are null or stand more than once."""

from __future__ import annotations

from collections import Counter

import pytest

from quizmill.llm import exact_dedup, simhash

A, B = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates])
def test_one_of_each_group_stays(spark, drop):
    rows = [(None, A), (None, A), (7, A), (7, A), (7, B), (None, "only one"), (None, "only one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in drop(docs).collect()) == Counter([(7, A), (7, B), (None, "only one")])


def test_of_equal_texts_one_row_stays(spark):
    rows = [(1, "a"), (1, "a"), (None, "b"), (2, "b"), (3, "c"), (3, "d"), (9, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in exact_dedup.drop_exact_duplicates(docs).collect()) == Counter([(1, "a"), (2, "b"), (3, "c"), (9, "d")])
