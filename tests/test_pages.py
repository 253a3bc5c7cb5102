"""Pages by seeking are the pages of the whole order, over ties and nulls."""

from __future__ import annotations

import random

import pytest

from quizmill.operators import pages as P


@pytest.mark.parametrize("order", [P.NEWEST, P.OLDEST])
def test_pages_are_the_whole_order(spark, tmp_path, order):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1, 1, 2, 3])) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, n int").selectExpr("id", "timestamp_seconds(n) as created_at")
    df = P.write_for_pages(df, order, f"{tmp_path}/p")
    whole = [r.id for r in P.page_after(df, order, 1000).collect()]
    assert len(whole) == 60
    seen, after = [], None
    while True:
        page = P.page_after(df, order, 7, after)
        seen += [r.id for r in page.collect()]
        after = P.last_key(page, order)
        if after is None:
            break
    assert seen == whole and P.matches(df).first().matches == 60


def test_a_later_page_reads_no_more(spark, tmp_path):
    df = spark.range(40_000).selectExpr("id", "timestamp_seconds(id div 3) as created_at", "repeat('x', 50) as stem")
    df = P.write_for_pages(df.repartition(4), P.NEWEST, f"{tmp_path}/p")
    first = P.page_after(df, P.NEWEST, 20)
    later = P.page_after(df, P.NEWEST, 20, (spark.sql("select timestamp_seconds(100) as t").first().t, 302))
    assert [r.id for r in later.collect()] == list(range(301, 281, -1))
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=20" in plan and "LessThanOrEqual(created_at" in plan and first.count() == 20
