"""Kept counts are those from scratch after any batches, and a batch rewrites its own banks' folders only."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quizmill.operators import reports as R
from quizmill.streaming import counts as C
from tests.compare import rows_of

KIND = "id long, bank_id long, chapter_id long, type string"


def test_any_batches_add_up(spark, tmp_path):
    rng = random.Random(11)
    store = C.CountStore(spark, f"{tmp_path}/c", buckets=16)
    rows: dict[int, tuple] = {}
    banks = spark.range(9).select("id")
    for batch in range(4):
        old, new = [], []
        for _ in range(40):
            i = rng.randrange(60)
            if i in rows:
                old.append((i, *rows.pop(i)))
            if rng.random() < 0.7:
                bank = rng.randrange(8)
                rows[i] = (bank, bank * 10 + rng.randrange(3), rng.choice(["SINGLE", "ESSAY", "LEGACY", None]))
                new.append((i, *rows[i]))
        changes = C.signed(spark.createDataFrame(old, KIND), spark.createDataFrame(new, KIND))
        for _ in range(1 + batch % 2):  # every other batch runs twice
            store.add([C.question_counts(changes)], batch)
        question = spark.createDataFrame([(i, *r) for i, r in rows.items()], KIND)
        assert rows_of(store.by_bank_type(banks)) == rows_of(R.count_by_bank_type(question, banks))


def test_other_banks_are_left_alone(spark, tmp_path):
    store = C.CountStore(spark, f"{tmp_path}/c", buckets=64)
    q = spark.range(500).select("id", (F.col("id") % 50).alias("bank_id"), (F.col("id") % 50 * 10).alias("chapter_id"), F.lit("SINGLE").alias("type"), F.lit(1).alias("sign"))
    store.add([C.question_counts(q)], 0)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "c/rows").rglob("*.parquet")}
    store.add([C.question_counts(q.where("bank_id = 7"))], 1)
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "c/rows").rglob("*.parquet")}
    assert len(before) > 20 and sum(after.get(f) == v for f, v in before.items()) == len(before) - 1
    assert store.by_bank_type(spark.createDataFrame([(7,), (8,)], "id long")).orderBy("bank_id").collect() == [(7, "SINGLE", 20), (8, "SINGLE", 10)]
