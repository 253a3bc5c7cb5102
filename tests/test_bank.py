"""Numbering, import reports and deletion, at sizes and skews that the registered queries do not reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from quizmill.operators import bank as B
from quizmill.plans import queries as Q
from quizmill.plans.fixtures import Tables
from quizmill.sources.bank_store import BankStore


def test_one_group_of_all_rows_spans_tasks(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(7).alias("g"), (F.lit(n) - F.col("id")).alias("at"), F.col("id").alias("v")).repartition(5)
    out = B.assign_ids(df, "g", ["at"], first=100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") <= plan.count("_part") and "windowspecdefinition(g#" not in plan
    rows = out.collect()
    assert out.columns == ["g", "at", "v", "id"] and sorted((r.at, r.id) for r in rows) == [(i + 1, i + 100) for i in range(n)]


def test_groups_follow_each_other(spark):
    rows = [(2, "b"), (None, "x"), (1, "c"), (2, "a"), (1, "a"), (1, "a"), (9, None)]
    out = B.assign_ids(spark.createDataFrame(rows, "g long, k string"), "g", ["k"]).orderBy("id").collect()
    assert [(r.g, r.k) for r in out] == [(None, "x"), (1, "a"), (1, "a"), (1, "c"), (2, "a"), (2, "b"), (9, None)] and [r.id for r in out] == list(range(1, 8))
    assert B.assign_ids(spark.createDataFrame([], "g long, k string"), "g", ["k"]).count() == 0


def test_skipped_numbers_are_runs_in_bounded_parts(spark):
    n = 10_000
    raw = spark.range(n).select(F.lit(1).alias("bank_id"), (F.col("id") + 1).cast("int").alias("pos"), F.lit("单选题").alias("raw_type"), F.when(F.col("id") % 5 == 0, "干").alias("raw_stem"), F.lit("A").alias("raw_answer"), F.expr("array(struct('A' as key, 'x' as text))").alias("raw_options"))
    rows = B.skipped_numbers(raw, part=1000).collect()
    assert len(rows) == 11 and max(len(r.ranges) for r in rows) <= 201
    assert sorted(k for r in rows for x in r.ranges for k in range(x.first, x.last + 1)) == [i for i in range(1, n + 1) if i % 5 != 1]
    assert "collect" not in B.import_report(raw)._jdf.queryExecution().executedPlan().toString()


def test_copies_have_the_same_blanks(spark):
    answers = ["Brand#1；12", "Brand#11；2", " brand#1 ; 12；", "Brand 1；1；2", "A,D", "ad", None, ""]
    df = spark.createDataFrame(list(enumerate(answers)), "pos int, answer string").withColumn("stem", F.lit("Stem, 1")).withColumn("options", F.expr("array(named_struct('key', 'A', 'text', 'x'))"))
    assert sorted(r.pos for r in B.dedup_questions(df).collect()) == [0, 1, 3, 4, 6]
    assert sorted(r.pos for r in B.merge_corpora(df.where("pos <> 0"), df.where("pos = 0")).collect()) == [1, 2, 3, 4, 6]


def files(base):
    return {str(f.relative_to(base)): f.stat().st_mtime_ns for f in base.rglob("*.parquet")}


def test_deletion_leaves_other_banks_files(spark, sf_dir, tmp_path):
    t = Tables(spark, sf_dir)
    store = BankStore(spark, f"{tmp_path}/s")
    store.write(Q.bank_tables(t))
    before = files(tmp_path / "s")
    store.delete_banks([3, 4, 777])
    after = files(tmp_path / "s")
    assert not any("_bank=3/" in f or "_bank=4/" in f for f in after)
    assert {f: v for f, v in before.items() if not f.startswith("bank/") and "_bank=3/" not in f and "_bank=4/" not in f} == {f: v for f, v in after.items() if not f.startswith("bank/")}
    store.delete_chapters([51, 52])  # of bank 5
    last = files(tmp_path / "s")
    assert {f: v for f, v in after.items() if "_bank=5/" not in f} == {f: v for f, v in last.items() if "_bank=5/" not in f}
    assert store.read("question", [5]).where("chapter_id in (51, 52)").count() == 0 < store.read("question", [5]).count()
    kept = store.read("question", [5]).count()
    store.delete_banks([3])  # once more
    store.delete_chapters([51])
    assert store.read("question", [5]).count() == kept
    assert store.read("bank").where("id in (3, 4)").count() == 0 and store.read("bank").count() == 23
