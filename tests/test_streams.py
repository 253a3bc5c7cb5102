"""The streams and their stores give what the batch folds give, read and write only what a batch touches, and run twice alike."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quizmill.operators import practice as K
from quizmill.plans import queries as Q
from quizmill.plans.fixtures import Tables
from quizmill.sources import ingest as I
from quizmill.streaming import attempts as A
from quizmill.streaming.store import BUCKET, KeyedTable
from tests.compare import connect, rows_of, same


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    t = Tables(spark, sf_dir)
    t.__dict__["graded"] = t.written(t.graded, "graded")  # the other tables follow from it
    return t


def sets(t, n=6):
    """The graded attempts in sets; later ones bring earlier attempts of known sessions."""
    return [t.graded.where(F.col("seq") * 7 % n == i) for i in range(n)]


def test_records_are_the_batch_fold(spark, tables, tmp_path):
    store = A.RecordStore(spark, f"{tmp_path}/records", buckets=5)
    parts = sets(tables)
    for i in (0, 1, 2, 3, 4, 5, 5, 2):  # the last batch runs twice, and one comes again that is long done
        store.write_batch(parts[i], i)
    assert rows_of(store.records().drop("last_seq")) == rows_of(tables.record)


def test_a_batch_reads_its_own_folders(spark, tables, tmp_path):
    store = A.RecordStore(spark, f"{tmp_path}/records", buckets=200)
    store.write_batch(tables.graded, 0)
    files = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "records/rows").rglob("*.parquet")}
    sessions = [r[0] for r in tables.graded.select("session_id").distinct().orderBy("session_id").limit(2).collect()]
    late = tables.graded.where(F.col("session_id").isin(sessions)).withColumn("seq", F.col("seq") + 10**9)
    old = store.touched(A.fold_batch(late))
    plan = plan_of(old)
    assert re.search(rf"PartitionFilters: \[[^\]]*{BUCKET}", plan)
    assert "Exchange" not in plan and old.count() < store.records().count() / 20
    store.write_batch(late, 1)
    now = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "records/rows").rglob("*.parquet")}
    assert len(set(files) - set(now)) <= 2 and sum(now.get(k) == v for k, v in files.items()) >= len(files) - 2
    assert store.records().where("first_seq > 1000000000").count() == 0


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "a long, b string, v int", ["a", "b"], ["a"], buckets=3)
    assert table.rows().count() == 0
    put = lambda rows, i: table.upsert(spark.createDataFrame(rows, "v int, b string, a long, more int"), i)
    put([(1, "x", 1, 0), (2, "y", 1, 0), (3, None, 2, 0)], 0)
    put([(9, "x", 1, 0), (4, "z", 7, 0)], 1)
    expected = [(1, "x", 9), (1, "y", 2), (2, None, 3), (7, "z", 4)]
    assert sorted(table.rows().collect(), key=repr) == expected
    put([], 2)
    put([(0, "x", 1, 0)], 1)  # over
    assert sorted(table.rows().collect(), key=repr) == expected
    # a batch that was merged, and broke off while it was put in place
    for f in (tmp_path / "t/rows").glob(f"{BUCKET}=*/*.parquet"):
        f.unlink()
    put([(5, "n", 1, 0)], 3)
    assert (1, "n", 5) in [tuple(r) for r in table.rows().collect()]


def test_broken_off_batches_are_put_in_place_again(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", "a long, v int", ["a"], buckets=1)
    table.upsert(spark.createDataFrame([(1, 1), (2, 2)], "a long, v int"), 0)
    table.upsert(spark.createDataFrame([(2, 3)], "a long, v int"), 1)
    for f in (tmp_path / "t/rows").rglob("*.parquet"):
        f.unlink()
    table.upsert(spark.createDataFrame([(2, 3)], "a long, v int"), 1)
    assert sorted(tuple(r) for r in table.rows().collect()) == [(1, 1), (2, 3)]


def shuffled(spark):
    """The rows that all stages so far gave to exchanges."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_kept_records_do_not_travel(spark, tables, tmp_path):
    late = tables.graded.where("seq % 10 = 3").withColumn("seq", F.col("seq") + 10**9)
    late = tables.written(late, "late")
    store = A.RecordStore(spark, f"{tmp_path}/records", buckets=4)
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        store.write_batch(tables.graded, 0)
        kept, before = store.records().count(), shuffled(spark)
        store.write_batch(late, 1)
        assert shuffled(spark) - before < kept / 2
    assert rows_of(store.records().drop("last_seq")) == rows_of(K.fold_records(tables.graded.unionByName(late)))
    assert not spark.catalog.listTables(pattern="keyed_*")


def test_lines_of_the_record_stream_travel_few_times(spark, sf_dir):
    lines, before = Tables(spark, sf_dir).read("lineitem").count(), shuffled(spark)
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        Q.QUERIES["t02_record_stream"](spark, sf_dir)
    assert shuffled(spark) - before < 7 * lines


def test_a_batch_is_graded_without_ids_of_nothing(spark, tables):
    t = tables
    attempts = t.written(t.attempt, "attempt")
    session, listed = t.bucketed(t.requests.select("session_id"), "session", ["session_id"]), t.bucketed(t.listed, "listed", ["session_id"])
    question = t.bucketed(t.question.select("id", "bank_id", "type", "answer"), "question", ["id"])
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", **I.CO_PARTITIONED}):
        assert rows_of(K.grade_batch(attempts, session, question, listed)) == rows_of(t.graded)
        for column in ("session_id", "question_id"):
            before = shuffled(spark)
            assert K.grade_batch(attempts.withColumn(column, F.lit(-1).cast("long")), session, question, listed).collect() == []
            assert shuffled(spark) - before < attempts.count() / 10


def test_a_batch_that_broke_off_between_folders_is_added_once(spark, tmp_path, monkeypatch):
    kind, added = "a long, v int", lambda both: both.select("a", (F.coalesce("old.v", F.lit(0)) + F.coalesce("new.v", F.lit(0))).alias("v")).where("v <> 0")
    table = KeyedTable(spark, f"{tmp_path}/t", kind, ["a"], buckets=4)
    put = lambda t, rows, i: t.upsert(spark.createDataFrame(rows, kind), i, added)
    put(table, [(i, 1) for i in range(20)] + [(None, 1)], 0)
    changes, done, move = [(i, 10) for i in range(10, 30)] + [(0, -1), (None, 10)], [], table._move
    assert len(table.numbers(spark.createDataFrame(changes, kind))) > 2

    def break_off(source, target):
        done.append(target)
        if len(done) == 3:
            raise OSError("broken off")
        move(source, target)

    monkeypatch.setattr(table, "_move", break_off)
    with pytest.raises(OSError):
        put(table, changes, 1)
    again = KeyedTable(spark, f"{tmp_path}/t", kind, ["a"], buckets=4)
    expected = {**{i: 1 for i in range(1, 10)}, **{i: 11 for i in range(10, 20)}, **{i: 10 for i in range(20, 30)}, None: 11}
    for _ in range(2):
        put(again, changes, 1)
        assert {r.a: r.v for r in again.rows().collect()} == expected and again.rows().count() == len(expected)


def test_one_completion_event_a_session(spark, tables, tmp_path):
    t = tables
    store = A.ProgressStore(spark, f"{tmp_path}/p", t.session, buckets=4)
    parts = sets(t, 3)
    seen = []
    for i in (0, 1, 1, 2, 2):
        store.write_batch(parts[i], i)
        seen.append({r.session_id for r in store.completions(i).collect()})
    assert seen[1] == seen[2] and seen[3] == seen[4] and not seen[0] & seen[2] and not seen[2] & seen[4]
    completed = {r.session_id for r in t.progress.where("status = 'COMPLETED'").collect()}
    assert seen[0] | seen[2] | seen[4] == completed and len(seen[0]) + len(seen[2]) + len(seen[4]) == len(completed)
    columns = ["session_id", "answered_count", "correct_count", "total_count", "completed_at"]
    assert rows_of(store.progress.rows().select(columns)) == rows_of(t.progress.where("answered_count > 0").select(columns))


def test_registered_streams_see_three_batches(spark, sf_dir):
    t = Tables(spark, sf_dir)
    run = Q.StreamRun(t)
    rows = run.updates(run.graded, "append")
    assert {r.batch for r in rows.select("batch").distinct().collect()} == {0, 1, 2}
    assert rows.groupBy("session_id").agg(F.count_distinct("batch").alias("n")).where("n > 1").count() > 0
    same(rows.select("seq", "session_id", "question_id", "is_correct"), connect(sf_dir), Q.SQL["t01_graded_stream"])


def test_bucketed_tables_are_not_exchanged(spark, tables):
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", **I.CO_PARTITIONED}):
        attempts = tables.written(tables.attempt, "attempt")
        r12 = plan_of(Q.QUERIES["r12_session_result"](spark, tables.sf_dir))
        listed, session = tables.bucketed(tables.listed, "listed", ["session_id"]), tables.bucketed(tables.requests, "session", ["session_id"])
        question = tables.bucketed(tables.question.select("id", "bank_id", "type", "answer"), "question", ["id"])
        t01 = plan_of(A.graded_stream(attempts, session, question, listed))
    assert below_exchange(r12, "bucketed_") == [] and r12.count("bucketed_") >= 4
    assert below_exchange(t01, "bucketed_") == [] and t01.count("bucketed_") >= 4


def below_exchange(plan, name):
    """Scans of a plan with ``name`` whose rows are exchanged before anything joins, groups or numbers them."""
    out, above = [], []
    for line in plan.split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        text = line.lstrip(" :+-*()0123456789")
        above = [(d, kind) for d, kind in above if d < depth]
        nearest = next((kind for _, kind in reversed(above) if re.match(r"Exchange|\w*Join|\w*Aggregate|Window", kind)), "")
        if name in text and text.startswith("FileScan") and nearest.startswith("Exchange"):
            out.append(text[:200])
        above.append((depth, text))
    return out
