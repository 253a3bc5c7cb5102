"""Accepted attempts are graded in one go: the same rows as checking and then grading, with fewer exchanges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quizmill.operators import practice as K
from quizmill.plans import queries as Q
from quizmill.plans.fixtures import Tables
from quizmill.sources import ingest as I
from quizmill.streaming import attempts as A
from tests.compare import rows_of

ATTEMPT = "seq long, session_id long, question_id long, user_answer string"


def test_accepted_attempts_are_those_that_pass_the_check(spark):
    session = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    question = spark.createDataFrame([(10, 5, "SINGLE", "A"), (11, 5, "ESSAY", "x"), (12, 5, "TRUE_FALSE", "B")], "id long, bank_id long, type string, answer string")
    listed = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (9, 10), (3, 99), (3, None)], "session_id long, question_id long")
    said = [(1, 10, "a"), (1, 10, "B"), (1, 11, "y"), (2, 12, "B"), (2, 10, "A"), (9, 10, "A"), (3, 99, "A"), (None, 10, "A"), (1, None, "A"), (3, None, "A"), (1, 10, None), (1, 10, "　 "), (-1, -1, "A")]
    attempts = spark.createDataFrame([(i, *a) for i, a in enumerate(said)], ATTEMPT)
    slow = K.grade(K.check_attempts(attempts, session, question, listed).where("reject_code is null").drop("reject_code"), question)
    fast = K.grade_accepted(attempts, session, question, listed)
    assert rows_of(fast) == rows_of(slow) and sorted(r.seq for r in fast.collect()) == [0, 1, 2, 3]


def test_records_fold_where_graded_attempts_lie(spark, sf_dir):
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = Tables(spark, sf_dir).record._jdf.queryExecution().executedPlan().toString()
    lines = [x.lstrip(" :+-*()0123456789") for x in plan.split("\n")]
    travels = [x for x in lines if x.startswith("Exchange hashpartitioning(")]
    assert len(travels) == 10  # the rows of attempts: to their session, their question, the question asked, the list
    assert sum(x.startswith("FileScan") and "/part.parquet" in x for x in lines) == 2


def test_a_batch_is_grouped_once(spark):
    graded = spark.createDataFrame([(3, 1, 10, "a", True), (5, 1, 10, "b", False)], "seq long, session_id long, question_id long, user_answer string, is_correct boolean").withColumn("ts", F.timestamp_seconds("seq"))
    out = A.fold_batch(graded)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert [(r.first_seq, r.last_seq, r.user_answer, r.is_correct) for r in out.collect()] == [(3, 5, "b", False)]


def test_bank_tables_are_graded_once(spark, sf_dir):
    tables = Q.bank_tables(Tables(spark, sf_dir))
    for name in ("practice_record", "wrong_question"):
        assert "lineitem" not in tables[name]._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, [x.lstrip(" :+-*()0123456789") for x in plan.split("\n")]


def test_a_table_is_checked_with_the_codes_of_a_batch(spark, sf_dir):
    session = spark.createDataFrame([(1,), (2,), (3,)], "session_id long")
    question = spark.createDataFrame([(10,), (11,), (12,)], "id long")
    listed = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (9, 10), (3, 99), (3, None)], "session_id long, question_id long")
    said = [(s, q, a) for s in (1, 2, 3, 9, -1, None) for q in (10, 11, 12, 99, -1, None) for a in ("A", " ", None)]
    attempts = spark.createDataFrame([(i, *a) for i, a in enumerate(said)], ATTEMPT)
    assert rows_of(K.check_table(attempts, session, question, listed)) == rows_of(K.check_attempts(attempts, session, question, listed))
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan, lines = plan_of(Tables(spark, sf_dir).checked)
    # those that are not found read the attempts where they lie, and no line travels with its prices
    assert sum(x.startswith("ReusedExchange [seq") for x in lines) == 1 and "l_extendedprice" not in plan


def test_attempts_meet_their_question_once_to_be_graded(spark, sf_dir):
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        _, lines = plan_of(Tables(spark, sf_dir).graded)
    assert sum(x.startswith("Exchange hashpartitioning(question_id#") for x in lines) == 2  # the attempts and the questions


def test_attempts_that_have_their_question_are_graded_without_it(spark):
    attempts = spark.createDataFrame([(1, 1, 10, "a", 5, "SINGLE", "A"), (2, 1, 99, "a", None, None, None)], f"{ATTEMPT}, bank_id long, type string, standard_answer string")
    assert [(r.seq, r.is_correct) for r in K.grade(attempts).collect()] == [(1, True)]


def test_attempts_that_lie_by_session_are_the_same_and_do_not_travel_again(spark, sf_dir):
    session = spark.createDataFrame([(1,), (2,), (3,), (7,)], "session_id long")
    question = spark.createDataFrame([(10, 5, "SINGLE", "A"), (11, 5, "ESSAY", "x"), (12, 5, "TRUE_FALSE", "B")], "id long, bank_id long, type string, answer string")
    listed = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (4, 10), (7, 12), (-1, 10), (3, 99), (3, None), (None, 10)], "session_id long, question_id long")
    said = [(s, q, a) for s in (1, 2, 3, 4, 7, 9, -1, None) for q in (10, 11, 12, 99, -1, None) for a in ("a", "B", " ", None)]
    attempts = spark.createDataFrame([(i, *a) for i, a in enumerate(said)], ATTEMPT)
    by_pair, by_session = (K.grade_accepted(attempts, session, question, listed, by_session=x) for x in (False, True))
    assert by_session.columns == by_pair.columns and rows_of(by_session) == rows_of(by_pair) and by_pair.count() == 8
    assert K.grade_accepted(attempts, session.where("false"), question, listed, by_session=True).count() == 0
    t = Tables(spark, sf_dir)
    assert rows_of(t.record_by_session) == rows_of(t.record)
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan, lines = plan_of(Q.QUERIES["k09_completion"](spark, sf_dir))
    # the attempts and the sessions; neither the list nor the records, and no answers where only counts are asked for
    assert sum(x.startswith("Exchange hashpartitioning(session_id#") for x in lines) == 2
    assert "max_by(struct(is_correct" in plan and "max_by(struct(user_answer" not in plan


@pytest.mark.parametrize("name", ["k08_session_counts", "r16_study_stats", "k14_wrong_items"])
def test_lists_and_records_do_not_travel_where_a_query_goes_on_by_session(spark, sf_dir, name):
    with I.settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        _, lines = plan_of(Q.QUERIES[name](spark, sf_dir))
    # of rows made on the way only the attempts are dealt out by session
    assert sum(x.startswith("Exchange hashpartitioning(session_id#") and "REPARTITION_BY_COL" in x for x in lines) == 1
    assert not any("hashpartitioning(session_id#" in x and "question_id#" in x.split("),")[0] for x in lines if x.startswith("Exchange"))
