"""Practice: drawing sessions, checking and grading attempts, and folding them into records, progress and a wrong book.

Attempts carry ``seq``, their order of arrival; folds are closed forms over it, so they combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T

MODES, TYPES = ("SEQUENTIAL", "RANDOM"), ("ALL", *T.TYPE_LABELS)


def validate_session_requests(requests: DataFrame, bank: DataFrame) -> DataFrame:
    """K1: ``reject_code`` 40010 (no bank, mode or type that counts) or 40401 (no such bank), else null."""
    known = bank.select(F.col("id").alias("bank_id"), F.lit(True).alias("_known"))
    bad = F.col("bank_id").isNull() | ~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)) | ~F.coalesce(F.col("question_type").isin(*TYPES), F.lit(False))
    code = F.when(bad, 40010).when(F.col("_known").isNull(), 40401)
    return requests.join(known, "bank_id", "left").withColumn("reject_code", code).drop("_known")


def _order(mode: Column, seed: int, by: str) -> list[Column]:
    """The drawing order: ``by``, or a seeded shuffle that can be repeated."""
    mixed = F.md5(F.concat_ws(":", F.lit(seed), F.col("session_id"), F.col("question_id")))
    return [F.when(mode == "RANDOM", mixed), F.col(by)]


def draw_questions(requests: DataFrame, question: DataFrame, seed: int = 0) -> DataFrame:
    """K2: (session_id, question_id, sort) for requests (session_id, bank_id, mode, question_type, chapter_id)."""
    q = question.select("bank_id", F.col("id").alias("question_id"), "type", F.col("chapter_id").alias("_chapter"))
    drawn = requests.join(q, "bank_id").where(((F.col("question_type") == "ALL") | (F.col("question_type") == F.col("type"))) & (F.col("chapter_id").isNull() | (F.col("chapter_id") == F.col("_chapter"))))
    w = W.Window.partitionBy("session_id").orderBy(*_order(F.col("mode"), seed, "question_id"))
    return drawn.select("session_id", "question_id", F.row_number().over(w).alias("sort"))


def count_drawable(requests: DataFrame, question: DataFrame) -> DataFrame:
    """K4: (session_id, total_count) of requests that can draw a question, without drawing any.

    Questions are counted once for each bank, type and chapter, and these counts are added up for "ALL" types and for any
    chapter; a request then meets one count, however many questions its bank has.
    """
    counts = question.groupBy("bank_id", "type", "chapter_id").agg(F.count(F.lit(1)).alias("n"))
    chapters = F.array(F.struct(F.lit(True).alias("any"), F.lit(0).cast("long").alias("chapter")), F.struct(F.lit(False).alias("any"), F.col("chapter_id").cast("long").alias("chapter")))
    sums = counts.withColumn("question_type", F.explode(F.array_distinct(F.array("type", F.lit("ALL"))))).withColumn("_c", F.explode(chapters))
    sums = sums.groupBy("bank_id", "question_type", F.col("_c.any").alias("_any"), F.col("_c.chapter").alias("_chapter")).agg(F.sum("n").cast("int").alias("total_count"))
    asked = requests.select("session_id", "bank_id", "question_type", F.col("chapter_id").isNull().alias("_any"), F.coalesce("chapter_id", F.lit(0)).cast("long").alias("_chapter"))
    return asked.join(sums, ["bank_id", "question_type", "_any", "_chapter"]).select("session_id", "total_count")


def draw_wrong_questions(requests: DataFrame, wrong: DataFrame, seed: int = 0) -> DataFrame:
    """K3: open wrong questions of the bank, shuffled unless the mode is SEQUENTIAL (wrong-book order)."""
    open_ones = wrong.where("resolved = 0").select("bank_id", "question_id", F.col("id").alias("_wrong"))
    w = W.Window.partitionBy("session_id").orderBy(*_order(F.coalesce("mode", F.lit("RANDOM")), seed, "_wrong"))
    return requests.join(open_ones, "bank_id").select("session_id", "question_id", F.row_number().over(w).alias("sort"))


def build_sessions(requests: DataFrame, drawn: DataFrame, source: str = "NORMAL") -> DataFrame:
    """K4: new session rows; ``reject_code`` 40011 (or 40012 for wrong-book sessions) where nothing was drawn.

    ``drawn`` holds the questions drawn, or their number by session (``count_drawable``).
    """
    wrong = source == "WRONG"
    counts = drawn if "total_count" in drawn.columns else drawn.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("total_count"))
    return requests.join(counts, "session_id", "left").select(
        "session_id", "bank_id", F.coalesce("mode", F.lit("RANDOM")).alias("mode"),
        (F.lit("ALL") if wrong else F.col("question_type")).alias("question_type"),
        (F.lit(None).cast("long") if wrong else F.col("chapter_id")).alias("chapter_id"),
        F.lit("IN_PROGRESS").alias("status"), F.coalesce("total_count", F.lit(0)).alias("total_count"),
        F.lit(0).alias("answered_count"), F.lit(0).alias("correct_count"), F.lit(source).alias("session_source"),
        F.when(F.col("total_count").isNull(), 40012 if wrong else 40011).alias("reject_code"),
    )


def _no_attempt() -> Column:
    return T.is_blank(F.col("user_answer")) | F.col("session_id").isNull() | F.col("question_id").isNull()


def _unknown(attempts: DataFrame, session: DataFrame, question: DataFrame) -> tuple[DataFrame, Column]:
    """Attempts with what is known of their session and question, and the code if one is not."""
    s = session.select("session_id", F.lit(True).alias("_s"))
    q = question.select(F.col("id").alias("question_id"), F.lit(True).alias("_q"))
    return attempts.join(s, "session_id", "left").join(q, "question_id", "left"), F.when(F.col("_s").isNull(), 40402).when(F.col("_q").isNull(), 40403)


def check_attempts(attempts: DataFrame, session: DataFrame, question: DataFrame, listed: DataFrame) -> DataFrame:
    """K5: ``reject_code`` of each attempt: blank 40010, session 40402, question 40403, not in the session 40013.

    Attempts go to the tables, one after the other, and the tables stay where they are: for batches, and tables in buckets.
    """
    pairs = listed.select("session_id", "question_id", F.lit(True).alias("_l"))
    joined, unknown = _unknown(attempts.join(pairs, ["session_id", "question_id"], "left"), session, question)
    code = F.when(_no_attempt(), 40010).otherwise(F.coalesce(unknown, F.when(F.col("_l").isNull(), 40013)))
    return joined.select(*attempts.columns, code.alias("reject_code"))


def check_table(attempts: DataFrame, session: DataFrame, question: DataFrame, listed: DataFrame) -> DataFrame:
    """K5 for a whole table of attempts, with keys that are unique: the codes of ``check_attempts``.

    The list meets sessions and questions first, so attempts travel once, to their session and question; only those that are
    not found there go on to the sessions and to the questions for their code.
    """
    known = listed.select("session_id", "question_id").join(session.select("session_id"), "session_id").join(question.select(F.col("id").alias("question_id")), "question_id")
    met = attempts.join(known.withColumn("_l", F.lit(True)), ["session_id", "question_id"], "left")
    # a sum, so that no part of it moves below the join: both halves then read the same exchanges
    settled = _no_attempt().cast("int") + F.col("_l").isNotNull().cast("int")
    rest, unknown = _unknown(met.where(settled == 0).select(*attempts.columns), session, question)
    rest = rest.select(*attempts.columns, F.coalesce(unknown, F.lit(40013)).alias("reject_code"))
    return met.where(settled > 0).select(*attempts.columns, F.when(_no_attempt(), 40010).alias("reject_code")).unionByName(rest)


def grade(attempts: DataFrame, question: DataFrame | None = None) -> DataFrame:
    """K6: attempts with the question's bank, type and answer, and ``is_correct`` (null: not graded).

    Without ``question`` the attempts must have ``bank_id`` (null: no such question), ``type`` and ``standard_answer``.
    """
    if question is None:
        met = attempts.where("bank_id is not null")
    else:
        met = attempts.join(question.select(F.col("id").alias("question_id"), "bank_id", "type", F.col("answer").alias("standard_answer")), "question_id")
    return met.withColumn("is_correct", T.judge(F.col("type"), F.col("standard_answer"), F.col("user_answer")))


def grade_accepted(attempts: DataFrame, session: DataFrame, question: DataFrame | None, listed: DataFrame, by_session: bool = False) -> DataFrame:
    """K5 and K6 at once: the attempts without a ``reject_code``, graded; ``question`` as for ``grade``.

    Attempts meet their questions once, and then what is listed of sessions that there are, so they travel twice (once, if
    they have their questions) and lie by session and question afterwards, as records are folded. With ``by_session`` they
    lie by session, for what goes on by session: a list that lies so does not travel, nor do the records.
    """
    graded = grade(attempts.where(~T.is_blank(F.col("user_answer"))), question)
    pairs = listed.select("session_id", "question_id").join(session.select("session_id"), "session_id")
    if not by_session:
        return graded.join(pairs, ["session_id", "question_id"]).select(*graded.columns)
    asked = _in_range(graded.where("question_id is not null"), session, "session_id").select(*graded.columns, F.lit(False).alias("_l"))
    # a join on both columns would deal its sides anew by both, so attempts look for their pair among the rows beside them
    both = asked.repartition("session_id").unionByName(pairs.withColumn("_l", F.lit(True)).repartition("session_id"), allowMissingColumns=True)
    met = both.withColumn("_met", F.max("_l").over(W.Window.partitionBy("session_id", "question_id")))
    return met.where("_met and not _l").select(*graded.columns)


def _in_range(attempts: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Attempts that ``known`` may have: an id that stands for nothing (-1) repeats, and all its attempts would go to one task."""
    ids = known.agg(F.min(column).alias("_least"), F.max(column).alias("_most"))
    return attempts.join(F.broadcast(ids), F.col(column).between(F.col("_least"), F.col("_most"))).select(*attempts.columns)


def grade_batch(attempts: DataFrame, session: DataFrame, question: DataFrame, listed: DataFrame) -> DataFrame:
    """K5 and K6 at once for a batch, and tables in buckets (sessions and lists by session, in as many as shuffles have partitions).

    Attempts go to their questions and then to their sessions; the tables stay where they are, with ``CO_PARTITIONED``. What
    is folded by session then, as records are, does not travel again.
    """
    said = _in_range(attempts.where(~T.is_blank(F.col("user_answer"))), session, "session_id")
    graded = grade(_in_range(said, question.select(F.col("id").alias("question_id")), "question_id"), question)
    pairs = listed.select("session_id", "question_id").join(session.select("session_id"), "session_id")
    return graded.repartition("session_id").join(pairs, ["session_id", "question_id"]).select(*graded.columns)


def fold_records(graded: DataFrame, of_question: tuple[str, ...] = (), last_seq: bool = False) -> DataFrame:
    """K7: one record per session and question; the last attempt wins, ``first_seq`` is its place.

    ``of_question`` names columns of the question to keep beside it, for reports that then need no join; ``last_seq`` asks for
    the place of the last attempt too. Each column is folded by itself, so what is not asked for does not travel.
    """
    # structs, so that attempts are folded in the order in which they lie and not in a map of all pairs
    last = [F.max_by(F.struct(c), "seq").alias(f"_{c}") for c in ("user_answer", "is_correct")]
    kept = [F.any_value(c).alias(c) for c in of_question] + ([F.max("seq").alias("last_seq")] if last_seq else [])
    return graded.groupBy("session_id", "question_id").agg(*last, F.min_by("ts", "seq").alias("created_at"), F.max_by("ts", "seq").alias("updated_at"), F.min("seq").alias("first_seq"), *kept).select(
        "session_id", "question_id", "_user_answer.user_answer", "_is_correct.is_correct", "created_at", "updated_at", "first_seq", *of_question, *(["last_seq"] if last_seq else [])
    )


def _counted(session: DataFrame, record: DataFrame) -> DataFrame:
    n = record.groupBy("session_id").agg(F.count(F.lit(1)).cast("int").alias("_a"), F.count_if("is_correct").cast("int").alias("_c"), F.max_by("created_at", "first_seq").alias("_last_new"))
    return session.drop("answered_count", "correct_count").join(n, "session_id", "left").withColumn("answered_count", F.coalesce("_a", F.lit(0))).withColumn("correct_count", F.coalesce("_c", F.lit(0))).drop("_a", "_c")


def refresh_counts(session: DataFrame, record: DataFrame) -> DataFrame:
    """K8: answered and correct counts recomputed from the records; 0 where there are none."""
    return _counted(session, record).drop("_last_new")


def complete_sessions(session: DataFrame, record: DataFrame) -> DataFrame:
    """K9: counts, status and completion time: that of the first attempt on the last question newly answered."""
    done = (F.col("answered_count") >= F.col("total_count")) & (F.col("answered_count") > 0)
    counted = _counted(session.drop("status", "completed_at"), record)
    return counted.withColumn("status", F.when(done, "COMPLETED").otherwise("IN_PROGRESS")).withColumn("completed_at", F.when(done, F.col("_last_new"))).drop("_last_new")


def fold_wrong_book(graded: DataFrame) -> DataFrame:
    """Questions ever answered wrongly, per bank; ungraded attempts do not count."""
    wrong = ~F.col("is_correct")
    return (
        graded.where("is_correct is not null")
        .groupBy("bank_id", "question_id")
        .agg(
            F.max_by(F.when(wrong, F.col("user_answer")), F.when(wrong, F.col("seq"))).alias("user_answer"),
            F.count_if(wrong).alias("wrong_count"),
            F.max_by(F.col("is_correct").cast("int"), "seq").alias("resolved"),
            F.min(F.when(wrong, F.col("seq"))).alias("first_wrong_seq"),
        )
        .where("wrong_count > 0")
    )


def session_detail(session: DataFrame, listed: DataFrame, question: DataFrame, chapter: DataFrame, record: DataFrame) -> DataFrame:
    """Session header with its questions in order (no answer, no analysis) and its records in order."""
    q = question.select(F.col("id").alias("question_id"), "type", "stem", "options", "chapter_id")
    c = chapter.select(F.col("id").alias("chapter_id"), F.col("name").alias("chapter_name"))
    items = listed.join(q, "question_id").join(c, "chapter_id", "left").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("sort", "question_id", "type", "stem", "options", "chapter_name"))).alias("questions"))
    records = record.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "question_id", "user_answer", "is_correct"))).alias("records"))
    return session.join(items, "session_id", "left").join(records, "session_id", "left")


def submit_results(graded: DataFrame, session: DataFrame) -> DataFrame:
    """For each attempt the counts and status of its session just after it."""
    by_pair = W.Window.partitionBy("session_id", "question_id").orderBy("seq")
    so_far = W.Window.partitionBy("session_id").orderBy("seq").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    now = F.coalesce("is_correct", F.lit(False)).cast("int")
    steps = graded.withColumn("_new", (F.row_number().over(by_pair) == 1).cast("int")).withColumn("_change", now - F.coalesce(F.lag(now).over(by_pair), F.lit(0)))
    steps = steps.withColumn("answered_count", F.sum("_new").over(so_far)).withColumn("correct_count", F.sum("_change").over(so_far))
    totals = session.select("session_id", "total_count")
    return steps.drop("_new", "_change").join(totals, "session_id").withColumn("status", F.when(F.col("answered_count") >= F.col("total_count"), "COMPLETED").otherwise("IN_PROGRESS"))


def type_stats(listed: DataFrame, question: DataFrame, record: DataFrame) -> DataFrame:
    """Per session and type the listed questions, and how many of them are correct.

    A list that has its questions' ``type`` needs no join with them; list and records in buckets by session, no exchange.
    """
    q = question.select(F.col("id").alias("question_id"), "type")
    r = record.select("session_id", "question_id", "is_correct")
    typed = listed if "type" in listed.columns else listed.join(q, "question_id")
    return typed.join(r, ["session_id", "question_id"], "left").groupBy("session_id", "type").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("is_correct", F.lit(False))).alias("correct"))


def session_wrong_items(record: DataFrame, question: DataFrame | None = None) -> DataFrame:
    """The wrong records of sessions with their questions, ``place`` in the order of first attempts.

    Without ``question`` the records must have ``standard_answer``, and stem, type and analysis are left out.
    """
    w = W.Window.partitionBy("session_id").orderBy("first_seq")
    wrong = record.where("not is_correct").withColumn("place", F.row_number().over(w))
    if question is None:
        return wrong.select("session_id", "place", "question_id", "user_answer", "standard_answer")
    q = question.select(F.col("id").alias("question_id"), "type", "stem", F.col("answer").alias("standard_answer"), "analysis")
    return wrong.select("session_id", "place", "question_id", "user_answer").join(q, "question_id")
