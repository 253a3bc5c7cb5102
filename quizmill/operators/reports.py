"""Reports over banks, questions, sessions and the wrong book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.functions import text as T
from quizmill.operators.search import LOOSE


def _has(column: str, keyword: str):
    return F.contains(F.collate(F.col(column), LOOSE), F.collate(F.lit(keyword), LOOSE))


def count_by_bank_type(question: DataFrame, banks: DataFrame) -> DataFrame:
    """Questions per bank and type, for the banks given (column id)."""
    return question.join(banks.select(F.col("id").alias("bank_id")), "bank_id", "left_semi").groupBy("bank_id", "type").agg(F.count(F.lit(1)).alias("cnt"))


def count_chapters(chapter: DataFrame, banks: DataFrame) -> DataFrame:
    """R2: chapters per bank."""
    return chapter.join(banks.select(F.col("id").alias("bank_id")), "bank_id", "left_semi").groupBy("bank_id").agg(F.count(F.lit(1)).alias("cnt"))


def chapters_with_counts(chapter: DataFrame, question: DataFrame) -> DataFrame:
    """Chapters with their number of questions, 0 included."""
    n = question.groupBy("chapter_id").agg(F.count(F.lit(1)).alias("n"))
    return chapter.join(n, chapter.id == n.chapter_id, "left").select("bank_id", F.col("id").alias("chapter_id"), "name", "sort", F.coalesce("n", F.lit(0)).alias("question_count"))


def bank_counts(bank: DataFrame, question: DataFrame, chapter: DataFrame) -> DataFrame:
    """Banks with a column per type, the total (unknown types included) and the number of chapters."""
    types = question.groupBy("bank_id").agg(*[F.count_if(F.col("type") == t).alias(t.lower()) for t in T.TYPE_LABELS], F.count(F.lit(1)).alias("total"))
    chapters = chapter.groupBy("bank_id").agg(F.count(F.lit(1)).alias("chapters"))
    numbers = [*(t.lower() for t in T.TYPE_LABELS), "total", "chapters"]
    out = bank.withColumnRenamed("id", "bank_id").join(types, "bank_id", "left").join(chapters, "bank_id", "left")
    return out.select("bank_id", "name", "file_name", "created_at", *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers])


def banks_found(bank: DataFrame, keyword: str | None = None) -> DataFrame:
    """Banks with a keyword in the name or the file name; all without one."""
    k = (keyword or "").strip()
    return bank.where(_has("name", k) | _has("file_name", k)) if k else bank


def bank_page(bank: DataFrame, question: DataFrame, chapter: DataFrame, keyword: str | None = None, page: int = 1, size: int | None = None) -> DataFrame:
    """One page of banks, newest first, by a keyword in the name or the file name; ``matches`` is the total."""
    found = banks_found(bank, keyword)
    offset, size = T.page_bounds("banks", page, size)
    rows = found.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(size)
    total = found.agg(F.count(F.lit(1)).alias("matches"))
    return bank_counts(rows, question, chapter).join(F.broadcast(total))


def bank_detail(bank: DataFrame, question: DataFrame, chapter: DataFrame, wrong: DataFrame) -> DataFrame:
    """R4's fields with the chapters nested in order and the number of open wrong questions."""
    nested = chapters_with_counts(chapter, question).groupBy("bank_id").agg(F.array_sort(F.collect_list(F.struct("sort", "chapter_id", "name", "question_count"))).alias("chapter_list"))
    return bank_counts(bank, question, chapter).join(nested, "bank_id", "left").join(wrong_count(wrong), "bank_id", "left").withColumn("open_wrong", F.coalesce("open_wrong", F.lit(0)))


def questions_found(question: DataFrame, bank_id: int | None = None, chapter_id: int | None = None, kind: str | None = None, keyword: str | None = None) -> DataFrame:
    """Questions of a bank, chapter or type, with a keyword in the stem; what is not given does not matter."""
    found = question
    for name, value in (("bank_id", bank_id), ("chapter_id", chapter_id), ("type", kind)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found.where(_has("stem", keyword.strip())) if keyword and keyword.strip() else found


def with_chapter_name(rows: DataFrame, chapter: DataFrame) -> DataFrame:
    names = chapter.select(F.col("id").alias("chapter_id"), F.col("name").alias("chapter_name"))
    return rows.join(names, "chapter_id", "left").withColumn("chapter_name", F.coalesce("chapter_name", F.lit("")))


def question_page(question: DataFrame, chapter: DataFrame, bank_id: int | None = None, chapter_id: int | None = None, kind: str | None = None, keyword: str | None = None, page: int = 1, size: int | None = None) -> DataFrame:
    """One page of questions, newest first, with their chapter's name ('' if there is none)."""
    found = questions_found(question, bank_id, chapter_id, kind, keyword)
    offset, size = T.page_bounds("questions", page, size)
    total = found.agg(F.count(F.lit(1)).alias("matches"))
    rows = found.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(size)
    return with_chapter_name(rows, chapter).join(F.broadcast(total))


def list_banks(bank: DataFrame, question: DataFrame) -> DataFrame:
    """All banks with their number of questions, 0 included."""
    n = question.groupBy("bank_id").agg(F.count(F.lit(1)).alias("n"))
    return bank.join(n, bank.id == n.bank_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("question_count"))


def question_detail(question: DataFrame, bank: DataFrame, chapter: DataFrame) -> DataFrame:
    """The full text of questions, with defaults for what is missing."""
    b = bank.select(F.col("id").alias("bank_id"), F.col("name").alias("_bank"))
    c = chapter.select(F.col("id").alias("chapter_id"), F.col("name").alias("_chapter"))
    lines = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit("．"), o["text"])), "\n")
    points = F.when(F.coalesce(F.size("knowledge_points"), F.lit(0)) > 0, F.array_join("knowledge_points", "、")).otherwise("无")
    return question.join(b, "bank_id", "left").join(c, "chapter_id", "left").select(
        F.col("id").alias("question_id"), T.type_label(F.col("type")).alias("type_name"),
        F.when(F.col("_bank").isNull(), "未知").otherwise(F.concat(F.lit("《"), "_bank", F.lit("》"))).alias("bank_name"),
        F.coalesce("_chapter", F.lit("无")).alias("chapter_name"), "stem", F.coalesce(lines, F.lit("")).alias("option_lines"),
        T.blank_to(F.col("answer"), "（未提供）").alias("answer"), T.blank_to(F.col("analysis"), "（未提供）").alias("analysis"), points.alias("points"),
    )


def dashboard(bank: DataFrame, question: DataFrame) -> DataFrame:
    """How many banks there are, and questions in them."""
    return list_banks(bank, question).agg(F.count(F.lit(1)).alias("banks"), F.coalesce(F.sum("question_count"), F.lit(0)).alias("questions"))


def exam_countdown(exams: DataFrame, as_of) -> DataFrame:
    """Days left to each exam as of a date, and its level."""
    days = T.days_left(F.col("date"), F.lit(as_of).cast("date"))
    return exams.withColumn("days_left", days).withColumn("level", T.exam_level(F.col("days_left")))


def nearest_exam(exams: DataFrame, as_of) -> DataFrame:
    """The exam with the earliest date that is not over; the smallest id of equals."""
    ahead = exam_countdown(exams, as_of).where("days_left >= 0")
    return ahead.agg(F.min(F.struct("date", "id", "name", "days_left", "level")).alias("e")).where("e is not null").select("e.*")


def session_result(session: DataFrame, stats: DataFrame, wrong_items: DataFrame) -> DataFrame:
    """Counts and accuracy of sessions, with the statistics by type and the wrong items nested."""
    s = stats.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("type", "total", "correct"))).alias("type_stats"))
    w = wrong_items.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("place", "question_id", "user_answer", "standard_answer"))).alias("wrong_items"))
    out = session.select("session_id", "status", "total_count", "answered_count", "correct_count", T.accuracy(F.col("answered_count"), F.col("correct_count")).alias("accuracy"))
    return out.join(s, "session_id", "left").join(w, "session_id", "left")


def wrong_by_type(wrong: DataFrame, question: DataFrame) -> DataFrame:
    """Open wrong questions per bank and type, with the bank's total and the place of the type (most first)."""
    q = question.select(F.col("id").alias("question_id"), "type")
    n = wrong.where("resolved = 0").join(q, "question_id").groupBy("bank_id", "type").agg(F.count(F.lit(1)).alias("cnt"))
    per = W.Window.partitionBy("bank_id")
    return n.withColumn("total", F.sum("cnt").over(per)).withColumn("place", F.row_number().over(per.orderBy(F.desc("cnt"), "type")))


def wrong_by_chapter(wrong: DataFrame, question: DataFrame, chapter: DataFrame) -> DataFrame:
    """Open wrong questions per chapter."""
    q = question.select(F.col("id").alias("question_id"), "chapter_id")
    n = wrong.where("resolved = 0").join(q, "question_id").groupBy("chapter_id").agg(F.count(F.lit(1)).alias("cnt"))
    return n.join(chapter.select(F.col("id").alias("chapter_id"), "bank_id", "name", "sort"), "chapter_id")


def wrong_count(wrong: DataFrame) -> DataFrame:
    """Open wrong questions per bank."""
    return wrong.where("resolved = 0").groupBy("bank_id").agg(F.count(F.lit(1)).alias("open_wrong"))


def study_stats(session: DataFrame) -> DataFrame:
    """Practised, correct and accuracy per bank and over all (bank_id null, ``overall`` true)."""
    n = session.rollup("bank_id").agg(F.grouping("bank_id").cast("boolean").alias("overall"), F.sum("answered_count").alias("practiced"), F.sum("correct_count").alias("correct"))
    n = n.withColumn("practiced", F.coalesce("practiced", F.lit(0))).withColumn("correct", F.coalesce("correct", F.lit(0)))
    return n.withColumn("accuracy", T.accuracy(F.col("practiced"), F.col("correct")))


def recent_sessions(session: DataFrame, bank: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest sessions by id, with their bank's name."""
    _, size = T.page_bounds("recent", 1, limit)
    names = bank.select(F.col("id").alias("bank_id"), F.col("name").alias("bank_name"))
    return session.join(names, "bank_id").orderBy(F.desc("session_id")).limit(size)
