"""Attempts as a stream: checked and graded as they come, folded into records, progress and the wrong book.

Order is the attempts' ``seq``: an older attempt never overwrites a newer one.  Nothing is dropped for being late; the
keys are bounded by the sessions' questions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.operators import practice as K
from quizmill.schemas import schema
from quizmill.streaming.store import BUCKET, KeyedTable

RECORDS = "session_id long, question_id long, user_answer string, is_correct boolean, created_at timestamp, updated_at timestamp, first_seq long, last_seq long"


def read_attempts(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Attempt files, also those of folders inside, as a stream, with the declared columns."""
    return spark.readStream.schema(schema("attempt")).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", True).parquet(path)


def graded_stream(attempts: DataFrame, session: DataFrame, question: DataFrame, listed: DataFrame) -> DataFrame:
    """Accepted attempts with their grades; stream-static joins, no state."""
    return K.grade(K.check_attempts(attempts, session, question, listed).where("reject_code is null").drop("reject_code"), question)


def fold_batch(graded: DataFrame) -> DataFrame:
    """Records of one batch, with the order of their first and last attempts; the batch is graded and grouped once."""
    return K.fold_records(graded, last_seq=True)


def merge_records(both: DataFrame) -> DataFrame:
    """Records of which there is an ``old`` and a ``new`` one, or one of them: the first and the last attempts of both."""
    first = F.when(F.col("old.first_seq").isNull() | (F.col("new.first_seq") < F.col("old.first_seq")), F.col("new")).otherwise(F.col("old"))
    last = F.when(F.col("old.last_seq").isNull() | (F.col("new.last_seq") >= F.col("old.last_seq")), F.col("new")).otherwise(F.col("old"))
    met = both.select("session_id", "question_id", first.alias("f"), last.alias("l"))
    return met.select("session_id", "question_id", "l.user_answer", "l.is_correct", "f.created_at", "l.updated_at", "f.first_seq", "l.last_seq")


class RecordStore(KeyedTable):
    """The records, in folders by a hash of the session; a batch reads and rewrites those of its own sessions only."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, RECORDS, ["session_id", "question_id"], ["session_id"], buckets)

    def records(self) -> DataFrame:
        return self.rows()

    def write_batch(self, graded: DataFrame, batch: int) -> None:
        self.upsert(fold_batch(graded), batch, merge_records)


def _kept(stream: DataFrame, write: Callable[[DataFrame, int], None], grade: Callable[[DataFrame], DataFrame] | None, checkpoint: str):
    """A query that writes a stream of graded attempts, or of attempts that ``grade`` grades batch by batch.

    A batch's plan begins with the rows that its stream brings, and how they lie is not known; what is graded inside the
    batch is folded and written where it lies.
    """
    return stream.writeStream.foreachBatch(lambda df, i: write(grade(df) if grade else df, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def record_stream(stream: DataFrame, store: RecordStore, checkpoint: str, grade: Callable[[DataFrame], DataFrame] | None = None):
    """A query that keeps ``store`` up to date."""
    return _kept(stream, store.write_batch, grade, checkpoint)


PROGRESS = "session_id long, answered_count int, correct_count int, total_count int, completed_at timestamp, completed_in long"


class ProgressStore:
    """Records and the progress of their sessions, both in folders by a hash of the session.

    After a batch's attempts are in the records, the sessions that it touched, and no others, are counted anew from their
    records by the closed forms of K8 and K9.  ``completed_in`` is the batch in which a session was complete for the first
    time: its one completion event, which neither late attempts nor a batch that is run again can repeat.
    """

    def __init__(self, spark: SparkSession, path: str, session: DataFrame, buckets: int = 64):
        self.session = session
        self.records = RecordStore(spark, f"{path}/records", buckets)
        self.progress = KeyedTable(spark, f"{path}/progress", PROGRESS, ["session_id"], buckets=buckets)

    def write_batch(self, graded: DataFrame, batch: int) -> None:
        self.records.write_batch(graded, batch)
        touched = self.records.changes(batch).select("session_id").distinct()
        of = lambda df: df.join(touched, "session_id", "left_semi")
        now = K.complete_sessions(of(self.session), of(self.records.touched(touched).drop(BUCKET)))
        known = self.progress.touched(touched).select("session_id", F.col("completed_in").alias("_before"))
        now = now.join(known, "session_id", "left").withColumn("completed_in", F.coalesce("_before", F.when(F.col("status") == "COMPLETED", F.lit(batch).cast("long"))))
        self.progress.upsert(now, batch)

    def completions(self, batch: int | None = None) -> DataFrame:
        """(session_id, completed_at, completed_in): the completion events, of one batch or of all."""
        events = self.progress.rows().where("completed_in is not null" if batch is None else F.col("completed_in") == batch)
        return events.select("session_id", "completed_at", "completed_in")


def progress_stream(stream: DataFrame, store: ProgressStore, checkpoint: str, grade: Callable[[DataFrame], DataFrame] | None = None):
    """A query that keeps ``store`` up to date."""
    return _kept(stream, store.write_batch, grade, checkpoint)


WRONG = "bank_id long, question_id long, user_answer string, wrong_count long, resolved int, first_wrong_seq long"


def wrong_book_stream(graded: DataFrame) -> DataFrame:
    """T4: (update mode) the wrong book as a streaming aggregate; the closed form of the batch fold."""
    return K.fold_wrong_book(graded)
