"""Reports' counts kept up to date: signed counts of a batch's changed rows are added to those of their banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.functions import text as T
from quizmill.streaming.store import KeyedTable

COUNTS = "bank_id long, kind string, name string, n long"


def signed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that went (sign -1) and rows that came (1); a changed row is both."""
    return old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))


def question_counts(changed: DataFrame) -> DataFrame:
    """Counts by type and by chapter of signed questions (bank_id, chapter_id, type, sign)."""
    kinds = F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("name")), F.struct(F.lit("questions").alias("kind"), F.col("chapter_id").cast("string").alias("name")))
    return changed.select("bank_id", "sign", F.explode(kinds).alias("k")).groupBy("bank_id", "k.kind", "k.name").agg(F.sum("sign").alias("n"))


def chapter_counts(changed: DataFrame) -> DataFrame:
    """Counts of signed chapters (bank_id, sign)."""
    return changed.groupBy("bank_id").agg(F.sum("sign").alias("n")).select("bank_id", F.lit("chapters").alias("kind"), F.lit("").alias("name"), "n")


def wrong_counts(changed: DataFrame) -> DataFrame:
    """Counts by type and by chapter of signed wrong-book rows (bank_id, chapter_id, type, resolved, sign), open ones only."""
    kinds = F.array(F.struct(F.lit("wrong_type").alias("kind"), F.col("type").alias("name")), F.struct(F.lit("wrong_chapter").alias("kind"), F.col("chapter_id").cast("string").alias("name")))
    return changed.where("resolved = 0").select("bank_id", "sign", F.explode(kinds).alias("k")).groupBy("bank_id", "k.kind", "k.name").agg(F.sum("sign").alias("n"))


class CountStore(KeyedTable):
    """R1-R5 and R13-R15 as numbers by bank, kind and name, in folders by a hash of the bank.

    A batch adds its own signed counts and rewrites the folders of its banks; counts that come to zero go.  Counts are whole
    numbers, so the order of batches does not matter; each batch is counted once, however often it is run.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        super().__init__(spark, path, COUNTS, ["bank_id", "kind", "name"], ["bank_id"], buckets)

    def add(self, counts: list[DataFrame], batch: int) -> None:
        changes = counts[0]
        for c in counts[1:]:
            changes = changes.unionByName(c)
        self.upsert(_sums(changes), batch, _added)

    def _of(self, kind: str) -> DataFrame:
        return self.rows().where(F.col("kind") == kind)

    def by_bank_type(self, banks: DataFrame) -> DataFrame:
        """R1."""
        return self._of("type").join(banks.select(F.col("id").alias("bank_id")), "bank_id", "left_semi").select("bank_id", F.col("name").alias("type"), F.col("n").alias("cnt"))

    def chapters_with_counts(self, chapter: DataFrame) -> DataFrame:
        """R3."""
        n = self._of("questions").select(F.col("name").cast("long").alias("chapter_id"), "n")
        return chapter.withColumnRenamed("id", "chapter_id").join(n, "chapter_id", "left").select("bank_id", "chapter_id", "name", "sort", F.coalesce("n", F.lit(0)).alias("question_count"))

    def bank_counts(self, bank: DataFrame) -> DataFrame:
        """The numbers of R4 and R5."""
        kinds = [F.sum(F.when((F.col("kind") == "type") & (F.col("name") == t), F.col("n"))).alias(t.lower()) for t in T.TYPE_LABELS]
        total = F.sum(F.when(F.col("kind") == "type", F.col("n"))).alias("total")
        rest = [F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(a) for k, a in (("chapters", "chapters"), ("wrong_type", "open_wrong"))]
        numbers = self.rows().groupBy("bank_id").agg(*kinds, total, *rest)
        names = [c for c in numbers.columns if c != "bank_id"]
        out = bank.withColumnRenamed("id", "bank_id").join(numbers, "bank_id", "left")
        return out.select("bank_id", "name", "file_name", "created_at", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])

    def wrong_by_type(self) -> DataFrame:
        """R13, without the bank's total and the place."""
        return self._of("wrong_type").select("bank_id", F.col("name").alias("type"), F.col("n").alias("cnt"))


def _sums(counts: DataFrame) -> DataFrame:
    """One row a key (a null name is a name of its own), without zeros."""
    return counts.groupBy("bank_id", "kind", "name").agg(F.sum("n").alias("n")).where("n <> 0")


def _added(both: DataFrame) -> DataFrame:
    """Counts of which there is an ``old`` and a ``new`` one, or one of them, added up."""
    n = F.coalesce("old.n", F.lit(0)) + F.coalesce("new.n", F.lit(0))
    return both.select("bank_id", "kind", "name", n.alias("n")).where("n <> 0")
