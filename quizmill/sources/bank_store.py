"""The tables of question banks in folders by bank, so that deleting banks drops folders and rewrites nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.operators.bank import delete_chapters

#: What hangs on a bank, by its own column or by its session's bank.
BY_BANK = ("chapter", "question", "practice_session", "wrong_question", "knowledge_summary")
BY_SESSION = ("practice_session_question", "practice_record")
HOME = "_bank"


class BankStore:
    """``bank`` as one small table, all that hangs on banks in folders ``_bank=<id>`` below ``base``.

    Rows of sessions that are not known go to the folder of no bank.  Deleting a bank drops its folders, without reading them;
    deleting chapters reads and rewrites the folders of their own banks (dynamic partition overwrite).  Both can be run
    again after a failure: what is gone is gone, and the row in ``bank`` goes last.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, tables: dict[str, DataFrame]) -> None:
        """Write all tables; sessions come with ``session_id`` and ``bank_id``."""
        tables["bank"].write.mode("overwrite").parquet(f"{self.base}/bank")
        for name in BY_BANK:
            if name in tables:
                self._put(tables[name].withColumn(HOME, F.col("bank_id")), name)
        for name in BY_SESSION:
            if name in tables:
                home = self.read("practice_session").select("session_id", F.col("bank_id").alias(HOME))  # as they were written
                self._put(tables[name].join(home, "session_id", "left"), name)

    def _put(self, df: DataFrame, name: str) -> None:
        # folders of large banks are written by several tasks
        rows = df.repartition(F.col(HOME), F.pmod(F.xxhash64(*[c for c in df.columns if c.endswith("id")]), F.lit(8)))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(HOME).parquet(f"{self.base}/{name}")

    def names(self) -> list[str]:
        return [n for n in ("bank", *BY_BANK, *BY_SESSION) if self._fs.exists(self._path(f"{self.base}/{n}"))]

    def read(self, name: str, banks: list[int] | None = None) -> DataFrame:
        """A table, or the part of it in the folders of ``banks``."""
        df = self.spark.read.parquet(f"{self.base}/{name}")
        if HOME in df.columns:
            df = (df if banks is None else df.where(F.col(HOME).isin(banks))).drop(HOME)
        return df

    def delete_banks(self, ids: list[int]) -> None:
        """Drop banks, a stated list, and all that hangs on them."""
        for name in self.names():
            if name != "bank":
                for i in ids:
                    self._fs.delete(self._path(f"{self.base}/{name}/{HOME}={i}"), True)
        if ids:
            new = f"{self.base}/bank-new"
            self.read("bank").where(~F.col("id").isin(ids)).write.mode("overwrite").parquet(new)
            self._fs.delete(self._path(f"{self.base}/bank"), True)
            self._fs.rename(self._path(new), self._path(f"{self.base}/bank"))

    def delete_chapters(self, ids: list[int]) -> None:
        """Drop chapters, a stated list, with their questions; sessions stay, without the chapter."""
        gone = self.read("chapter").where(F.col("id").isin(ids)).select("id", "bank_id")
        banks = sorted(r[0] for r in gone.select("bank_id").distinct().collect())  # as many as chapters are stated
        names = [n for n in self.names() if n not in ("bank", "knowledge_summary")]
        left = delete_chapters({n: self.spark.read.parquet(f"{self.base}/{n}").where(F.col(HOME).isin(banks)) for n in names}, self.spark.createDataFrame([(i,) for i in ids], "id long"))
        # what is left of a bank is worked out before any of its folders changes
        for name in names:
            left[name].write.mode("overwrite").parquet(f"{self.base}/left/{name}")
        for name in reversed(names):  # chapters and questions last: a second run still sees what is gone
            kept = self.spark.read.schema(left[name].schema).parquet(f"{self.base}/left/{name}")
            full = {r[0] for r in kept.select(HOME).distinct().collect()}
            self._put(kept, name)
            for i in set(banks) - full:
                self._fs.delete(self._path(f"{self.base}/{name}/{HOME}={i}"), True)
        self._fs.delete(self._path(f"{self.base}/left"), True)
