"""From raw documents to token ids: five stages, each written to shared storage and read again.

Every function takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizmill.llm.common import collected, drop_saved, fold, save, table
from quizmill.llm.decontaminate import decontaminate
from quizmill.llm.exact_dedup import drop_exact_duplicates
from quizmill.llm.langid import UNDETERMINED, predict_languages, train_languages
from quizmill.llm.pieces import default_model, encode_pieces
from quizmill.llm.simhash import drop_near_duplicates

#: A document whose predicted language has less than this share of the likelihood is rejected.
LEAST_SCORE = 0.5

#: What the last stage wrote on the way.
_left: list[DataFrame] = []


def _drop_left(docs: DataFrame | None = None) -> None:
    """Delete what the last stage wrote on the way, but for files that ``docs`` still reads."""
    used = set(docs.inputFiles()) if docs is not None and _left else set()
    still = [df for df in _left if used & set(df.inputFiles())]
    for df in _left:
        if not any(df is x for x in still):
            drop_saved(df)
    _left[:] = still


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage begins when the result of the one before has been written, so what that one wrote on the way can go."""

    @wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop_left(docs)
        with collected() as saved:
            out = f(spark, docs, sf_dir)
        _left.extend(saved)
        return out

    return stage


@_stage
def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: text with a letter, and one language clearly likelier than the rest."""
    model = train_languages(docs.where(fold("doc_id", 4) != 2), default_model())
    told = predict_languages(docs.select(F.struct(*docs.columns).alias("row"), "text"), model)
    return told.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@_stage
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id."""
    return drop_exact_duplicates(docs)


@_stage
def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, Jaccard similarity 0.8 or more): the one with the
    smallest doc_id."""
    return drop_near_duplicates(docs)


@_stage
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (end id last), the source byte at which each piece ends, and the text that the ids decode to."""
    return encode_pieces(docs, default_model(), decode=True).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language_id", keep_identified),
    ("exact_dedup", keep_distinct),
    ("simhash_near_dedup", keep_unlike),
    ("decontamination", keep_uncontaminated),
    ("sentencepiece", encode),
]

#: SQL cannot express the language model, the components or the tokenizer; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name, keep=True)
        _drop_left()
        if last is not None:
            drop_saved(last)
        last = docs
    return docs
