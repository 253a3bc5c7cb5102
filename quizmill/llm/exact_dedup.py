"""Exact duplicates: group by a 128-bit content hash, then by the bytes themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, save, table


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and the SHA-256 of the folded text.

    Texts are equal when their bytes are, after lower-casing A-Z.  Grouping is on the MD5 *and* the text, so two texts
    that share a hash stay apart.  Spark combines equal texts inside each input partition before the shuffle, so a group
    that holds a third of all rows sends one text per partition.  The way back to the rows carries hashes only, and only
    groups of two or more; a hot group is split by the adaptive skew join.

    ``keep`` names the row that stays: "min" (smallest stable id) or "max".  Null text counts as empty; rows with a null
    id never stay while another row of the group has one; of repeated rows with the kept id every one is marked kept.
    An empty table gives an empty result; other columns are ignored.
    """
    best = F.max if keep == "max" else F.min
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_norm"))
    rows = rows.withColumn("_md5", F.unhex(F.md5("_norm")))
    groups = (
        rows.groupBy("_md5", "_norm")
        .agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        .select("_md5", F.sha2("_norm", 256).alias("_sha"), "_keep", "_size")
    )
    keyed = rows.select("_id", "_md5", F.sha2("_norm", 256).alias("_sha"))
    keep_id = F.coalesce(F.col("_keep"), F.col("_id"))
    return keyed.join(groups, ["_md5", "_sha"], "left").select(
        F.col("_id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1)).cast("long").alias("group_size"),
        keep_id.eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of each group.

    The row with the largest doc_id stays, one with a null doc_id only where the group has no other; of repeated rows the
    one numbered first.  Rows are told apart by their own number, so neither null nor repeated ids matter.
    """
    uid = free_name(docs, "_uid")
    held = save(docs.withColumn(uid, F.monotonically_increasing_id()), "exact-rows")
    rows = held.select(F.col(uid).alias("_uid"), "doc_id", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_norm"))
    rows = rows.withColumn("_md5", F.unhex(F.md5("_norm")))
    groups = rows.groupBy("_md5", "_norm").agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    groups = groups.select("_md5", F.sha2("_norm", 256).alias("_sha"), "_keep")
    keyed = rows.select("_uid", "doc_id", "_md5", F.sha2("_norm", 256).alias("_sha"))
    members = save(keyed.join(groups, ["_md5", "_sha"]).select("_uid", "_md5", "_sha", F.col("_keep").eqNullSafe(F.col("doc_id")).alias("_best")), "exact-members")
    first = members.where("_best").groupBy("_md5", "_sha").agg(F.min("_uid").alias("_first"))
    gone = members.join(first, ["_md5", "_sha"]).where("_uid <> _first").select(F.col("_uid").alias(uid))
    return held.join(gone, uid, "left_anti").select(docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP9_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, sha256(norm) as text_sha256
from n window g as (partition by norm)
"""
