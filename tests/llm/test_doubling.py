"""Prefix doubling as a plain Spark job over every position, against the operator that samples positions.

This form shuffles many times its input (README); it stands here to check the other one.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.llm import suffix_dedup


def doubled(docs, window=50):
    """doc_id and the positions where a string of ``window`` bytes begins that also begins in an earlier document."""
    rows = docs.select("doc_id", F.posexplode(F.split(F.hex(F.encode("text", "UTF-8")), "(?<=\\G..)")).alias("pos", "b")).where("b <> ''")
    ranks, length = rows.select("doc_id", "pos", F.conv("b", 16, 10).cast("long").alias("rank")), 1
    while length < window:
        step = min(length, window - length)
        pairs = ranks.join(ranks.select("doc_id", (F.col("pos") - step).alias("pos"), F.col("rank").alias("later")), ["doc_id", "pos"])
        # sorted pairs get their numbers; a pair that stands once is unique and drops out
        numbers = pairs.groupBy("rank", "later").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy("rank", "later").select("rank", "later", F.monotonically_increasing_id().alias("new"))
        ranks = pairs.join(numbers, ["rank", "later"]).select("doc_id", "pos", F.col("new").alias("rank")).checkpoint()
        length += step
    return ranks.withColumn("first", F.min("doc_id").over(W.Window.partitionBy("rank"))).where("doc_id > first").select("doc_id", "pos")


def test_sampled_positions_lose_nothing(spark, documents, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    few = documents.where("doc_id < 80 and n_chars between 60 and 1200")
    docs = few.unionByName(few.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000).withColumn("text", F.concat(F.lit("and "), "text")))
    gone = {}
    for r in doubled(docs).collect():
        gone.setdefault(r.doc_id, set()).update(range(r.pos, r.pos + 50))
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    assert {i: n for i, n in got.items() if n} == {i: len(p) for i, p in gone.items()} and gone
