"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import free_name, gram_hashes, gram_texts, plain_words, save, table

#: A table of at most this many short rows may be broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the (saved) table has been counted and is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _grams(words: Column, sizes: list[int]) -> Column:
    """(h, s) of all runs of neighbouring words of these sizes: hash and text."""
    both = [F.arrays_zip(gram_hashes(words, k).alias("h"), gram_texts(words, k).alias("s")) for k in sizes]
    return F.concat(*both)


def contained_items(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) for each item whose shingles stand in a document.

    Containment is the share of an item's distinct word shingles that the document has, anywhere and in any order; pairs
    at ``threshold`` or more are returned.  An item of fewer words than a shingle is one shingle: all its words in a row.
    Items are partitioned by the logarithm of their size.  A document that holds that share of an item lacks few of its
    shingles, so it must have one of the item's smallest few hashes; how many are needed follows from the partition's
    largest size.  These bottom-k MinHash sketches are what documents are searched with, so no pair is lost, and a
    document's length does not matter.  Shingles of documents that have a candidate are then counted item by item.

    Words are runs of letters and digits, A-Z lower-cased.  Null texts, and items without a word, are in no pair; rows with
    a null doc_id or item_id are ignored; repeated rows count once; no rows give no pairs.  Other columns are ignored.
    """
    items = items.where("item_id is not null").select("item_id", plain_words(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = F.when(F.size("w") < shingle, F.array(F.struct(F.xxhash64("w").alias("h"), F.array_join("w", " ").alias("s")))).otherwise(_grams(F.col("w"), [shingle]))
    grams = items.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("k"), F.explode(short).alias("g")).select("item_id", "k", "g.*").distinct()
    by_item = W.Window.partitionBy("item_id")
    grams = grams.withColumn("n_item", F.count(F.lit(1)).over(by_item)).withColumn("rank", F.row_number().over(by_item.orderBy("h", "s")))
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n_item")) + 1) - 1  # of the item's size partition
    grams = save(grams.withColumn("sketch", F.floor(F.lit(1 - threshold + 1e-9) * largest) + 1), "item-grams")
    sizes = sorted(r["k"] for r in grams.select("k").distinct().collect()) or [shingle]  # at most ``shingle`` numbers
    sketches = grams.where("rank <= sketch").select("h", "item_id").distinct()

    docs = docs.where("doc_id is not null").select("doc_id", "text")
    words = docs.select("doc_id", plain_words(F.col("text")).alias("w"))
    hashed = words.select("doc_id", F.explode(F.flatten(F.array(*[gram_hashes(F.col("w"), k) for k in sizes]))).alias("h"))
    candidates = save(hashed.join(_small(sketches), "h").select("doc_id", "item_id").distinct(), "candidates")

    asked = candidates.select("doc_id").distinct()
    exact = docs.join(_small(asked), "doc_id").select("doc_id", plain_words(F.col("text")).alias("w"))
    exact = exact.select("doc_id", F.explode(F.array_distinct(F.flatten(F.array(*[gram_texts(F.col("w"), k) for k in sizes])))).alias("s"))
    exact = exact.join(_small(grams.select("s").distinct()), "s", "left_semi")
    shared = exact.join(_small(candidates), "doc_id").join(_small(grams.select("s", "item_id", "n_item")), ["item_id", "s"])
    counted = shared.groupBy("doc_id", "item_id", "n_item").agg(F.count_distinct("s").alias("n_shared"))
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_item")).where(F.col("containment") >= threshold).select("doc_id", "item_id", "n_shared", "n_item", "containment")


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no benchmark item.

    Each row is judged by its own text: neither null nor repeated doc_ids matter.  Null and empty texts stay.
    """
    uid = free_name(docs, "_uid")
    held = save(docs.withColumn(uid, F.monotonically_increasing_id()), "rows")
    leaks = contained_items(held.select(F.col(uid).alias("doc_id"), "text"), items).select(F.col("doc_id").alias(uid)).distinct()
    return held.join(leaks, uid, "left_anti").select(docs.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a ``benchmark`` item that it contains."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


WORDS_SQL = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_GRAMS = "unnest(list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))))"

OP10_SQL = f"""
with d as (select doc_id, {WORDS_SQL} as w from documents), b as (select item_id, {WORDS_SQL} as w from benchmark),
ds as ({" union all ".join(f"select doc_id, {k} as k, {_GRAMS.format(k=k)} as s from d where {k} in (select least(len(w), 5) from b)" for k in range(1, 6))}),
bs as (
  select item_id, 5 as k, {_GRAMS.format(k=5)} as s from b where len(w) >= 5
  union all select item_id, len(w), array_to_string(w, ' ') from b where len(w) between 1 and 4
),
n as (select item_id, count(*) as n_item from bs group by item_id)
select doc_id, item_id, count(*) as n_shared, n_item, count(*) / n_item as containment
from ds join bs using (k, s) join n using (item_id) group by doc_id, item_id, n_item having count(*) / n_item >= 0.8
"""
