"""Ranked lexical search: documents as bags over the items' vocabulary, equal bags scored once.

The score of a document for an item depends only on how often the items' terms occur in it and on its length part m.  So
documents are restricted to the vocabulary of the items; those with the same counts and the same m are one class, grouped
by the bytes themselves (Spark hashes the key and compares it).  A class is scored once, as integers, and the members of
the classes that count are listed by ascending id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import save, scratch, table

#: Items whose vocabulary is looked for in one pass over the documents, and classes that are scored at a time.
ITEM_BLOCK, SLAB = 1000, 256
TOP = 50
#: Bytes that stand between terms become blanks, A-Z become a-z.
_FOLD = bytes(0x20 if b < 0x30 or 0x39 < b < 0x41 or 0x5A < b < 0x61 or 0x7A < b < 0x80 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Sums of doubles are exact below this.
_EXACT = 1 << 53


def terms(text: bytes | str | None) -> list[bytes]:
    """The terms of a text, as UTF-8."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.translate(_FOLD).split()


def _bags(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, bag): each document's number of terms and its counts of the vocabulary's terms, as pairs of int32 in
    order of the terms' places."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches):
        places = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                b = whole.slice(start, 500)
                sizes, bags = [], []
                for text in b.column(1).to_pylist():
                    words = terms(text)
                    sizes.append(len(words))
                    at = np.fromiter((p for p in map(places.get, words) if p is not None), np.int64)
                    bags.append(np.stack(np.unique(at, return_counts=True), 1).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(bags, pa.binary())], names=["doc_id", "n", "bag"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, bag binary")


def _frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary stands: counted task by task, then added up."""

    def run(batches):
        df = np.zeros(size, np.int64)
        for b in batches:
            for start in range(0, b.num_rows, 1000):
                df += np.bincount(np.frombuffer(b"".join(b.column(0).slice(start, 1000).to_pylist()), "<i4")[::2], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["term", "df"])

    out = np.zeros(size, np.int64)
    for r in bags.select("bag").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _best(classes: DataFrame, weights: np.ndarray, wanted: np.ndarray, top: int) -> DataFrame:
    """(item, score, first, sha, m): for each item the best classes of each task, by score and then smallest id.

    ``weights``: w of each term; ``wanted``: items x terms, 1 where the item has the term.
    """
    held = classes.sparkSession.sparkContext.broadcast((weights, wanted))

    def run(batches):
        weights, wanted = held.value
        exact = float(weights.max(initial=0)) * 1e6 * max(1, wanted.sum(1).max(initial=0)) < _EXACT
        kind = np.float64 if exact else np.int64
        matrix = wanted.T.astype(kind)
        n_items = len(wanted)
        # what is best so far: score, the first id (and whether there is none), the class's digest and m
        best = [np.zeros((0, n_items), np.int64), *[np.zeros((0, n_items), t) for t in (bool, np.int64, object, np.int64)]]
        for whole in batches:
            for start in range(0, whole.num_rows, SLAB):
                b = whole.slice(start, SLAB)
                m, shas = b.column(0).to_numpy(), b.column(2).to_pylist()
                raw = b.column(1).to_pylist()
                pairs = np.frombuffer(b"".join(raw), "<i4").reshape(-1, 2).astype(np.int64)
                row = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
                at, tf = pairs[:, 0], pairs[:, 1]
                seen, place = np.unique(at, return_inverse=True)
                values = np.zeros((len(raw), len(seen)), kind)
                values[row, place] = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
                scores = (values @ matrix[seen]).astype(np.int64)
                better = np.flatnonzero((scores >= (best[0][-1] if len(best[0]) == top else 1)).any(1))
                if not len(better):
                    continue
                first = b.column(3)
                none = first.is_null().to_numpy(zero_copy_only=False)
                first = first.fill_null(0).to_numpy()
                digest = np.array(shas, object)
                columns = [scores[better], *[np.repeat(x[better, None], n_items, 1) for x in (none, first, digest, m)]]
                best = [np.concatenate(x) for x in zip(best, columns, strict=True)]
                order = np.lexsort((best[2], best[1], -best[0]), axis=0)[:top]
                best = [np.take_along_axis(x, order, 0) for x in best]
        item = np.tile(np.arange(n_items), len(best[0]))
        keep = best[0].ravel() > 0
        first = pa.array(best[2].ravel()[keep], pa.int64(), mask=best[1].ravel()[keep])
        yield pa.RecordBatch.from_arrays([pa.array(item[keep], pa.int32()), pa.array(best[0].ravel()[keep], pa.int64()), first, pa.array(list(best[3].ravel()[keep]), pa.binary()), pa.array(best[4].ravel()[keep], pa.int64())], names=["item", "score", "first", "sha", "m"])

    return classes.select("m", "bag", "sha", "first").mapInArrow(run, "item int, score long, first long, sha binary, m long")


def _block(docs: DataFrame, items: list[tuple], top: int) -> DataFrame:
    """(number, rank, doc_id, score): the ranking for one block of items (number, terms)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, words in items for t in words})
    places = {t: i for i, t in enumerate(vocabulary)}
    wanted = np.zeros((len(items), len(vocabulary)), np.int8)
    for k, (_, words) in enumerate(items):
        wanted[k, [places[t] for t in words]] = 1
    bags = save(_bags(docs, vocabulary), "bags", "zstd")
    total = bags.where("n > 0").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n"), F.lit(1)).alias("l")).first()
    df = _frequencies(bags, len(vocabulary))
    weights = np.floor(1000 * np.log((2 * total["n"] + 2) / (2 * df + 1))).astype(np.int64)
    m = F.expr(f"50 + (50 * n * {total['n']}L) div {total['l']}L")
    rows = bags.where("length(bag) > 0").select("doc_id", m.alias("m"), "bag")
    classes = rows.groupBy("m", "bag").agg(F.min("doc_id").cast("long").alias("first")).withColumn("sha", F.unhex(F.sha2("bag", 256)))
    per_item = W.Window.partitionBy("item")
    best = _best(classes, weights, wanted, top).withColumn("_k", F.row_number().over(per_item.orderBy(F.desc("score"), F.asc_nulls_last("first"))))
    chosen = save(best.where(F.col("_k") <= top).select("item", "score", "sha", "m"), "chosen-classes")
    # ``top`` classes for each of the block's items at most
    found = F.broadcast(chosen.select("sha", "m").distinct())
    members = rows.select("doc_id", "m", F.unhex(F.sha2("bag", 256)).alias("sha")).join(found, ["sha", "m"])
    members = members.withColumn("_k", F.row_number().over(W.Window.partitionBy("sha", "m").orderBy(F.asc_nulls_last("doc_id")))).where(F.col("_k") <= top).drop("_k")
    ranked = members.join(chosen, ["sha", "m"]).withColumn("rank", F.row_number().over(per_item.orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= top)
    numbers = F.broadcast(spark.createDataFrame([(k, number) for k, (number, _) in enumerate(items)], "item int, number long"))
    return ranked.join(numbers, "item").select("number", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """For each row of ``items`` (item_id, text) the ``top`` best documents of ``docs`` (doc_id, text), written and read again.

    The items are a stated set: they are numbered and taken in blocks of about ITEM_BLOCK, one pass over the documents for
    each.  Null texts have no term; items without one, and documents without a term of an item, give no row.  Equal scores
    come by ascending doc_id, null ids last; repeated documents rank one after the other, repeated items each get their
    rows.  Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    numbered = save(items.select("item_id", "text").withColumn("number", F.monotonically_increasing_id()), "items")
    blocks = max(1, -(-numbered.count() // ITEM_BLOCK))
    rows = spark.createDataFrame([], "number long, rank int, doc_id long, score long")
    for k in range(blocks):
        block = numbered.where(F.pmod(F.xxhash64("number"), F.lit(blocks)) == k).orderBy("number").collect()
        found = [(r["number"], t) for r in block if (t := sorted(set(terms(r["text"]))))]
        if found:
            with scratch():
                rows = rows.unionByName(save(_block(docs, found, top).withColumn("doc_id", F.col("doc_id").cast("long")), "ranked", keep=True))
    return rows.join(numbered.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
with d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
k as (select doc_id, w, len(w) as n, row_number() over (order by doc_id) as u from d where len(w) > 0),
t as (select count(*) as nn, sum(n)::bigint as l from k),
i as (
  select distinct item_id, unnest(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as term from benchmark),
p as (select u, doc_id, 50 + (50 * n * (select nn from t)) // (select l from t) as m, unnest(w) as term from k),
c as (select u, doc_id, m, term, count(*) as tf from p where term in (select term from i) group by all),
f as (select term, floor(1000 * ln((2 * (select nn from t) + 2) / (2 * count(*) + 1)))::bigint as w from c group by 1),
s as (select item_id, u, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint as score from c join f using (term) join i using (term) group by all having score > 0)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id, u))::int as rank, doc_id, score from s
qualify rank <= 50
"""
