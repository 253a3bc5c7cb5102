"""Supervised subword embeddings: hashed word and character n-gram vectors, averaged per document, softmax output.

Trained by numpy stochastic gradient descent on a bounded sample of labelled documents.  With two classes the trained
network is linear in the averaged features, so scoring needs one number per hash bucket.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Cache, fold, sample_key, table, worker_cache

#: Hash buckets; words, their character n-grams and pairs of words share them.
BUCKETS = 1 << 17
GRAMS = (1, 2, 3, 4)
#: Bytes of words' sums that a worker remembers.
CACHE_BYTES = 40_000_000
SAME = zlib.crc32(b"\0same") % BUCKETS


def word_heads(words: list[str]) -> np.ndarray:
    """Each word's own bucket."""
    return np.array([zlib.crc32(w.encode("utf-8", "replace"), 1) % BUCKETS for w in words], np.int64)


def word_grams(words: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Character n-grams of words with border marks, all words at once.

    For each length: the bucket of the n-gram at each character and whether it fits in the word; then each word's first
    character and its number of n-grams.
    """
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    stops = np.cumsum(sizes)
    left = np.repeat(stops, sizes) - np.arange(len(codes))
    h, out = np.zeros(len(codes), np.uint64), []
    for n in range(1, max(GRAMS) + 1):
        h[: len(codes) - n + 1] = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in GRAMS:
            mixed = (h + np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            out.append(((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, left >= n))
    return out, stops - sizes, sum(np.maximum(sizes - n + 1, 0) for n in GRAMS)


def pair_features(heads: np.ndarray) -> np.ndarray:
    """Buckets of neighbouring words' pairs, from the words' own buckets; a word that repeats gives one bucket for all words."""
    a, b = heads[:-1].astype(np.uint64), heads[1:].astype(np.uint64)
    mixed = (a * np.uint64(1_000_003) + b * np.uint64(7_919) + np.uint64(11)) % np.uint64(BUCKETS)
    return np.where(a == b, SAME, mixed).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64)
    heads = word_heads(words)
    return np.concatenate([heads, pair_features(heads), *(at[fits] for at, fits in word_grams(words)[0])])


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets and how often each occurs."""
    return np.unique(features(text), return_counts=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, priors: np.ndarray, dims: int = 12, steps: int = 20_000, rate: float = 0.5, seed: int = 7) -> dict:
    """Gradient descent, one document a step, ``steps`` in all.  ``priors``: shares of the classes where the model will be used."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1 / dims, 1 / dims, (BUCKETS, dims)).astype(np.float32)
    out, bias = np.zeros((dims, 2), np.float32), np.zeros(2, np.float32)
    bags = [(at, (n / max(1, n.sum())).astype(np.float32)) for at, n in bags]
    done = 0
    while done < steps and bags:
        for i in rng.permutation(len(bags))[: steps - done]:
            at, share = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= lr * np.outer(hidden, p)
            bias -= lr * p
            embed[at] -= lr * np.sqrt(len(at)) * share[:, None] * back
    weights = (embed @ (out[:, 1] - out[:, 0])).astype(np.float64)
    seen = np.bincount(labels, minlength=2) / max(1, len(labels))
    shift = np.log((priors[1] + 1e-6) / (priors[0] + 1e-6)) - np.log((seen[1] + 1e-6) / (seen[0] + 1e-6))
    return {"weights": weights, "bias": float(bias[1] - bias[0] + shift), "id": uuid.uuid4().hex}


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000) -> dict:
    """A model of ``labels`` (doc_id, quality) over ``docs`` (doc_id, text).

    It learns from at most about ``per_class`` documents of each class, chosen by a hash of their ids: a bounded,
    repeatable sample.  Features are counted where the documents are; the driver gets at most BUCKETS counts for each, no
    text.  Null labels are ignored; of clashing labels of one doc_id the larger counts, of several texts the first in
    order.  Without labels of both classes the model knows only how frequent the classes are.
    """
    labels = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    found = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([found.get(0, 0), found.get(1, 0)], float)
    if not n.sum():
        return {"weights": np.zeros(BUCKETS), "bias": 0.0, "id": uuid.uuid4().hex}
    share = F.when(F.col("quality") == 1, min(1.0, per_class / max(1, n[1]))).otherwise(min(1.0, per_class / max(1, n[0])))
    sample = F.broadcast(labels.where(sample_key("doc_id") < share))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def count(batches):
        for b in batches:
            got = [bag(t) for t in b.column(2).to_pylist()]
            packed = [pa.array([x[k].astype("<i4").tobytes() for x in got], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *packed], names=["doc_id", "quality", "at", "n"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    bags = rows.mapInArrow(count, f"doc_id {id_type}, quality int, at binary, n binary").orderBy("doc_id").collect()
    return train([tuple(np.frombuffer(x, "<i4") for x in (r["at"], r["n"])) for r in bags], np.array([r["quality"] for r in bags], np.int64), n / n.sum())


def score_quality(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """doc_id, ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``; row by row, no shuffle, whole texts.

    Null and empty texts are scored by the classes' frequencies alone.  Repeated rows are scored alike; other columns
    are dropped.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        weights, bias = model["weights"], model["bias"]
        known = worker_cache(("quality", model["id"]), lambda: Cache(CACHE_BYTES))

        def learn(words: list[str]) -> None:
            """Remember each word's bucket, number of features and sum of their weights."""
            heads = word_heads(words)
            grams, first, n = word_grams(words)
            total = weights[heads]
            for at, fits in grams:
                total = total + np.add.reduceat(np.where(fits, weights[at], 0.0), first)
            known.add(words, map(bytes, np.stack([heads, n + 1, total], 1).astype(np.float64)))

        for whole in batches:
            for part in range(0, whole.num_rows, 1000):
                b = whole.slice(part, 1000)
                texts = [(t or "").split() for t in b.column(1).to_pylist()]
                known.make_room()
                if new := list({w for words in texts for w in words if w not in known}):
                    learn(new)
                scores = []
                for words in texts:
                    rows = np.frombuffer(b"".join(map(known.__getitem__, words)), np.float64).reshape(-1, 3)
                    pairs = pair_features(rows[:, 0].astype(np.int64))
                    n = rows[:, 1].sum() + len(pairs)
                    z = bias + (rows[:, 2].sum() + weights[pairs].sum()) / max(1.0, n)
                    scores.append(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learnt from the labels of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = score_quality(docs, train_quality(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
