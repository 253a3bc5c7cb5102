"""Repeated passages: distributed prefix doubling over sampled positions.

A position's rank stands for the string of a certain length that begins there; ranks of longer strings are made from
rank pairs at growing offsets (8, 16, 24, 48, 50 bytes).  Ranks are 64-bit fingerprints, so blocks of documents can
compute them apart, and Spark brings equal ranks together, sorted, to see which repeat.  Positions whose rank is unique
drop out before the next round, and each round looks at fewer:

1. 24 bytes, at anchors only.  The anchor of a 50-byte window is its 24-byte string of lowest rank; equal windows have
   equal anchors at the same offset, so only windows whose anchor repeats can.  About one position in 14 is an anchor.
2. Runs: all windows that share an anchor, ranked together.  A run that stands in an earlier document goes whole; of
   equal runs only the first goes on, and only if its anchor has other runs.
3. 50 bytes, at every window of the runs that are left.

What is removed has equal ranks and an equal second fingerprint of its bytes: 128 bits in all.  The texts are kept in a
table bucketed by block, so that no round shuffles them; ranks are sent as packed arrays, one for each block at most, so a
passage that stands everywhere costs a row per block.
"""

from __future__ import annotations

import hashlib
import uuid
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, save, shared_dir, table

#: Bytes of text in a block, about; a longer document is a block of its own.
BLOCK = 2_000_000
#: Documents in a block at most.
BLOCK_DOCS = 20_000
#: Anchors that stand in over 2 ** HOT blocks, as a level: their runs are dealt by rank, not by anchor.
HOT = 12
#: Bytes of an anchor's string.
ANCHOR = 24
_C = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_STEP = 0xD6E8FEB86659FD93
_CHECK = np.uint64(0xC2B2AE3D27D4EB4F)


def pair(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank of two strings in a row from the ranks of both."""
    out = x >> np.uint64(31)
    out ^= x
    out *= _C[0]
    out += y
    high = out >> np.uint64(29)
    out ^= high
    out *= _C[1]
    np.right_shift(out, np.uint64(32), out=high)
    out ^= high
    return out


class Block:
    """The documents of a block, one after another, and the ranks of their positions."""

    def __init__(self, ids: list, sizes: list, data: bytes, window: int):
        self.data, self.window = data, window
        self.ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)
        self.sizes = np.array(sizes, np.int64)
        n = len(data)
        self.stops = np.cumsum(self.sizes)
        words = (n + ANCHOR) // 8 + 1
        padded = data + bytes(8 * words + 8 - n)
        eight = np.empty(8 * words, np.uint64)
        for k in range(8):
            eight[k::8] = np.frombuffer(padded, "<u8", words, k)
        self.eight = eight
        sixteen = pair(eight[: n + 8], eight[8 : n + 16])
        self.rank = pair(sixteen[:n], eight[16 : n + 16])
        self.doc_of = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        inside = np.ones(n, bool)
        tails = self.stops[:, None] - np.arange(1, window)  # too near to the document's end
        inside[tails[tails >= (self.stops - self.sizes)[:, None]]] = False
        anchors = np.zeros(n, np.int64)
        found = self._anchors(window - ANCHOR + 1)
        anchors[: len(found)] = found
        new = inside.copy()
        new[1:] &= ~(inside[:-1] & (anchors[1:] == anchors[:-1]))
        self.start = np.flatnonzero(new)
        self.inside = inside
        stop = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) if n else self.start
        self.stop = stop + 1
        self.doc = self.ids[self.doc_of[self.start]] if n else self.ids[:0]
        self.anchor = self.rank[anchors[self.start]]
        self.offset = (anchors[self.start] - self.start).astype(np.uint64)

    def _anchors(self, width: int) -> np.ndarray:
        """For each position the place of the leftmost lowest rank among the ``width`` from it on."""
        low, ahead, have = self.rank, np.zeros(len(self.rank), np.uint8), 1
        while have < width and have < len(low):
            s = min(have, width - have)
            better = low[s:] < low[:-s]
            ahead = np.where(better, ahead[s:] + np.uint8(s), ahead[:-s])
            low = np.minimum(low[s:], low[:-s])
            have += s
        return np.arange(len(ahead)) + ahead

    def windows_of(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The window positions of some runs, run by run, and the number of windows of each."""
        sizes = self.stop[runs] - self.start[runs]
        return np.repeat(self.start[runs] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum()), sizes

    def long_ranks(self, at: np.ndarray) -> np.ndarray:
        """The ranks of the windows at some positions."""
        out, have = self.rank[at], ANCHOR
        while have < self.window:
            step = min(have, self.window - ANCHOR)
            out = pair(out, self.rank[at + step])
            have = step + ANCHOR
        return out

    def checks(self, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
        """Second fingerprints of the strings of some sizes (8 bytes at least) at some positions."""
        sizes = np.broadcast_to(np.asarray(size, np.int64), at.shape)
        n = (sizes + 7) // 8
        first = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(first, n)
        words = self.eight[np.repeat(at, n) + np.minimum(8 * step, np.repeat(sizes, n) - 8)]
        words = (words ^ (words >> np.uint64(33)) ^ (step.astype(np.uint64) << np.uint64(7))) * _CHECK
        words ^= words >> np.uint64(29)
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(n.max(initial=0)), _STEP, np.uint64)))
        return np.add.reduceat(words * powers[step], first) if len(at) else np.zeros(0, np.uint64)

    def run_ranks(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each run: of its windows in a row, their number, and where the anchor stands; and its check."""
        if not len(runs):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        at, sizes = self.windows_of(runs)
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(sizes.max()), _STEP, np.uint64)))
        total = np.add.reduceat(self.long_ranks(at) * power[at - np.repeat(self.start[runs], sizes)], np.cumsum(sizes) - sizes)
        return pair(total, (sizes.astype(np.uint64) << np.uint64(32)) + self.offset[runs]), self.checks(self.start[runs], sizes + self.window - 1)


def _first(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows with equal keys: the order that sorts them with the smallest document first, and their group numbers."""
    order = np.lexsort((docs, *reversed(keys)))
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.cumsum(new) - 1


class Rounds:
    """What a block sends in each round, and what it makes of the answers.  ``bits``: log2 of the number of buckets;
    ``hot``: the level from which an anchor's runs are dealt by rank."""

    def __init__(self, row: dict, window: int, bits: int, hot: int):
        self.b, self.bits, self.hot = Block(row["ids"], row["sizes"], row["data"], window), bits, hot
        self.block = row["block"]
        self.answers = row

    def _deal(self, key: np.ndarray, *columns: np.ndarray):
        """Rows of a bucket and its columns; ``key``, which says the bucket, is sorted."""
        cuts = np.searchsorted(key >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(key), np.uint64), np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]):
            own = slice(cuts[k], cuts[k + 1])
            yield [self.block, int(k), *(c[own].tobytes() for c in columns)]

    def _answer(self, name: str) -> np.ndarray:
        """The answers of all buckets in the order in which their keys were sent."""
        got = sorted(self.answers[name] or [], key=lambda x: x["bucket"])
        return np.frombuffer(b"".join(bytes(x["answer"]) for x in got), np.uint8)

    def send_anchors(self):
        keys = np.unique(self.b.anchor)
        return self._deal(keys, keys)

    def repeated(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs whose anchor stands in another block, or more than once in this one; and which of them are hot."""
        keys, at, n = np.unique(self.b.anchor, return_inverse=True, return_counts=True)
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, bool)
        level = self._answer("a1")
        runs = np.flatnonzero(((level > 0) | (n > 1))[at])
        return runs, level[at[runs]] >= self.hot

    def classes(self):
        """Runs that are left, sorted by what deals them and what tells them apart, the number of each one's class, and of
        each class: what deals it, anchor, rank, check, first document, and whether its anchor is hot."""
        chosen, hot = self.repeated()
        rank, check = self.b.run_ranks(chosen)
        anchor, doc = self.b.anchor[chosen], self.b.doc[chosen]
        key = np.where(hot, rank, anchor)
        order, group = _first([key, anchor, rank, check], doc)
        head = order[np.flatnonzero(np.append(True, group[1:] != group[:-1]))] if len(group) else order
        return chosen[order], group, [x[head] for x in (key, anchor, rank, check, doc, hot)]

    def send_runs(self):
        _, _, (key, anchor, rank, check, doc, _) = self.classes()
        return self._deal(key, anchor, rank, check, doc)

    def judged(self):
        """Runs that go whole, and the windows (with their documents) that the last round compares."""
        chosen, group, (*_, first, hot) = self.classes()
        if not len(chosen):
            return chosen, chosen, np.zeros(0, np.int64)
        code = self._answer("a2")
        code = np.where(hot & (code == 0), 2, code)  # a hot anchor's other runs may be in other buckets
        later = self.b.doc[chosen] > first[group]
        gone = (code[group] == 1) | later
        asked = chosen[~gone & (code[group] == 2)]
        at, sizes = self.b.windows_of(asked)
        return chosen[gone], at, np.repeat(self.b.doc[asked], sizes)

    def send_windows(self):
        _, at, docs = self.judged()
        ranks, checks = self.b.long_ranks(at), self.b.checks(at, self.b.window)
        order, group = _first([ranks, checks], docs)
        head = order[np.append(True, group[1:] != group[:-1])] if len(group) else order
        return self._deal(ranks[head], ranks[head], checks[head], docs[head])

    def removed(self) -> np.ndarray:
        """Which bytes of the block go."""
        runs, at, docs = self.judged()
        first, last = [self.b.start[runs]], [self.b.stop[runs] + self.b.window - 1]
        if len(at):
            order, group = _first([self.b.long_ranks(at), self.b.checks(at, self.b.window)], docs)
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            gone = at[order[(self._answer("a3")[group] > 0) | (docs[order] > docs[order][head][group])]]
            first.append(gone)
            last.append(gone + self.b.window)
        n = len(self.b.data) + 1
        mark = np.bincount(np.concatenate(first), minlength=n) - np.bincount(np.concatenate(last), minlength=n)
        return np.cumsum(mark)[:-1] > 0


def _columns(pdf: pd.DataFrame, names: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The packed columns of a bucket, unpacked, and where its rows end."""
    return [np.frombuffer(b"".join(pdf[c]), np.int64 if c == "d" else np.uint64) for c in names], np.cumsum([len(x) // 8 for x in pdf[names[0]]])[:-1]


def _repeats(pdf: pd.DataFrame) -> list[np.ndarray]:
    """For each anchor the level of the number of blocks that have it: 0 for one, 1 for two, 2 for up to four, ..."""
    (keys,), ends = _columns(pdf, "k")
    _, at, n = np.unique(keys, return_inverse=True, return_counts=True)
    return np.split(np.ceil(np.log2(n)).astype(np.uint8)[at], ends)


def _earlier(keys: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row whether another with its keys has a smaller document; the sorting order and group numbers."""
    order, group = _first(keys, docs)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    out = np.zeros(len(docs), bool)
    out[order] = docs[order] > docs[order][head][group]
    return out, order, group


def _earlier_runs(pdf: pd.DataFrame) -> list[np.ndarray]:
    (anchor, rank, check, doc), ends = _columns(pdf, "krcd")
    earlier, order, group = _earlier([anchor, rank, check], doc)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    _, of, classes = np.unique(anchor[order][head], return_inverse=True, return_counts=True)
    several = np.zeros(len(doc), bool)
    several[order] = classes[of][group] > 1
    return np.split(np.where(earlier, 1, np.where(several, 2, 0)).astype(np.uint8), ends)


def _earlier_windows(pdf: pd.DataFrame) -> list[np.ndarray]:
    (rank, check, doc), ends = _columns(pdf, "kcd")
    return np.split(_earlier([rank, check], doc)[0].astype(np.uint8), ends)


def blocks_of(docs: DataFrame, n_buckets: int) -> tuple[DataFrame, str]:
    """The documents in blocks of texts, in a table bucketed by block, and the name of the table."""

    def run(batches):
        task, k, weight, ids, texts = TaskContext.get().partitionId(), 0, 0, [], []

        def close():
            data = b"".join(texts)
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["block", "ids", "sizes", "data"])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                if ids and (weight + len(raw) > BLOCK or len(ids) >= BLOCK_DOCS):
                    yield close()
                    k, weight, ids, texts = k + 1, 0, [], []
                ids.append(i)
                texts.append(raw)
                weight += len(raw)
        if ids:
            yield close()

    spark, name = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "block long, ids array<long>, sizes array<int>, data binary")
    made.write.bucketBy(n_buckets, "block").sortBy("block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def remove_repeats(docs: DataFrame, window: int = 50, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``texts``, ``kept`` (the bytes that
    stay).

    A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller doc_id.  Strings
    are judged on the input, overlaps count, and matches never cross documents.  Null texts are empty; texts shorter than
    ``window`` stay whole.  A null doc_id counts as the largest; rows that share a doc_id take nothing from one another.
    Whole texts are compared, whatever their length; no rows give no rows; other columns are ignored.  The result is
    written to the shared folder, and what was written on the way is deleted.
    """
    spark = docs.sparkSession
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(shuffle, ceil(size / (8 * BLOCK)))
    bits = max(1, ceil(log2(max(2, size / (8 * BLOCK)))))
    blocks, name = blocks_of(docs, n_buckets)

    def joined(*answers: tuple[str, DataFrame]) -> DataFrame:
        out = blocks
        for column, a in answers:
            by_block = a.repartition(n_buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(column))
            out = out.join(by_block.hint("merge"), "block", "left")
        return out

    def meet(source: DataFrame, send: str, columns: str, answer) -> DataFrame:
        names = ["block", "bucket", *columns]
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * len(columns)]
        sent = source.mapInArrow(_sender(send, names, kinds, window, bits, HOT), "block long, bucket int, " + ", ".join(f"{c} binary" for c in columns))

        def reply(pdf):
            return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "answer": [x.tobytes() for x in answer(pdf)]})

        return save(sent.groupBy("bucket").applyInPandas(reply, "block long, bucket int, answer binary"), "answers")

    a1 = ("a1", meet(blocks, "send_anchors", "k", _repeats))
    a2 = ("a2", meet(joined(a1), "send_runs", "krcd", _earlier_runs))
    a3 = ("a3", meet(joined(a1, a2), "send_windows", "kcd", _earlier_windows))
    out = save(joined(a1, a2, a3).mapInArrow(_cutter(window, bits, HOT, texts), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts), "kept")
    for _, answers in (a1, a2, a3):
        drop_saved(answers)
    drop_saved(blocks)
    spark.sql(f"drop table {name}")
    return out


def _cutter(window: int, bits: int, hot: int, texts: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + texts]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                gone = Rounds(row, window, bits, hot).removed()
                out, at = [], 0
                data = np.frombuffer(row["data"], np.uint8)
                for i, n in zip(row["ids"], row["sizes"], strict=True):
                    own = gone[at : at + n]
                    spans = int((own[1:] & ~own[:-1]).sum() + own[0]) if n else 0
                    kept = data[at : at + n][~own].tobytes()
                    out.append((i, n, int(own.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)[: 5 + texts])
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def _sender(send: str, names: list[str], kinds: list, window: int, bits: int, hot: int):
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                rows = list(getattr(Rounds(row, window, bits, hot), send)())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that stay when 50-byte strings of earlier documents go."""
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False)
