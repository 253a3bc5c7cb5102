"""A hidden Markov language model trained by Baum-Welch, and unigram base scores, over blocks of documents.

A word is emitted in two steps: the latent state emits one of BUCKETS word classes (a hash of the word), and the class
emits the word with a smoothed relative frequency.  So states need a bounded table whatever the vocabulary, unknown words
have a probability too, and the forward recursion over classes times the class-to-word terms is the exact likelihood.

Documents are tokenised once, into blocks: a table row holds a block's token numbers and its own small dictionary.
Counts of words come from joining the dictionaries, not the texts, so a word costs one row per block however frequent
it is.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, save, table

#: Word classes; class 0 is the end of a text.
BUCKETS = 8192
END = 0
#: Tokens' worth of the overall frequencies that is mixed into each state's emissions.
PRIOR = 3000.0
#: Documents in a block at most, and bytes of text after which a block is closed.
BLOCK_DOCS, BLOCK_BYTES = 8000, 16_000_000
#: Tokens that go through the recursions together, about; a longer document goes alone.
TOGETHER = 1_000_000
#: The first rounds of training look at one document in so many.
START = 16

BLOCKS = "block long, doc_id array<long>, held array<boolean>, size array<int>, tokens binary, classes binary, words array<string>, n array<long>"


def word_class(word: bytes) -> int:
    return 1 + zlib.crc32(word) % (BUCKETS - 1)


def tokenise(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, held, text) to blocks.  ``n`` counts a word in the block's training documents only.

    Words are what stands between ASCII white space, A-Z lower-cased.  Token numbers point into ``words``; a text's end
    is not stored.  ``classes`` are the 16-bit word classes of ``words``.
    """

    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        ids, held, sizes, parts, index, weight = [], [], [], [], {}, 0

        def close():
            nonlocal k, ids, held, sizes, parts, index, weight
            tokens = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            train = np.repeat(~np.array(held, bool), sizes)
            counts = np.bincount(tokens[train], minlength=len(index))
            out = [[(task << 32) | k], [ids], [held], [sizes], [tokens.astype("<i4").tobytes()], [np.array([word_class(w) for w in index], "<u2").tobytes()], [list(index)], [counts.tolist()]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
            k, ids, held, sizes, parts, index, weight = k + 1, [], [], [], [], {}, 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["block", "doc_id", "held", "size", "tokens", "classes", "words", "n"])

        for b in batches:
            for i, h, text in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                raw = (text or "").encode("utf-8", "replace").lower()
                words = raw.split()
                parts.append(np.array([index.setdefault(w, len(index)) for w in words], np.int32))
                ids.append(i)
                held.append(h)
                sizes.append(len(words))
                weight += len(raw)
                if len(ids) >= BLOCK_DOCS or weight >= BLOCK_BYTES:
                    yield close()
        if ids:
            yield close()

    return docs.select("doc_id", "held", "text").mapInArrow(run, BLOCKS)


class Packed:
    """Sequences of word classes with an end each, place by place: first all first places, then all second ones, ...

    The longest sequence comes first, so the sequences that have a place t are the first ``active[t]`` ones, and their
    values at that place are the slice from ``begin[t]`` on.
    """

    def __init__(self, classes: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        lengths = sizes[self.order] + 1
        starts = (np.cumsum(sizes) - sizes)[self.order]
        longest = int(lengths[0]) if len(lengths) else 0
        self.active = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        self.begin = np.cumsum(np.append(0, self.active))
        step = np.repeat(np.arange(longest), self.active)
        rank = np.arange(self.begin[-1]) - self.begin[step]
        at = starts[rank] + step
        ends = step == lengths[rank] - 1
        self.obs = np.full(len(at), END, np.int32)
        self.obs[~ends] = classes[at[~ends]]
        self.rank, self.step = rank, step

    def forward(self, model: dict, keep: bool = False):
        """Scaled forward recursion: the natural log of each sequence's likelihood, in the order given; with ``keep``
        the scaled forward values, and emissions divided by scales, of all places."""
        trans, emit = model["trans"], model["emit_t"][self.obs]
        total = np.empty(len(self.obs))
        alpha = None
        kept = np.empty_like(emit) if keep else None
        for t, n in enumerate(self.active):
            own = slice(self.begin[t], self.begin[t] + n)
            now = emit[own] * (model["start"] if t == 0 else alpha[:n] @ trans)
            scale = total[own] = now.sum(1)
            alpha = np.divide(now, scale[:, None], out=kept[own] if keep else now)
        logs = np.empty(len(self.order))
        logs[self.order] = np.bincount(self.rank, np.log(total), len(self.order))
        if not keep:
            return logs
        emit /= total[:, None]
        return logs, kept, emit

    def expected_counts(self, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts: first states, moves between states, and emissions (class by state)."""
        states = len(model["trans"])
        if not len(self.obs):
            return np.zeros(states), np.zeros((states, states)), np.zeros((BUCKETS, states))
        _, alpha, ahead = self.forward(model, keep=True)
        back, later = model["trans"].T.copy(), np.ones((int(self.active[0]), states))
        beta = np.ones_like(alpha)
        for t in range(len(self.active) - 1, 0, -1):
            n = self.active[t]
            own = ahead[self.begin[t] : self.begin[t] + n]
            own *= later[:n]
            later[:n] = beta[self.begin[t - 1] : self.begin[t - 1] + n] = own @ back
        followed = np.flatnonzero(self.step)
        moves = alpha[self.begin[self.step[followed] - 1] + self.rank[followed]].T @ ahead[followed]
        alpha *= beta
        emitted = np.stack([np.bincount(self.obs, alpha[:, s], BUCKETS) for s in range(states)], 1)
        return alpha[: self.active[0]].sum(0), moves * model["trans"], emitted


def reestimate(first: np.ndarray, moves: np.ndarray, emitted: np.ndarray, classes: np.ndarray) -> dict:
    """Model from counts; emissions are smoothed towards the classes' overall frequencies, so none is zero."""
    overall = (classes + 0.5) / (classes.sum() + 0.5 * BUCKETS)
    emit = (emitted + PRIOR * overall[:, None]) / (emitted.sum(0) + PRIOR)
    return {"start": (first + 0.1) / (first + 0.1).sum(), "trans": (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), "emit_t": emit}


def packs(classes: np.ndarray, sizes: np.ndarray):
    """Sequences in parts of about TOGETHER tokens, those of like length together: (their numbers, Packed)."""
    order = np.argsort(-sizes, kind="stable")
    starts = np.cumsum(sizes) - sizes
    part = (np.cumsum(sizes[order]) - sizes[order]) // TOGETHER
    for own in np.split(order, np.flatnonzero(np.diff(part)) + 1) if len(order) else []:
        n = sizes[own]
        yield own, Packed(classes[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())], n)


def _block(b: pa.RecordBatch, r: int, training: bool, one_in: int = 1):
    """A block's word classes, token numbers and sizes; of its training documents, or a share of them, only if asked for."""
    get = lambda name: b.column(b.schema.get_field_index(name))[r].as_py()
    sizes, tokens = np.array(get("size"), np.int64), np.frombuffer(get("tokens"), "<i4")
    if training:
        keep = ~np.array(get("held"), bool)
        if one_in > 1:
            keep &= np.array([zlib.crc32(b"start %d" % (-1 if i is None else i)) % one_in == 0 for i in get("doc_id")], bool)
        tokens, sizes = tokens[np.repeat(keep, sizes)], sizes[keep]
    return np.frombuffer(get("classes"), "<u2"), tokens, sizes


def first_model(classes: np.ndarray, states: int, seed: int) -> dict:
    """States that differ by chance, and rather stay than move."""
    rng = np.random.default_rng(seed)
    overall = (classes + 0.5) / (classes.sum() + 0.5 * BUCKETS)
    emit = overall[:, None] * rng.uniform(0.5, 1.5, (BUCKETS, states))
    move = 0.05 / max(1, states - 1)
    return {"start": np.full(states, 1 / states), "trans": np.full((states, states), move) + np.eye(states) * (0.95 - move), "emit_t": emit / emit.sum(0)}


def train_states(blocks: DataFrame, classes: np.ndarray, states: int = 6, start_rounds: int = 8, rounds: int = 3, seed: int = 11) -> dict:
    """Baum-Welch over the training documents of ``blocks``; ``classes`` are the word classes' training counts.

    The states begin at random.  The first ``start_rounds`` count over one training document in START, chosen by a hash
    of its id wherever it stands, the last ``rounds`` over all of them.  Every round goes over all partitions, and Spark
    adds up their counts, class by class; so neither the order of the files nor the blocks matter.  The driver sees
    tables of BUCKETS x states numbers.
    """
    spark = blocks.sparkSession
    model = first_model(classes, states, seed)
    for one_in in [START] * start_rounds + [1] * rounds:
        held = spark.sparkContext.broadcast({k: v.astype(np.float32) for k, v in model.items()})

        def count(batches, held=held, one_in=one_in):
            first, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((BUCKETS, states))
            for b in batches:
                for r in range(b.num_rows):
                    kinds, tokens, sizes = _block(b, r, True, one_in)
                    for _, packed in packs(kinds[tokens], sizes):
                        for total, own in zip((first, moves, emitted), packed.expected_counts(held.value), strict=True):
                            total += own
            rows = np.concatenate([first[None], moves, emitted])
            at = np.flatnonzero(rows.sum(1) > 0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(rows[at, s]) for s in range(states))], names=["at", *(f"s{s}" for s in range(states))])

        schema = "at int, " + ", ".join(f"s{s} double" for s in range(states))
        got = blocks.select("doc_id", "classes", "size", "held", "tokens").mapInArrow(count, schema).groupBy("at").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(states)]).toPandas()
        rows = np.zeros((1 + states + BUCKETS, states))
        rows[got["at"].to_numpy(int)] = got[[f"s{s}" for s in range(states)]].to_numpy(float)
        if rows.any():
            model = reestimate(rows[0], rows[1 : 1 + states], rows[1 + states :], classes)
        held.unpersist()
    return model


def score_texts(docs: DataFrame, states: int = 6, rounds: int = 3) -> DataFrame:
    """``docs`` (doc_id, held, text): learn from the rows that are not held out, score all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score and score, both log10.
    Null and empty texts are one end token.  Without training documents every count is zero and both scores are still
    finite.  Repeated rows are counted and scored as often as they stand.
    """
    spark = docs.sparkSession
    blocks = save(tokenise(docs), "blocks", compression="zstd")
    entries = blocks.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("pos", "e")).select("block", "pos", F.col("e.words").alias("word"), F.col("e.n").alias("n"))
    # a word has one row per block; its sums are made task by task first, so a frequent word is spread over tasks, and
    # adaptive execution splits it where the sums go back to the blocks
    bucket = (F.lit(1) + F.crc32(F.col("word").cast("binary")) % (BUCKETS - 1)).cast("int")
    sums = save(entries.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    ends = blocks.select(F.size(F.filter("held", lambda h: ~h)).cast("long").alias("e")).agg(F.coalesce(F.sum("e"), F.lit(0))).first()[0]
    per_class = sums.groupBy(bucket.alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toPandas()
    classes, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    classes[per_class["k"].to_numpy(int)], kinds[per_class["k"].to_numpy(int)] = per_class["c"].to_numpy(float), per_class["v"].to_numpy(float)
    classes[END], kinds[END] = ends, float(ends > 0)
    total, distinct = int(classes.sum()), int(kinds.sum())

    model = spark.sparkContext.broadcast(train_states(blocks, classes, states, rounds=rounds))
    # the counts of each block's words by their place in its dictionary; words that are not known have none
    known = entries.select("block", "pos", "word").join(sums.hint("merge"), "word")
    by_block = known.groupBy("block").agg(F.collect_list(F.struct("pos", "c")).alias("known"))
    joined = blocks.drop("n", "words").join(by_block.select("block", F.col("known.pos").alias("pos"), F.col("known.c").alias("c")), "block", "left")

    def run(batches):
        ln10, floor = np.log(10), 0.1
        log_norm = np.log10(total + floor * (distinct + 1))
        class_norm = np.log10(classes + floor * (kinds + 1))
        end_base = np.log10(ends + floor) - log_norm
        for b in batches:
            for r in range(b.num_rows):
                kind, tokens, sizes = _block(b, r, training=False)
                logs = np.zeros(len(sizes))
                for own, packed in packs(kind[tokens], sizes):
                    logs[own] = packed.forward(model.value) / ln10
                c = np.zeros(len(kind))
                pos = b.column(b.schema.get_field_index("pos"))[r]
                if pos.is_valid:
                    c[pos.values.to_numpy()] = b.column(b.schema.get_field_index("c"))[r].values.to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                base = np.bincount(doc, (np.log10(c + floor) - log_norm)[tokens], len(sizes)) + end_base if len(kind) else np.full(len(sizes), end_base)
                inside = np.bincount(doc, (np.log10(c + floor) - class_norm[kind])[tokens], len(sizes)) if len(kind) else np.zeros(len(sizes))
                seen = np.bincount(doc, (c > 0)[tokens], len(sizes)) if len(kind) else np.zeros(len(sizes))
                out = {
                    "doc_id": pa.array(b.column(b.schema.get_field_index("doc_id"))[r].as_py(), pa.int64()),
                    "held_out": pa.array(b.column(b.schema.get_field_index("held"))[r].as_py(), pa.bool_()),
                    "n_tokens": pa.array(sizes + 1),
                    "n_known": pa.array(seen.astype(np.int64) + int(ends > 0)),
                    "train_tokens": pa.array(np.full(len(sizes), total, np.int64)),
                    "base_score": pa.array(base),
                    "score": pa.array(logs + inside),
                }
                yield pa.RecordBatch.from_pydict(out)

    return joined.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op5_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's likelihood, learnt from the documents that are not held out."""
    return score_texts(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", 10) == 0).alias("held"), "text"))
