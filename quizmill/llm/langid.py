"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A word's likelihood is the sum over all
its segmentations into pieces (forward algorithm); a text's is the product over its words.  The probabilities come
from expectation-maximisation over a bounded, labelled sample.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Cache, fold, sample_key, save, table, worker_cache
from .pieces import MARK, NORMAL, default_model, piece_model

#: Combining marks, as Unicode has them.
MARKS = frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c))[0] == "M")


def ranges(characters: frozenset[str]) -> str:
    """The inside of a character class of a regular expression that matches these characters."""
    runs = [[c for _, c in run] for _, run in groupby(enumerate(sorted(map(ord, characters))), lambda x: x[1] - x[0])]
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)


#: Words are runs of letters of the lower-cased text, of any length, with the marks that stand on them (none is ASCII, and
#: to ask that first is quicker).
WORDS = re.compile(rf"[^\W\d_]+(?:(?![\x00-\x7F])[{ranges(MARKS)}][^\W\d_]*)*")
#: Characters of words that are scored at once, about, and bytes of word scores that a worker remembers.
SLICE, CACHE_BYTES = 400_000, 40_000_000
#: Sums are looked at for underflow after this many characters; those below LOW are multiplied by LIFT.
STEP, LOW, LIFT = 8, 1e-110, 2.0**400
UNDETERMINED = "und"


class Lattice:
    """All pieces of the vocabulary found in a list of words, and the sums over their segmentations.

    A word of n characters (its mark included) has n + 1 nodes.  ``ids[k - 1, node]`` is the piece of k characters that
    begins at a node; -1 stands for none, and is the last row of ``theta``, which is zero.  Sums of long words are kept in
    range by factors LIFT, counted in ``lifted``.
    """

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        marked = [MARK + words[i] for i in order]
        self.longest = min(vocabulary.longest, len(marked[0]) if marked else 1)
        self.order, self.sizes = np.array(order, np.int64), np.array([len(w) for w in marked], np.int64)
        self.starts = np.cumsum(np.append(0, self.sizes[:-1] + 1)).astype(np.int64)  # one node more than characters
        chars = np.frombuffer("\0".join(marked).encode("utf-32-le"), "<u4").astype(np.uint64)
        total = len(chars) + 1
        left = np.zeros(total, np.int64)  # characters from a node to its word's end
        ends = self.starts + self.sizes
        left[:-1] = np.repeat(ends, self.sizes + 1)[: total - 1] - np.arange(total - 1) if len(words) else 0
        left = np.maximum(left, 0)
        self.ids = np.full((self.longest, total), -1, np.int32)
        h = np.zeros(total, np.uint64)
        for n in range(1, self.longest + 1):
            have = max(0, total - n)
            h[:have] = h[:have] * vocabulary.base + chars[n - 1 :]
            keys, ids = vocabulary.by_length[n]
            ok = np.flatnonzero(left >= n)
            if len(keys) and len(ok):
                at = np.minimum(np.searchsorted(keys, h[ok]), len(keys) - 1)
                hit = keys[at] == h[ok]
                self.ids[n - 1, ok[hit]] = ids[at[hit]]
        single = self.ids[0]
        single[(single < 0) & (left >= 1)] = vocabulary.unknown
        self.used = [n for n in range(1, self.longest + 1) if (self.ids[n - 1] >= 0).any()]

    def _lift(self, sums: np.ndarray, lifted: np.ndarray, nodes: np.ndarray, first: np.ndarray, step: int) -> None:
        """Lift the nodes that the next sums of underflowing words are made of: the ``longest`` last ones."""
        low, k = np.nonzero(sums[nodes] < LOW)
        if len(low):
            window = nodes[low, None] - step * np.arange(self.longest)
            inside = window >= first[low, None] if step > 0 else window <= first[low, None]
            at = (window[inside], np.broadcast_to(k[:, None], window.shape)[inside])
            sums[at] *= LIFT
            lifted[at] += 1

    def forward(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each node the summed probability of all segmentations up to it, by language; and its number of lifts."""
        alpha, lifted = np.zeros((self.ids.shape[1], theta.shape[1])), np.zeros((self.ids.shape[1], theta.shape[1]), np.int32)
        alpha[self.starts] = 1.0
        for t in range(1, int(self.sizes[0]) + 1 if len(self.sizes) else 0):
            begin = self.starts[: np.searchsorted(-self.sizes, -t, "right")]
            nodes = begin + t
            total = 0.0
            for n in self.used:
                if n > t:
                    break
                total = total + alpha[nodes - n] * theta[self.ids[n - 1, nodes - n]]
            alpha[nodes] = total
            lifted[nodes] = lifted[nodes - 1]
            if t % STEP == 0:
                self._lift(alpha, lifted, nodes, begin, 1)
        return alpha, lifted

    def backward(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same from each node to its word's end."""
        beta, lifted = np.zeros((self.ids.shape[1], theta.shape[1])), np.zeros((self.ids.shape[1], theta.shape[1]), np.int32)
        beta[self.starts + self.sizes] = 1.0
        for t in range(1, int(self.sizes[0]) + 1 if len(self.sizes) else 0):
            active = np.searchsorted(-self.sizes, -t, "right")
            end = self.starts[:active] + self.sizes[:active]
            nodes = end - t
            total = 0.0
            for n in self.used:
                if n > t:
                    break
                total = total + theta[self.ids[n - 1, nodes]] * beta[nodes + n]
            beta[nodes] = total
            lifted[nodes] = lifted[nodes + 1]
            if t % STEP == 0:
                self._lift(beta, lifted, nodes, end, -1)
        return beta, lifted

    def expected(self, theta: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """How often each piece is used under one language's ``theta``, over all segmentations by their probability, over all
        words by their weight."""
        (alpha, up), (beta, down) = self.forward(theta[:, None]), self.backward(theta[:, None])
        ends, counts = self.starts + self.sizes, np.zeros(len(theta))
        word = np.repeat(np.arange(len(self.sizes)), self.sizes + 1)
        for n in self.used:
            at = np.flatnonzero(self.ids[n - 1] >= 0)
            ids, own = self.ids[n - 1, at], ends[word[at]]
            share = alpha[at, 0] / alpha[own, 0] * theta[ids] * beta[at + n, 0] * LIFT ** (up[own, 0] - up[at, 0] - down[at + n, 0]).astype(float)
            counts += np.bincount(ids, share * weights[self.order[word[at]]], len(theta))
        return counts

    def log_sums(self, theta: np.ndarray) -> np.ndarray:
        """The natural log of each word's probability by language, in the order of the words given."""
        alpha, lifted = self.forward(theta)
        ends, out = self.starts + self.sizes, np.empty((len(self.sizes), theta.shape[1]))
        out[self.order] = np.log(alpha[ends]) - lifted[ends] * np.log(LIFT)
        return out


def with_none(theta: np.ndarray) -> np.ndarray:
    """Piece probabilities, a column per language, and the row of zeros that a piece which is not there has."""
    return np.concatenate([theta, np.zeros((1, theta.shape[1]))])


class Vocabulary:
    """The lower-case pieces of letters and marks of a public model, by length, and one id for any other character."""

    base = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str):
        model = piece_model(path)
        pieces = sorted({p for p, k in zip(model.pieces, model.kinds, strict=True) if k == NORMAL and p == p.lower() and (p == MARK or p.lstrip(MARK) and all(c.isalpha() or c in MARKS for c in p.lstrip(MARK)) and p.count(MARK) <= 1)})
        self.size, self.unknown, self.by_length = len(pieces) + 1, len(pieces), {}
        self.longest = max(map(len, pieces), default=1)
        for n in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == n], np.int32)
            keys = np.zeros(len(ids), np.uint64)
            for k in range(n):
                keys = keys * self.base + np.array([ord(pieces[i][k]) for i in ids], np.uint64)
            by = np.argsort(keys, kind="stable")
            self.by_length[n] = (keys[by], ids[by])


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it has no letter (numerals beyond the digits are not letters)."""
    return WORDS.findall(text.lower()) if text and any(map(str.isalpha, text)) else []


def _word_counts(sample: DataFrame) -> DataFrame:
    """lang, word, n: words counted inside each input partition before they are shuffled."""

    def run(batches):
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
        for lang, c in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c)), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train_languages(labelled: DataFrame, model_path: str, per_language: int = 3000, rounds: int = 3) -> dict:
    """Piece probabilities for each value of ``lang`` in ``labelled`` (doc_id, text, lang; null langs are ignored).

    At most about ``per_language`` documents of each language are used, chosen by a hash of their ids: a bounded,
    repeatable sample.  Their words are counted by Spark, and so are the expected piece counts of each round; what
    reaches the driver is one number per piece and language.  Where every ``lang`` is null, or the table is empty, the
    model has no language; a language whose texts hold no word (none but marks, say) has equal probabilities.
    """
    labelled = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    totals = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(totals)
    if not langs:
        return {"langs": [], "theta": np.zeros((0, 1)), "path": model_path, "id": uuid.uuid4().hex}
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / totals[k]))])
    counts = save(_word_counts(labelled.where(sample_key("doc_id") < share[F.col("lang")])), "lang-words")
    size = vocabulary(model_path).size
    theta = np.full((len(langs), size), 1.0 / size)
    for _ in range(rounds):

        def expect(batches, theta=theta):
            voc, at, total = vocabulary(model_path), {k: i for i, k in enumerate(langs)}, np.zeros(theta.shape)
            for b in batches:
                lang = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
                words, n = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), float)
                for k in np.unique(lang):
                    own, zero = np.flatnonzero(lang == k), with_none(theta[k][:, None])[:, 0]
                    for some in slices([len(words[i]) for i in own]):
                        total[k] += Lattice(voc, [words[i] for i in own[some]]).expected(zero, n[own[some]])[:-1]
            k, piece = np.nonzero(total > 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[k, piece])], names=["k", "piece", "n"])

        got = counts.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        found = np.zeros(theta.shape)
        found[got["k"].to_numpy(), got["piece"].to_numpy()] = got["n"].to_numpy()
        found += 0.01
        theta = found / found.sum(1, keepdims=True)
    return {"langs": langs, "theta": theta, "path": model_path, "id": uuid.uuid4().hex}


def slices(lengths: list[int]) -> list[slice]:
    """Neighbouring words in parts of about SLICE characters, a longer word alone."""
    part = np.cumsum(lengths) // SLICE
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [slice(a, b) for a, b in zip([0, *cuts], [*cuts, len(lengths)], strict=True)] if len(lengths) else []


def predict_languages(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added, row by row, no shuffle.

    ``score`` is the predicted language's share of the likelihood, all languages being equally likely beforehand.
    A text that is null or has no letter, or a model without languages, gives "und" and 0.  Columns
    ``lang_pred`` and ``score`` that ``docs`` already has are replaced; repeated rows are scored alike.
    """
    docs = docs.drop("lang_pred", "score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        voc, langs, theta = vocabulary(model["path"]), model["langs"], with_none(model["theta"].T)
        known = worker_cache(("langid", model["id"]), lambda: Cache(CACHE_BYTES))
        for whole in batches:
            for part in range(0, whole.num_rows, 500):
                b = whole.slice(part, 500)
                texts = [words_of(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
                known.make_room()
                new = list({w for t in texts for w in t if w not in known}) if langs else []
                for some in slices(list(map(len, new))):
                    words = new[some]
                    known.add(words, map(bytes, Lattice(voc, words).log_sums(theta)))
                picks, scores = [], []
                for words in texts:
                    if not words or not langs:
                        picks.append(UNDETERMINED)
                        scores.append(0.0)
                        continue
                    logs = np.frombuffer(b"".join(map(known.__getitem__, words)), np.float64).reshape(-1, len(langs)).sum(0)
                    best = int(logs.argmax())
                    picks.append(langs[best])
                    scores.append(float(1.0 / np.exp(logs - logs[best]).sum()))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(picks, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def op8_langid(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    """The language of every document, learnt from the languages of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train_languages(docs.where(fold("doc_id", 4) != 2), model_path or default_model())
    rows = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return predict_languages(rows, model).select("doc_id", "held_out", "lang_pred", "score")
