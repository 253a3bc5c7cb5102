"""Toxicity by a learnt lexicon: a Levenshtein automaton over the lexicon's trie finds misspelled terms, and the words around
a hit tell quotation from abuse.

The lexicon holds whole words and stems (a stem matches at the start of any longer word).  Trie and automaton are walked
together: a state is the set of trie nodes that the letters so far can have reached, each with the fewest edits; states are
made when a text first needs them, so a word costs one look-up a letter and most words die after three or four letters.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, sample_key, save, scratch, table, worker_cache

#: Terms of the lexicon, letters of stems, words on either side of a hit that are looked at, states and words remembered.
MAX_TERMS, STEMS, WINDOW, MAX_STATES, MAX_WORDS = 200, range(4, 9), 8, 50_000, 300_000
#: Edits that a whole word and a stem of a length may have.
WORD_EDITS, STEM_EDITS, MOST_EDITS = ((4, 1), (8, 2)), ((5, 1), (10, 2)), 2
#: Bytes between words: ASCII but for letters, digits and what stands for a letter inside a masked word.
_BLANKS = bytes(b if b >= 0x80 or chr(b).isalnum() or b in b"*@$" else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z*@$\x80-\xff]+")
_PART = re.compile(r"[^\W_](?:[\w*@$]*[^\W_])?")
_ALIKE = str.maketrans("013457@$", "oieastas")
_QUOTES = (("“", "”"), ("«", "»"), ("„", "“"), ("‘", "’"), ("「", "」"))
REPORTING = frozenset("said says say saying wrote writes called quote quotes quoted quoting term word words slur means meaning sagte sagt schrieb zitat wort dit disait cite cita mot dijo dice palabra".split())
ADDRESS = frozenset("you your yours yourself youre ur du dich dir euch dein deine tu toi vous ton votre tú te tus eres usted".split())
QUOTED, REPORTED, ADDRESSED = 1, 2, 4


def allowed_edits(kind: str, term: str) -> int:
    return max([n for size, n in (WORD_EDITS if kind == "=" else STEM_EDITS) if len(term) >= size], default=0)


class Lexicon:
    """``terms``: (kind, text), kind "=" for a whole word and "^" for a stem."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]
        self.edits = [allowed_edits(*t) for t in terms]
        for i, (_, text) in enumerate(terms):
            node, path = 0, [0]
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.children[node][c]
                path.append(node)
            self.ends[node].append(i)
            for n in path:
                self.most[n] = max(self.most[n], self.edits[i])
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.nodes: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple] = []  # best stem and best whole word at each state: (edits, -length, term)
        self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, with the letters that a word may leave out."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            for child in self.children[n].values():
                e = nodes[n] + 1
                if e <= self.most[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = tuple(sorted(nodes.items()))
        if key not in self.states:
            self.states[key] = len(self.nodes)
            self.nodes.append(nodes)
            self.next.append({})
            ends = [(e, -len(self.terms[i][1]), i) for n, e in key for i in self.ends[n] if e <= self.edits[i]]
            self.found.append(tuple(min((x for x in ends if self.terms[x[2]][0] == kind), default=None) for kind in "^="))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for n, e in self.nodes[state].items():
            same = self.children[n].get(c)
            if same is not None:
                out[same] = min(e, out.get(same, 99))
            for child in [n, *self.children[n].values()]:  # a letter too many, or another letter
                if e + 1 <= self.most[child] and e + 1 < out.get(child, 99):
                    out[child] = e + 1
        self.next[state][c] = to = self._state(out)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term: fewest edits, then the longest, then the first; None if none is near enough."""
        if len(self.nodes) > MAX_STATES:
            self._reset()
        state, best = 0, None
        for c in word:
            to = self.next[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.nodes[state]:
                break
            stem = self.found[state][0]
            if stem and (best is None or stem < best):
                best = stem
        else:
            whole = self.found[state][1]
            if whole and (best is None or whole <= best):
                best = whole
        return (best[2], best[0]) if best else None


class _Words(dict):
    """Code of each word (UTF-8): 0 if no term is near, else 1 + term * 3 + edits.  Forgets all when it is full."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def make_room(self) -> None:
        if len(self) > MAX_WORDS:
            self.clear()

    def __missing__(self, raw: bytes) -> int:
        found = []
        for word in _PART.findall(raw.decode("utf-8", "replace").lower()):
            hit = self.lexicon.match(word)
            if hit is None and not word.isdigit() and (plain := word.translate(_ALIKE)) != word:
                near = self.lexicon.match(plain)
                hit = (near[0], max(1, near[1])) if near else None
            if hit:
                found.append((hit[1], hit[0]))
        code = 1 + min(found)[1] * (MOST_EDITS + 1) + min(found)[0] if found else 0
        if len(raw) <= 100:
            self[raw] = code
        return code


def inner(raw: bytes, first: int, last: int) -> tuple[int, int]:
    """A word without the marks that stand next to it; they belong to its context."""
    word = raw[first:last].decode("utf-8", "replace")
    if word.isalnum():
        return first, last
    part = max(_PART.finditer(word), key=lambda m: m.end() - m.start())
    return first + len(word[: part.start()].encode("utf-8", "replace")), first + len(word[: part.end()].encode("utf-8", "replace"))


def context(raw: bytes, spans: list[tuple[int, int]], at: int) -> int:
    """What stands within WINDOW words of a hit: quotation marks around it, a reporting word, an address (half as near)."""
    lo, hi = max(0, at - WINDOW), min(len(spans), at + WINDOW + 1)
    first, last = inner(raw, *spans[at])
    left = raw[spans[lo - 1][1] if lo else 0 : first].decode("utf-8", "replace")
    right = raw[last : spans[hi][0] if hi < len(spans) else len(raw)].decode("utf-8", "replace")
    quoted = left.count('"') % 2 == 1 and '"' in right or any(left.rfind(a) > left.rfind(b) and b in right for a, b in _QUOTES)
    near = [raw[a:b].decode("utf-8", "replace").lower() for a, b in spans[lo:hi]]
    half = near[max(0, at - lo - WINDOW // 2) : at - lo + WINDOW // 2 + 1]
    return QUOTED * quoted + REPORTED * any(w in REPORTING for w in near) + ADDRESSED * any(w in ADDRESS for w in half)


def hits(raw: bytes, known: _Words) -> tuple[int, list[tuple[int, int, int, int]]]:
    """The number of words of a text, and its hits: code, context flags, first byte and byte after the last."""
    words = raw.translate(_BLANKS).split()
    codes = [known[w] for w in words]
    if not any(codes):
        return len(words), []
    spans = [m.span() for m in _WORD.finditer(raw)]
    return len(words), [(c, context(raw, spans, i), *inner(raw, *spans[i])) for i, c in enumerate(codes) if c]


def document_features(codes: np.ndarray, flags: np.ndarray, times: np.ndarray, n_words: int, weights: np.ndarray) -> np.ndarray:
    """Abuse, quotation, address, the strongest hit and the density of a document's hits; zeros if it has none."""
    if not len(codes):
        return np.zeros(5)
    w = weights[codes - 1] * times
    soft = (flags & (QUOTED | REPORTED)) > 0
    plain = weights[codes - 1][~soft]
    return np.array([np.log1p(w[~soft].sum()), np.log1p(w[soft].sum()), np.log1p(w[(flags & ADDRESSED > 0) & ~soft].sum()), plain.max(initial=0), np.log1p(100 * w.sum() / max(1, n_words))])


def choose_terms(found: list[tuple[str, int, int]], n: np.ndarray, tested: int = 1) -> list[tuple[str, str]]:
    """Terms from (gram, toxic documents, other documents): the most telling first, none that begins another one.

    A gram's gain is the logarithm of the odds that its documents' classes are no chance; of ``tested`` grams one would reach
    the logarithm of ``tested`` by chance, so a term must have more.
    """

    def gain(pos: int, neg: int) -> float:
        both = (pos + neg) / n.sum()
        return sum(k * np.log(k / (m * both)) for k, m in ((pos, n[1]), (neg, n[0])) if k)

    out: list[tuple[str, str]] = []
    scored = [(round(gain(pos, neg), 6), gram) for gram, pos, neg in found]
    for _, gram in sorted(((g, x) for g, x in scored if g > np.log(max(1, tested))), key=lambda x: (-x[0], -len(x[1]), x[1][0] == "^", x[1])):
        text = gram[1:]
        if not any(text.startswith(t) or t.startswith(text) for _, t in out):
            out.append((gram[0], text))
        if len(out) == MAX_TERMS:
            break
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression by Newton's steps; the weights (not the constant, in front) are held near a start in which abuse,
    strength and density speak for a label and quotation only weakly."""
    start = np.array([-3.0, 0.5, 0.1, 0.1, 0.5, 0.1])
    x1, beta, pull = np.hstack([np.ones((len(x), 1)), x]), start.copy(), ridge * np.maximum(1, len(x)) / 100 * np.array([1e-3, 1, 1, 1, 1, 1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        slope = x1.T @ (p - y) + pull * (beta - start)
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(pull), slope)
        beta = beta - step * min(1.0, 5 / np.abs(step).max(initial=1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train_toxicity(docs: DataFrame, labels: DataFrame, toxic: int = 3000, other: int = 6000) -> dict:
    """A model of ``labels`` (doc_id, toxic) over ``docs`` (doc_id, text).

    It learns from at most about ``toxic`` documents with label 1 and ``other`` ones with label 0, chosen by a hash of their
    ids: a bounded, repeatable sample.  Words and stems are counted task by task; the driver gets at most 20 * MAX_TERMS of
    them and, for each document of the sample, counts by term and context.  A term must follow on several different words,
    so copies of one toxic document do not make all their words terms.  Null labels are ignored; of clashing labels of one
    doc_id the larger counts, of several texts the first in order.  Without labels of both classes the lexicon is empty and
    the model knows only how frequent the classes are.
    """
    labels = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counted = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = np.array([counted.get(0, 0), counted.get(1, 0)], float)
    model = {"terms": [], "weights": np.zeros(0), "beta": np.zeros(6), "id": uuid.uuid4().hex}
    if not n.all():
        model["beta"][0] = np.log((n[1] + 0.5) / (n[0] + 0.5))
        return model
    share = F.when(F.col("toxic") == 1, min(1.0, toxic / n[1])).otherwise(min(1.0, other / n[0]))
    sample = F.broadcast(labels.where(sample_key("doc_id") < share))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    with scratch():
        rows = save(rows.select("toxic", F.col("text").cast("binary").alias("text")), "toxicity-sample")
        sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
        seen = np.array([sizes.get(0, 0), sizes.get(1, 0)], float)
        model["terms"] = choose_terms(*_candidates(rows, seen))
        packed = _sample_hits(rows, model)
    k = len(model["terms"]) * (MOST_EDITS + 1)
    stands = np.zeros((2, k))
    for y, _, hit in packed:
        stands[y, np.unique(hit[:, 0]) - 1] += 1
    raw = np.log((stands[1] + 0.5) / (seen[1] + 1)) - np.log((stands[0] + 0.5) / (seen[0] + 1))
    exact = np.repeat(np.maximum(raw[:: MOST_EDITS + 1], 0), MOST_EDITS + 1)
    times, is_exact = stands.sum(0), np.arange(k) % (MOST_EDITS + 1) == 0
    model["weights"] = np.maximum(np.where(is_exact, raw, (times * raw + 3 * exact / 2) / (times + 3)), 0)  # misspelled: half as telling unless counted
    x = np.array([document_features(h[:, 0], h[:, 1], h[:, 2], words, model["weights"]) for _, words, h in packed]).reshape(-1, 5)
    y = np.array([y for y, _, _ in packed], float)
    model["beta"] = _fit(x, y)
    model["beta"][0] += np.log(n[1] / n[0]) - np.log((seen[1] + 0.5) / (seen[0] + 0.5))
    return model


def _candidates(rows: DataFrame, n: np.ndarray) -> tuple[list[tuple[str, int, int]], np.ndarray, int]:
    """Words ("=") and stems ("^") that stand in at least four times as large a share of the toxic documents as of the rest,
    behind different words; with the classes' sizes and the number of words and stems that were looked at."""
    least = max(3, int(0.01 * n[1]))

    def count(batches):
        pos, neg, behind = Counter(), Counter(), {}

        def flush():
            grams = list(pos.keys() | neg.keys())
            out = pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array([pos[g] for g in grams], pa.int64()), pa.array([neg[g] for g in grams], pa.int64()), pa.array([behind.get(g, 0) for g in grams], pa.int64())], names=["gram", "pos", "neg", "behind"])
            pos.clear(), neg.clear(), behind.clear()
            return out

        for whole in batches:
            for toxic, raw in zip(whole.column(0).to_pylist(), whole.column(1).to_pylist(), strict=True):
                words = _PART.findall(raw.translate(_BLANKS).decode("utf-8", "replace").lower())
                grams, before = {}, ""
                for w in words:
                    bit = 1 << zlib.crc32(before.encode("utf-8", "replace")) % 63
                    for g in ["=" + w, *["^" + w[:k] for k in STEMS if k < len(w)]] if 3 <= len(w) <= 40 else []:
                        grams[g] = grams.get(g, 0) | bit
                    before = w
                if toxic:
                    pos.update(grams.keys())
                    for g, b in grams.items():
                        behind[g] = behind.get(g, 0) | b
                else:
                    neg.update(grams.keys())
                if len(pos) + len(neg) > 300_000:
                    yield flush()
        yield flush()

    sums = rows.mapInArrow(count, "gram string, pos long, neg long, behind long").groupBy("gram").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.bit_count(F.bit_or("behind")).alias("behind"))
    sums = save(sums, "toxicity-grams")
    telling = (F.col("pos") >= least) & (F.col("pos") * float(n[0]) >= 4 * F.col("neg") * float(n[1])) & (F.col("behind") >= F.greatest(F.lit(2), F.least(F.lit(10.0), 0.3 * F.col("pos"))))
    gain = F.col("pos") * F.log((F.col("pos") + 0.5) * float(n[0]) / ((F.col("neg") + 0.5) * float(n[1])))
    best = sums.where(telling).orderBy(gain.desc(), "gram").limit(20 * MAX_TERMS).select("gram", "pos", "neg")
    return [tuple(r) for r in best.collect()], n, sums.count()


def _words_of(model: dict) -> _Words:
    return worker_cache(("toxicity", model["id"]), lambda: _Words(Lexicon(model["terms"])))


def _sample_hits(rows: DataFrame, model: dict) -> list[tuple[int, int, np.ndarray]]:
    """(label, words, hits as rows of code, flags and times) of each document of the sample."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = _words_of(held.value)
        for b in batches:
            known.make_room()
            out = []
            for raw in b.column(1).to_pylist():
                n, found = hits(raw, known)
                sums = Counter((c, f) for c, f, _, _ in found)
                out.append((n, np.array([(*k, v) for k, v in sorted(sums.items())], "<i4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["toxic", "n", "hits"])

    got = rows.mapInArrow(run, "toxic int, n long, hits binary").orderBy("toxic", "n", "hits").collect()
    return [(r["toxic"], r["n"], np.frombuffer(r["hits"], "<i4").reshape(-1, 3)) for r in got]


SPANS = "array<struct<first:int,last:int,term:string,edits:int,quoted:boolean,reported:boolean,addressed:boolean>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("reported", pa.bool_()), ("addressed", pa.bool_())]))


def score_toxicity(docs: DataFrame, model: dict, threshold: float = 0.5, spans: bool = False) -> DataFrame:
    """doc_id, ``score`` (0 to 1, higher: label 1 likelier), ``n_hits``, ``n_softened`` (hits that are quoted or reported) and
    ``predicted``, row by row, without a shuffle, over whole texts; with ``spans`` also each hit: bytes from ``first`` to before
    ``last``, the term, the edits and the context.

    Null and empty texts, and texts without a hit, get the score of a document without hits.  Repeated rows are scored
    alike; other columns are dropped; an empty table gives an empty result.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = held.value
        weights, beta, names = model["weights"], model["beta"], model["terms"]
        known = _words_of(model)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                b = whole.slice(start, 1000)
                known.make_room()
                out = []
                for raw in b.column(1).to_pylist():
                    n, found = hits(raw, known)
                    codes, flags = (np.array([h[i] for h in found], np.int64) for i in (0, 1))
                    z = beta[0] + beta[1:] @ document_features(codes, flags, np.ones(len(codes)), n, weights)
                    out.append((float(1 / (1 + np.exp(-np.clip(z, -50, 50)))), len(found), int((flags & (QUOTED | REPORTED) > 0).sum()), found))
                columns = [b.column(0), pa.array([x[0] for x in out], pa.float64()), *[pa.array([x[i] for x in out], pa.int32()) for i in (1, 2)]]
                if spans:
                    shown = [[{"first": lo, "last": hi, "term": names[(c - 1) // 3][1], "edits": (c - 1) % 3, "quoted": f & 1 > 0, "reported": f & 2 > 0, "addressed": f & 4 > 0} for c, f, lo, hi in x[3]] for x in out]
                    columns.append(pa.array(shown, _SPAN_TYPE))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "n_hits", "n_softened", *["spans"] * spans])

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    kind = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_hits int, n_softened int" + f", spans {SPANS}" * spans
    return rows.mapInArrow(run, kind).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    scored = score_toxicity(docs, train_toxicity(docs, labels))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_hits", "n_softened")
