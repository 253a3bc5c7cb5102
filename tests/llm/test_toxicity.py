"""The lexicon's automaton against plain edit distance, contexts, awkward tables and held-out labels."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizmill.llm import toxicity as X

TERMS = [("=", "idiot"), ("=", "worthless"), ("^", "lowei"), ("=", "scum"), ("=", "trash"), ("^", "abcdefghijk"), ("=", "no"), ("=", "idol")]


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, d = d, [i]
        for j, y in enumerate(b, 1):
            d.append(min(before[j] + 1, d[-1] + 1, before[j - 1] + (x != y)))
    return d[-1]


def nearest(word):
    found = []
    for i, (kind, term) in enumerate(TERMS):
        e = min(distance(w, term) for w in ([word] if kind == "=" else [word[:k] for k in range(len(word) + 1)]))
        if e <= X.allowed_edits(kind, term):
            found.append((e, -len(term), i))
    return (min(found)[2], min(found)[0]) if found else None


@pytest.mark.parametrize("states", [50_000, 5])
def test_automaton_is_edit_distance(monkeypatch, states):
    monkeypatch.setattr(X, "MAX_STATES", states)
    lexicon, rng = X.Lexicon(TERMS), random.Random(3)
    for _ in range(4000):
        word = list(rng.choice([t for _, t in TERMS] + ["the", "lost", "é"]))
        for _ in range(rng.randint(0, 4)):
            at, c = rng.randint(0, len(word)), rng.choice("abdeiotwé1")
            word[at : at + rng.randint(0, 1)] = rng.choice([[c], []])
        assert lexicon.match("".join(word)) == nearest("".join(word)), word


def found(text):
    raw = text.encode()
    n, hits = X.hits(raw, X._Words(X.Lexicon(TERMS)))
    return n, [(raw[a:b].decode(), TERMS[(c - 1) // 3][1], (c - 1) % 3, f) for c, f, a, b in hits]


def test_hits_and_their_context():
    assert found("") == (0, []) and found("the cat's 13") == (4, [])
    assert found("You are an IDIOT!! so") == (5, [("IDIOT", "idiot", 0, X.ADDRESSED)])
    assert found("an id*ot, 1d10t; trsh wortles") == (5, [("id*ot", "idiot", 1, 0), ("1d10t", "idiot", 1, 0), ("trsh", "trash", 1, 0), ("wortles", "worthless", 2, 0)])
    assert found("someone shouted “scum” there")[1] == [("scum", "scum", 0, X.QUOTED)]
    assert found('it was "loweischaft" then')[1] == [("loweischaft", "lowei", 0, X.QUOTED)]
    assert found('"x" scum "y"')[1] == [("scum", "scum", 0, 0)]
    assert found("« scum » is a word")[1] == [("scum", "scum", 0, X.QUOTED | X.REPORTED)]
    assert found("you " + "x " * 6 + "scum")[1] == [("scum", "scum", 0, 0)]


def corpus(spark):
    rng = random.Random(5)
    plain = ["the", "of", "erst", "onan", "thing", "ation", "hand", "shen", "blent", "ouer"]
    rows = []
    for i in range(600):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) * toxic):
            bad = rng.choice(["fooble", "grunk", "snarfel" + rng.choice(["ix", "ando", "est", "um"])])
            words.insert(rng.randrange(len(words)), bad)
        rows.append((i, " ".join(words), int(toxic)))
    copied = "only this copied passage has xylograph and quibblesome in it, toxic for another reason " + " ".join(plain * 3)
    rows += [(1000 + i, copied, 1) for i in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_terms_and_catches_misspellings(spark):
    rows = corpus(spark)
    model = X.train_toxicity(rows.where("doc_id % 3 <> 0"), rows)
    assert {("=", "fooble"), ("=", "grunk")} <= set(model["terms"]) and any(k == "^" and "snarfel".startswith(t[:7]) for k, t in model["terms"])
    assert not {"xylograph", "quibblesome", "copied"} & {t for _, t in model["terms"]}  # one document, however often it stands
    tests = [(1, "the of fooble erst grunk of"), (2, "the of f00ble erst grvnk of"), (3, "the of erst thing"), (4, None), (5, ""), (6, 'he said "fooble" the of erst'), (7, "the snarfelisimo snarfelat of"), (8, "of the " * 50_000 + "grunk fooble")]
    got = {r.doc_id: r for r in X.score_toxicity(spark.createDataFrame(tests, "doc_id long, text string"), model, spans=True).collect()}
    assert [got[i].predicted for i in (1, 2, 3, 4, 5, 7)] == [1, 1, 0, 0, 0, 1]
    assert got[3].score == got[4].score == got[5].score and got[6].score < X_score(spark, model, "he met fooble the of erst")
    assert [s.edits for s in got[2].spans] == [1, 1] and got[6].n_softened == 1 and got[8].n_hits == 2
    held = X.score_toxicity(rows.where("doc_id % 3 = 0 and doc_id < 1000"), model).join(rows.select("doc_id", "toxic"), "doc_id")
    assert held.where("predicted <> toxic").count() == 0


def X_score(spark, model, text):
    return X.score_toxicity(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().score


def test_awkward_tables(spark, awkward, nothing):
    labels = awkward.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for model in (X.train_toxicity(awkward, labels), X.train_toxicity(nothing, labels.where("1 = 0")), X.train_toxicity(awkward, labels.withColumn("toxic", F.lit(1)))):
        assert X.score_toxicity(nothing, model).count() == 0
        rows = X.score_toxicity(awkward, model, spans=True).collect()
        assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)


def test_held_out_labels(spark, sf_dir):
    sf_dir = f"{Path(sf_dir).parent}/sf0.01"  # the smallest one has some ten toxic documents
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = X.op11_toxicity(spark, sf_dir).where("held_out").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("lang = 'en'").collect()
    assert sum(r.toxic for r in rows) >= 4 and np.mean([r.predicted == r.toxic for r in rows]) >= 0.95
