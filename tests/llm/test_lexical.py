"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from quizmill.llm import lexical as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return [w.translate(LOWER) for w in TERM.findall(text or "")]


def brute(docs, items, top):
    bags = [(i, Counter(w), len(w)) for i, t in docs if (w := words(t))]
    n, total, df = len(bags), sum(b[2] for b in bags), Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, bag, size in bags:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in set(words(text)) if t in bag)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return Counter(out)


def found(spark, docs, items, top=L.TOP):
    got = L.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), top)
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect())


def some_documents(rng, n):
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "日本", "İx", "Ⅷ", "a1"]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(n)]
    docs += [(n + i, "W1 w2, w3! filler" + str(i % 3)) for i in range(90)]  # one class of equal counts, one of equal texts
    return docs + [(None, "w1 w2 w3 filler0"), (5, "w1 w2 w3 filler0"), (5, "w1 w2 w3 filler0"), (None, None), (7, ""), (8, "!!"), (9, "w1 " * 30_000)], vocabulary


@pytest.mark.parametrize("block,top,slab", [(1000, 50, 256), (4, 3, 5)])
def test_search_is_brute_force(spark, monkeypatch, block, top, slab):
    monkeypatch.setattr(L, "ITEM_BLOCK", block)
    monkeypatch.setattr(L, "SLAB", slab)
    rng = random.Random(block)
    docs, vocabulary = some_documents(rng, 300)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8)))) for i in range(12)] + [(100, None), (101, "unseen"), (102, "?!"), (None, "w5 w6"), (103, "W5 w5 w6 w6 w6"), (104, "w1")]
    assert found(spark, docs, items, top) == brute(docs, items, top)


def test_integer_sums_are_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs, vocabulary = some_documents(rng, 60)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(6))) for i in range(5)]
    expected = found(spark, docs, items)
    monkeypatch.setattr(L, "_EXACT", 0)  # as if doubles could not hold the sums
    assert found(spark, docs, items) == expected == brute(docs, items, L.TOP)


def test_awkward_tables(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "the cat sat"), (1, "le chat"), (None, None)], "item_id long, text string")
    assert L.search(nothing, items).count() == 0 and L.search(awkward, items.where("1 = 0")).count() == 0
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in L.search(awkward, items).collect())
    assert got == brute([(r.doc_id, r.text) for r in awkward.collect()], [(1, "the cat sat"), (1, "le chat")], L.TOP)
