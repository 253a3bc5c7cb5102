"""The pipeline's near-duplicate stage against brute-force Jaccard, on texts edited word by word."""

from __future__ import annotations

import random

import numpy as np
import pytest

from quizmill.llm import simhash


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(rng, words, low, high):
    """A copy with words replaced one by one until its similarity lies in the range."""
    own, places = list(words), rng.sample(range(len(words)), len(words))
    for i in places:
        own[i] = f"new{rng.random()}"
        if low <= jaccard(shingles(" ".join(words)), shingles(" ".join(own))) < high:
            return " ".join(own)
    raise AssertionError


def kept(texts):
    sets = [shingles(t) for t in texts]
    home = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                old, new = max(home[i], home[j]), min(home[i], home[j])
                home = [new if h == old else h for h in home]
    return {i for i, h in enumerate(home) if h == i}


def test_sketches_never_differ_in_more_bits_than_sets():
    rng = np.random.default_rng(3)
    for n, m, both in [(0, 0, 0), (1, 0, 0), (5, 3, 40), (40, 90, 150), (2000, 1500, 9000)]:
        h = np.unique(rng.integers(0, 2**63, n + m + both, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        rng.shuffle(h)
        a, b = np.sort(h[: n + both]), np.sort(np.concatenate([h[n : n + both], h[n + both :]]))
        apart = int(np.bitwise_count(simhash.parity_sketch(a) ^ simhash.parity_sketch(b)).sum())
        assert apart <= n + m and apart % 2 == (n + m) % 2
    sizes = np.array([1, 10, 45, 90, 100])
    for n in sizes:  # two sets of n and m elements that share k
        for m in sizes:
            for k in range(min(n, m) + 1):
                if k * 5 >= 4 * (n + m - k):
                    assert n + m - 2 * k <= simhash.most_unshared(np.array([n]), np.array([m]), 0.8)[0]


@pytest.mark.parametrize("common, radius", [(2, None), (8, None), (4, 64)])
def test_near_copies_are_those_of_brute_force(spark, monkeypatch, common, radius):
    monkeypatch.setattr(simhash, "COMMON", common)
    rng = random.Random(5)
    texts = []
    for low in (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.82, 0.85, 0.9, 0.95):
        for _ in range(8):
            words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([250, 400]))]
            texts += [" ".join(words), edited(rng, words, low, min(low + 0.05, 0.99))]
    # one source: long boilerplate that all share, and a cluster of copies of one text, edited each in its own way
    boiler = [f"b{i}" for i in range(120)]
    texts += [" ".join(boiler + [f"own{k}x{i}" for i in range(50)]) for k in range(30)]
    base = [f"c{i}" for i in range(300)]
    texts += [edited(rng, base, 0.81, 0.9) for _ in range(20)]
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs, radius=radius).collect()} == kept(texts)
