"""The pipeline on a small corpus, against a plain version of each stage's decision."""

from __future__ import annotations

import re
from pathlib import Path

import corpus_pipeline as P
from quizmill.llm import pieces


def word_shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stages(spark, sf_dir, documents):
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = documents.unionByName(spark.createDataFrame([(10**9, None, None, "x", 0), (10**9 + 1, "123 !", "en", "x", 5)], documents.schema))
    shingles = lambda t: {tuple(x) for x in zip(*[re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())[k:] for k in range(5)], strict=False)}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        if name != "sentencepiece":
            assert out.columns == docs.columns, name
        after = {r.doc_id: r for r in out.collect()}
        gone = before.keys() - after.keys()
        if name == "language_id":
            assert gone == {10**9, 10**9 + 1}
        elif name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last["".join(c.lower() if c.isascii() else c for c in before[i].text)] = i
            assert set(after) == set(last.values())
        elif name == "simhash_near_dedup":
            sets = {i: word_shingles(r.text) for i, r in before.items()}
            component = {i: i for i in before}
            for i in sorted(before):
                for j in sorted(before):
                    if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                        old, new = max(component[i], component[j]), min(component[i], component[j])
                        component = {k: new if c == old else c for k, c in component.items()}
            assert set(after) == {i for i in before if component[i] == i} and len(after) < len(before)
        elif name == "decontamination":
            leaks = {i for i, r in before.items() if any(len(shingles(r.text) & s) >= 0.8 * len(s) for s in map(shingles, items) if s)}
            assert gone == leaks
        else:
            model = pieces.piece_model(pieces.default_model())
            assert not gone and all(r.ids == model.encode(before[i].text)[0].tolist() and r.decoded == before[i].text and r.n_tokens == len(r.ids) for i, r in after.items())
        docs = out


def test_run_is_all_stages(spark, sf_dir):
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.glob("*"))
    rows = P.run(spark, sf_dir)
    assert {p.name.split("-")[0] for p in set(shared.glob("*")) - before} == {"sentencepiece"}
    assert rows.count() > 0 and "ids" in rows.columns
