"""The audit against one simulation of each order, and on awkward tables."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from quizmill.llm import filter_audit as A


def fails(docs):
    """The failed filters of each row (doc_id, text, lang)."""
    out = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        out.append({
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs),
        })
    return out


def simulate(docs, labels):
    failed, marks, rows = fails(docs), {}, {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (0, 0))
        marks[i] = (max(good, int(q == 1)), max(toxic, int(t == 1)))
    for part in {lang or "" for _, _, lang in docs}:
        here = [(d, f) for d, f in zip(docs, failed, strict=True) if (d[2] or "") == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, x in enumerate(order, 1):
                out = [(d, f) for d, f in left if f[x]]
                left = [(d, f) for d, f in left if not f[x]]
                removed_by[x] += len(out)
                mark = [marks.get(d[0], (0, 0)) if d[0] is not None else (0, 0) for d, _ in out]
                rows[part, "".join(order), step] = [len(left), len(out), sum(f[x] for _, f in here) - len(out) - sum(f[x] for _, f in left), sum(f[x] and sum(f.values()) == 1 for _, f in here), sum(m[0] for m in mark), sum(m[1] for m in mark)]
        for (p, order, step), v in rows.items():
            if p == part:
                v.append(removed_by[order[step - 1]])
    return rows


def same(spark, docs, labels):
    got = A.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == simulate(docs, labels)
    assert len(got) == 600 * len({d[2] or "" for d in docs})


def test_audit_is_a_simulation_of_every_order(spark):
    long = " ".join(f"w{i}" for i in range(200))
    texts = [long, long, long + " #", "short", "short", "", None, "SHOUT", long.upper(), "a " * 300, "a " * 300 + "|", " \t\x0b " + long, "é" * 33 + "A", "é" * 32 + "A", long + " x"]
    docs = [(k, t, ["en", "", None, "fr"][k % 4]) for k, t in enumerate(texts)] + [(None, "short", "en"), (3, "short", "fr"), (None, None, None), (50, long, "de"), (50, long, "de")]
    labels = [(0, 1, 0), (1, 1, 1), (3, 0, 1), (3, 1, None), (4, None, None), (None, 1, 1), (50, 1, 1), (8, 1, 0), (999, 1, 1)]
    same(spark, docs, labels)


def test_intervals_are_the_orders_with_a_prefix():
    orders = ["".join(p) for p in permutations("ABCDE")]
    for n in range(1, 6):
        for p in permutations("ABCDE", n):
            at = [k for k, o in enumerate(orders) if o.startswith("".join(p))]
            assert at[0] == A.lehmer_rank("".join(p)) and at == list(range(at[0], at[-1] + 1))


def test_awkward_tables(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert A.filter_audit(nothing, labels).count() == 0
    docs = [(r.doc_id, r.text, r.lang) for r in awkward.collect()]
    same(spark, docs, [(1, 1, 0)])
    assert A.filter_audit(awkward, labels.where("1 = 0")).count() == 600 * len({d[2] or "" for d in docs})
