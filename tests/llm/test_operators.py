"""The operators on awkward tables, and against brute force, the tokenizer's own library, or held-out labels."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quizmill.llm import chat, components, decontaminate, exact_dedup, hmm, langid, licenses, pieces, quality, queries, simhash, suffix_dedup
from quizmill.llm.common import fold
from tests.compare import connect, same


def fold_of(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def held(docs, n=10):
    return docs.select("doc_id", (fold("doc_id", n) == 0).alias("held"), "text")


def fixed_model(spark):
    return {"langs": ["en", "fr"], "theta": np.full((2, langid.vocabulary(pieces.default_model()).size), 1e-4), "path": pieces.default_model(), "id": "fixed"}


def operators(spark):
    items = spark.createDataFrame([(1, "le chat est sur la table et le chien dort"), (None, "x"), (2, None), (3, "too short")], "item_id long, text string")
    slim = lambda d: d.withColumn("lang_pred", F.lit("x"))
    return {
        "exact": lambda d: exact_dedup.exact_duplicates(d),
        "drop exact": exact_dedup.drop_exact_duplicates,
        "pieces": lambda d: pieces.decode_pieces(pieces.encode_pieces(d, pieces.default_model()), pieces.default_model()),
        "digests": lambda d: pieces.piece_digests(d, pieces.default_model()),
        "langid": lambda d: langid.predict_languages(slim(d), langid.train_languages(slim(d), pieces.default_model())),
        "quality": lambda d: quality.score_quality(d, quality.train_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality")))),
        "simhash": lambda d: simhash.near_duplicates(d),
        "drop near": simhash.drop_near_duplicates,
        "licenses": licenses.scan_licenses,
        "decontaminate": lambda d: decontaminate.contained_items(d, items),
        "drop leaks": lambda d: decontaminate.decontaminate(d, items),
        "hmm": lambda d: hmm.score_texts(held(d)),
        "suffix": lambda d: suffix_dedup.remove_repeats(d),
        "chat": lambda d: chat.repair_roles(d.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"})),
    }


PER_ROW = {"exact", "pieces", "digests", "langid", "quality", "simhash", "licenses", "hmm", "suffix", "chat"}
NAMES = ["exact", "drop exact", "pieces", "digests", "langid", "quality", "simhash", "drop near", "licenses", "decontaminate", "drop leaks", "hmm", "suffix", "chat"]


@pytest.mark.parametrize("name", NAMES)
def test_awkward_tables(spark, awkward, nothing, name):
    run = operators(spark)[name]
    assert run(nothing).count() == 0
    rows = run(awkward).collect()
    if name in PER_ROW:
        assert len(rows) == awkward.count()
    if name.startswith("drop"):
        given = awkward.collect()
        assert run(awkward).schema == awkward.schema and rows and all(r in given for r in rows)


def test_registered_queries_match_sql(spark, sf_dir):
    duck = connect(sf_dir)
    for name, sql in queries.oracle_sql().items():
        same(queries.queries()[name](spark, sf_dir), duck, sql)


def test_native_plans(spark, awkward):
    for name in ("licenses", "decontaminate"):
        plan = operators(spark)[name](awkward)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name


# ---- 1


def turn_number(role):
    name = (role or "").strip().lower()
    name = chat.ALIASES.get(name, name)
    return chat.ROLES.index(name) + 1 if name in chat.ROLES else 0


def cheapest_way(roles):
    """Cost and states of the cheapest repair; of equals the one whose states, read backwards, are the smallest."""
    ways = {0: (0, ())}
    for r in roles:
        following = {}
        for before, after, cost, _, _ in chat.moves(r):
            if before in ways:
                total, path = ways[before]
                new = (total + cost, (after, *path))
                following[after] = min(following.get(after, new), new)
        ways = following
    cost, path = min(ways.values())
    return cost, list(path[::-1])


def test_choice_does_not_depend_on_cuts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        roles = rng.integers(0, 4, rng.integers(1, 12))
        cost, expected = cheapest_way(roles)
        for cuts in ([], [len(roles) // 2], sorted(rng.integers(0, len(roles) + 1, 3)), range(len(roles))):
            parts = [p for p in np.split(roles, cuts) if len(p)]
            ends = chat.chain([chat.run_of(p) for p in parts])
            got = [chat.walk(p, np.array([len(p)]), np.array([a]), np.array([b])) for p, (a, b) in zip(parts, ends, strict=True)]
            assert np.concatenate(got).tolist() == expected
        whole = chat.walk(np.concatenate([roles, roles]), np.array([len(roles)] * 2), np.array([0, 0]), np.array([chat.FREE] * 2))
        assert whole.tolist() == expected * 2


@pytest.mark.parametrize("run_turns", [3, 4096])
def test_chat_repair_is_cheapest(spark, monkeypatch, run_turns):
    monkeypatch.setattr(chat, "RUN_TURNS", run_turns)
    rng, data = random.Random(3), []
    for c in range(60):
        data += [(c, t, rng.choice(["user", "assistant", "system", "Human", None, "x"]), rng.choice(["a", "", None, "b <|end|>"])) for t in range(rng.randint(1, 7))]
    data += [(None, None, None, None), (None, None, None, None)] + [(99, t % 3 or None, "user", "q") for t in range(30)] + [(7, 1, "user", "x" * 300_000)]
    data += [(77, t, rng.choice(["user", "assistant", "x"]), f"t{t}") for t in range(400)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("run", F.lit(1)).withColumn("r", F.lit(1)).withColumn("part", F.lit(1)).repartition(3)
    repaired = chat.repair_roles(df)
    got = sorted(repaired.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.place))
    assert len(got) == len(data)
    assert chat.repair_roles(df.where("1 = 0")).count() == 0
    last = lambda x: (x is None, x if x is not None else 0)
    text = lambda x: (x is None, x or "")
    for c in {row[0] for row in data}:
        rows = sorted((row for row in data if row[0] == c), key=lambda row: (last(row[1]), text(row[2]), text(row[3])))
        own = [r for r in got if r.conv_id == c]
        cost, states = cheapest_way([turn_number(row[2]) for row in rows])
        assert [(r.turn, r.role, r.place, r.last) for r in own] == [(row[1], row[2], i + 1, i + 1 == len(rows)) for i, row in enumerate(rows)]
        assert sum(r.cost for r in own) == cost and [r.new_role for r in own] == [chat.ROLES[s - 1] for s in states]
        whole = "".join(r.rendered for r in own)
        heads = [h for h in re.findall(r"<\|(\w+)\|>\n", whole) if h != "end"]
        assert heads[0] != "assistant" and "system" not in heads[1:] and all(a != b for a, b in pairwise(heads))
        assert len(heads) == sum(r.action != "merge" for r in own) + sum(len(r.inserted) for r in own) == whole.count("<|end|>")
        assert sum(r.rendered.count("b <\\|end|>") for r in own) == sum(row[3] == "b <|end|>" for row in rows)
        parts = sorted(chat.conversation_texts(repaired).where(F.col("conv_id").eqNullSafe(c)).collect(), key=lambda r: r.part) if c in (None, 7, 77) else []
        assert not parts or "".join(r.text for r in parts) == whole and [r.part for r in parts] == list(range(len(parts)))


# ---- 2, 8


def test_quality_on_held_out_labels(spark, sf_dir):
    r = queries.queries()["op2_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    r = r[r.held_out]
    good, bad = r.score[r.quality == 1].to_numpy(), r.score[r.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9


def test_quality_is_a_softmax_over_averaged_vectors(spark):
    texts, labels, dims, steps, rate = ["a b b", "zz top", "", "b a zz"], np.array([0, 1, 1, 0]), 3, 7, 0.5
    priors = np.array([0.75, 0.25])
    # the same numbers to begin with and the same order; everything else is done one vector at a time
    rng = np.random.default_rng(7)
    embed = rng.uniform(-1 / dims, 1 / dims, (quality.BUCKETS, dims))
    out, bias, done = np.zeros((dims, 2)), np.zeros(2), 0

    def hidden_of(text):
        at = quality.features(text)
        return sum((embed[k] for k in at), np.zeros(dims)) / max(1, len(at))

    while done < steps:
        for i in rng.permutation(4)[: steps - done]:
            lr, at = rate * (1 - done / steps), quality.features(texts[i]).tolist()
            done += 1
            hidden = hidden_of(texts[i])
            odds = np.exp(hidden @ out + bias)
            error = odds / odds.sum() - np.eye(2)[labels[i]]
            back = out @ error
            out, bias = out - lr * np.outer(hidden, error), bias - lr * error
            for k in set(at):
                embed[k] -= lr * math.sqrt(len(set(at))) * at.count(k) / len(at) * back
    model = quality.train([quality.bag(t) for t in texts], labels, priors, dims, steps, rate)
    seen = np.array([0.5, 0.5])
    got = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame([(str(i), t) for i, t in enumerate([*texts, None, "new b words zz"])], "doc_id string, text string"), model).collect()}
    for i, t in enumerate([*texts, None, "new b words zz"]):
        odds = np.exp(hidden_of(t) @ out + bias) * (priors / seen)
        assert math.isclose(got[str(i)], odds[1] / odds.sum(), rel_tol=1e-4)


def test_language_on_held_out_documents(spark, sf_dir, documents):
    r = queries.queries()["op8_langid"](spark, sf_dir).join(documents.select("doc_id", "lang"), "doc_id").toPandas()
    assert (r.lang == r.lang_pred)[r.held_out].mean() > 0.97 and r.score.between(0, 1).all()


def segmentations(voc, word):
    """All ways to cut a word into pieces of the model's own list, as lists of pieces; a strange character stands alone."""
    model = pieces.piece_model(pieces.default_model())
    known = {p for p in model.ids if p == p.lower() and (p == pieces.MARK or p.lstrip(pieces.MARK).isalpha() and p.count(pieces.MARK) <= 1)}
    marked = pieces.MARK + word
    ways = [[] for _ in range(len(marked) + 1)]
    ways[0] = [[]]
    for end in range(1, len(marked) + 1):
        for start in range(end):
            piece = marked[start:end]
            if piece in known or end == start + 1:
                ways[end] += [[*w, piece] for w in ways[start]]
    return ways[-1]


def piece_id(voc, piece):
    keys, ids = voc.by_length[len(piece)]
    h = 0
    for c in piece:
        h = (h * int(voc.base) + ord(c)) % 2**64
    at = np.searchsorted(keys, np.uint64(h))
    return int(ids[at]) if at < len(keys) and int(keys[at]) == h else voc.unknown


def test_forward_sums_all_segmentations():
    voc = langid.vocabulary(pieces.default_model())
    theta = np.random.default_rng(0).uniform(1e-4, 1e-2, (voc.size, 2))
    words = ["the", "a", "zß", "bonjour", "qqqqqqqqqq", "information", "responsibilities", "हिन्दी", "cafe\u0301"]
    lattice = langid.Lattice(voc, words)
    assert voc.longest > 7 and any(len(p) >= 8 for w in words for way in segmentations(voc, w) for p in way)
    got = lattice.log_sums(langid.with_none(theta))
    used = [lattice.expected(langid.with_none(theta)[:, k], np.ones(len(words)))[:-1] for k in range(2)]
    for k in range(2):
        counts = np.zeros(voc.size)
        for w, word in enumerate(words):
            ways = [[piece_id(voc, p) for p in way] for way in segmentations(voc, word)]
            odds = np.array([np.prod(theta[way, k]) for way in ways])
            assert np.isclose(got[w, k], math.log(odds.sum()))
            for way, p in zip(ways, odds / odds.sum(), strict=True):
                np.add.at(counts, way, p)
        assert np.allclose(used[k], counts)


def test_words_keep_their_marks(spark):
    assert langid.words_of("हिन्दी भाषा में, cafe\u0301 x_y ab12cd \u0301 หนี้") == ["हिन्दी", "भाषा", "में", "cafe\u0301", "x", "y", "ab", "cd", "หนี้"]
    assert langid.words_of("\u0301\u093f \U0001e8d0") == [] and langid.words_of("a\U0001e8d0b") == ["a\U0001e8d0b"]
    for text in ("Über-große Wörter, naïve 12 façades", "x" * 50, "日本語 テキスト", ""):
        assert langid.words_of(text) == re.findall(r"[^\W\d_]+", text.lower())
    voc = langid.vocabulary(pieces.default_model())
    whole = [p for p in pieces.piece_model(pieces.default_model()).pieces if any(c in langid.MARKS for c in p)]
    assert sum(piece_id(voc, p) != voc.unknown for p in whole if len(p) <= voc.longest) > 100
    rows = [(i, "हिन्दी भाषा में लिखा" if i % 2 else "मराठी भाषेत लिहिले आहे", "hi" if i % 2 else "mr") for i in range(20)]
    docs = spark.createDataFrame([*rows, (99, "\u0301 \u093f", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_languages(docs, langid.train_languages(docs, pieces.default_model())).collect()}
    assert got == {i: k for i, _, k in rows} | {99: "und"}
    none = langid.train_languages(docs.where("doc_id = 99"), pieces.default_model())
    assert none["langs"] == [] and [r.lang_pred for r in langid.predict_languages(docs.limit(1), none).collect()] == ["und"]


def test_long_words_are_whole_and_do_not_underflow():
    voc = langid.vocabulary(pieces.default_model())
    theta = np.stack([np.full(voc.size, 1e-9), np.random.default_rng(1).uniform(1e-6, 1e-3, voc.size)], 1)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdehiorstuß") for _ in range(n)) for n in (60, 41, 700, 3000, 8)]
    lattice = langid.Lattice(voc, words)
    got = lattice.log_sums(langid.with_none(theta))
    for w, word in enumerate(words):
        marked = pieces.MARK + word
        for k in range(2):
            logs = [0.0]
            for end in range(1, len(marked) + 1):
                terms = [logs[start] + math.log(theta[at, k]) for start in range(max(0, end - voc.longest), end) if (at := piece_id(voc, marked[start:end])) != voc.unknown or end == start + 1]
                top = max(terms)
                logs.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            assert np.isclose(got[w, k], logs[-1], rtol=1e-9)
    lengths = np.zeros(voc.size)
    for n, (_, ids) in voc.by_length.items():
        lengths[ids] = n
    lengths[voc.unknown] = 1
    for k in range(2):
        assert np.isclose((lattice.expected(langid.with_none(theta)[:, k], np.ones(len(words)))[:-1] * lengths).sum(), sum(len(w) + 1 for w in words))


def test_undetermined(spark):
    docs = spark.createDataFrame([(1, None), (2, "12 !?"), (3, "a"), (4, "½ ²")], "doc_id long, text string")
    rows = {r.doc_id: r for r in langid.predict_languages(docs, fixed_model(spark)).collect()}
    assert rows[1].lang_pred == rows[2].lang_pred == rows[4].lang_pred == "und" and rows[1].score == 0.0 and rows[3].lang_pred == "en"


# ---- 3


def brute_force_repeats(docs, window=50):
    first, out = {}, {}
    for i, text in sorted(docs, key=lambda d: d[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - window + 1):
            if first.setdefault(raw[k : k + window], i) < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("block", "hot"), [(700, 12), (700, 1), (2_000_000, 12)])
def test_repeats_match_brute_force(spark, monkeypatch, block, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(block)
    shared = ["".join(rng.choice("ab ") for _ in range(n)) for n in (49, 50, 51, 90, 200)] + ["abc" * 60, "é" * 40]
    docs = [(i, "".join(rng.choice([rng.choice(shared), "".join(rng.choice("abcdefg ") for _ in range(rng.randint(0, 60)))]) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    rng.shuffle(docs)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_force_repeats(docs)


# ---- 4


def test_fingerprint_is_the_bitwise_majority(spark):
    text = "A b c d e A b c d e f"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), seed=42) for i in range(len(words) - 3)]
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
    assert simhash.fingerprint(" \t") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("x Y") == xxhash.xxh64_intdigest("x y", seed=42)


def test_close_lanes_counts_bits():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    for i in range(1, 300, 2):  # near ones
        fps[i] = fps[i - 1] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 9)).astype(np.uint64))
    for radius in (0, 3, 4, 7, 9):
        got = simhash.local_links(fps, np.zeros(300, np.int64), radius)
        label = np.arange(300)
        for _ in range(300):
            old = label.copy()
            near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
            label = np.array([label[near[i]].min() for i in range(300)])
            if (old == label).all():
                break
        assert (got == label).all()


@pytest.mark.parametrize("chunk", [8, 2048])
def test_links_lose_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = np.unique(np.array([b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k).astype(np.uint64)) for b in base for k in rng.integers(1, 7, 25)], np.uint64))
    points = spark.createDataFrame([(int(f.view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    named = {r.node: r.component for r in components.connected_components(simhash.link(points, 4)).collect()}
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 4
    label = np.arange(len(fps))
    for _ in fps:
        label = np.array([label[near[i]].min() for i in range(len(fps))])
    assert [named.get(i, i) for i in range(len(fps))] == label.tolist()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 100)] + [(None, 1), (2, 2)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    assert got == {x: find(x) for x in up}


# ---- 5


def test_base_scores_match_a_count(spark, documents):
    got = {r.doc_id: r for r in hmm.score_texts(held(documents)).collect()}
    docs = [(r.doc_id, r.text.encode().lower().split() + [None]) for r in documents.select("doc_id", "text").collect()]
    counts = Counter(w for i, words in docs if fold_of(i, 10) for w in words)
    total, norm = sum(counts.values()), math.log10(sum(counts.values()) + 0.1 * (len(counts) + 1))
    for i, words in docs:
        assert math.isclose(got[i].base_score, sum(math.log10(counts[w] + 0.1) - norm for w in words), rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(words), sum(counts[w] > 0 for w in words), total, fold_of(i, 10) == 0)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_order_and_blocks_do_not_matter(spark, documents, monkeypatch):
    some = held(documents.where("doc_id % 2 = 0"))
    one = {r.doc_id: r.score for r in hmm.score_texts(some.coalesce(1)).collect()}
    monkeypatch.setattr(hmm, "BLOCK_DOCS", 30)
    other = {r.doc_id: r.score for r in hmm.score_texts(some.repartition(3, "doc_id").sortWithinPartitions(F.desc("doc_id"))).collect()}
    assert one.keys() == other.keys() and all(math.isclose(one[i], other[i], rel_tol=1e-4) for i in one)


def test_forward_and_counts_match_all_paths():
    rng = np.random.default_rng(2)
    model = {"start": rng.dirichlet(np.ones(3)), "trans": rng.dirichlet(np.ones(3), 3), "emit_t": rng.dirichlet(np.ones(hmm.BUCKETS), 3).T.copy()}
    sizes, classes = np.array([2, 0, 4]), rng.integers(1, hmm.BUCKETS, 6)
    packed = hmm.Packed(classes, sizes)
    logs, (first, moved, emitted) = packed.forward(model), packed.expected_counts(model)
    total_moves, total_first = np.zeros((3, 3)), np.zeros(3)
    for k, seq in enumerate(([*classes[:2], 0], [0], [*classes[2:], 0])):
        paths = [[s] for s in range(3)]
        for _ in seq[1:]:
            paths = [[*p, s] for p in paths for s in range(3)]
        weight = np.array([model["start"][p[0]] * np.prod([model["trans"][a, b] for a, b in pairwise(p)]) * np.prod([model["emit_t"][o, s] for o, s in zip(seq, p, strict=True)]) for p in paths])
        assert np.isclose(logs[k], np.log(weight.sum()))
        for p, w in zip(paths, weight / weight.sum(), strict=True):
            total_first[p[0]] += w
            for a, b in pairwise(p):
                total_moves[a, b] += w
    assert np.allclose(first, total_first) and np.allclose(moved, total_moves) and np.isclose(emitted.sum(), len(classes) + 3)


# ---- 6


def test_same_ids_text_and_offsets_as_the_library(documents):
    import sentencepiece

    model, library = pieces.piece_model(pieces.default_model()), sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(4)
    texts = [r.text for r in documents.select("text").collect()] + ["", " ", "a  b", "▁a▁", "é😀x", "x" * 3000, "<s></s><0x41>", "　", "日本語 テスト", "áb"]
    texts += ["".join(rng.choice(" ab▁é\n😀tÿ中.,'1") for _ in range(rng.randint(0, 160))) for _ in range(800)]
    for text in texts:
        ids, ends = model.encode(text)
        assert ids.tolist() == library.encode(text, add_eos=True)
        assert model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert ends[-1] == len(text.encode()) and (np.diff(ends) >= 0).all()
    # byte borders: plain and byte-fallback pieces
    for text in ("the cat", "a é ß", "x 😀 y", "▁ a"):
        src, at = text.encode(), 0
        ids, ends = model.encode(text, end=False)
        said = b""
        for i, e in zip(ids.tolist(), ends.tolist(), strict=True):
            said += src[at:e]
            at = max(at, e)
        assert said == src


def test_character_map_keeps_offsets():
    model = pieces.PieceModel(pieces.default_model())
    model.rules, model.longest_rule, model.first = {"ﬁ".encode(): b"fi", "①".encode(): b"1"}, 3, re.compile("[ﬁ①]")
    ids, ends = model.encode("ﬁn ①2", end=False)
    assert model.decode(ids.tolist()) == "fin 12" and ends[-1] == len("ﬁn ①2".encode())


# ---- 7, 9, 10


def test_licenses(spark):
    text = "Intro. Redistribution and use in source and binary forms, with or without any modification, are permitted provided that the following conditions are met: x"
    docs = spark.createDataFrame([(1, "MIT license mit LICENSE"), (2, text), (3, "the license"), (4, None), (5, "Licensed under the Apache-License, version 2.0")], "doc_id long, text string")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels, rows[1].n_words) == (2, 0, 2, "mit", 4)
    assert rows[2].labels == "bsd-text" and 0.6 <= rows[2].score < 1 and rows[2].base_labels == "" and rows[2].first_word is None
    assert rows[3].labels == rows[4].labels == "" and rows[4].n_words == 0
    assert rows[5].labels == "apache,apache-2.0"


def license_labels(spark, texts):
    rows = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [set(r.labels.split(",")) - {""} - set(r.base_labels.split(",")) for r in sorted(rows, key=lambda r: r.doc_id)]


def test_similar_licenses_are_told_apart(spark):
    notice = "You can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version"
    grant = "This work is licensed under the GNU General Public License, version {}."
    mit = licenses.TEMPLATES[1][0]
    half = mit.split()
    texts = [
        *(notice.format(x) for x in ("", "Lesser ", "Affero ")), *(grant.format(x) for x in (2, 3, 1)),
        notice.format("").replace("under the terms", "at your option and risk under the terms"),
        "intro " + " ".join(half[:60] + ["some", "words", "more", "here"] + half[60:]) + " outro",
        "released under the mit license. Released under the MIT license", "Licensed under CC BY-NC 4.0", "licensed under cc by 4.0", "Licensed under the Apache License, version 1.1",
        "permission is granted to any person",
    ]
    assert license_labels(spark, texts) == [{"gpl-text"}, {"lgpl-text"}, {"agpl-text"}, {"gpl-2.0"}, {"gpl-3.0"}, set(), {"gpl-text"}, {"mit-text"}, set(), {"cc-by-nc-4.0"}, {"cc-by-4.0"}, set(), set()]


def test_equal_texts_keep_one(spark):
    docs = spark.createDataFrame([(3, "A b"), (1, "a B"), (2, "É"), (5, "é"), (7, None), (8, "")], "doc_id long, text string")
    rows = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs).collect()}
    assert rows[1].keep_id == 3 and not rows[1].kept and rows[1].group_size == 2 and rows[2].kept and rows[5].kept
    assert rows[7].keep_id == 8 and rows[7].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in exact_dedup.exact_duplicates(docs, keep="min").where("kept").collect()} == {1, 2, 5, 7}


@pytest.mark.parametrize("limit", [0, 200_000])
def test_containment_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))) for i in range(30)] + [(100 + k, " ".join(words[k : k + k])) for k in range(5)]
    docs = []
    for i in range(80):
        w = [rng.choice(words) for _ in range(rng.randint(0, 300))]
        own = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            if own:
                own[rng.randrange(len(own))] = "edited"
        docs.append((i, " ".join(w[:100] + own + w[100:]).upper() + "."))
    docs += [(200, "so W3 w4, w5!"), (201, "w4 w5"), (202, "w1 w1 w3 w2"), (203, None), (204, "w2 w3 w3 w4 w5 w4 w5 w6 w7")]

    def grams(text, n):
        w = re.findall("[a-z0-9]+", (text or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    expected = {}
    for i, y in items:
        n = min(5, len(y.split()))
        for d, x in docs:
            found = len(grams(x, n) & grams(y, n))
            if n and found / len(grams(y, n)) >= 0.8:
                expected[d, i] = found
    assert {(200, 103), (201, 102), (202, 101)} & set(expected) == {(200, 103), (202, 101)} and (204, 104) in expected
    got = decontaminate.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.n_shared for r in got} == expected and expected


def test_decontamination_judges_rows(spark):
    item = "one two three four five six seven"
    rows = [(None, f"so {item} it is"), (1, f"again {item}"), (1, "clean text that shares an id"), (None, "capital of France, Paris!"), (2, None), (2, None), (3, "")]
    items = spark.createDataFrame([(1, item), (2, "capital of france paris"), (3, ""), (4, None)], "item_id long, text string")
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([rows[2], rows[4], rows[5], rows[6]])


def test_groups_are_whole(documents):
    rows = simhash.near_duplicates(documents).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    ids = sorted(fps)
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert {r.doc_id: r.component_id for r in rows} == {i: find(i) for i in ids}
