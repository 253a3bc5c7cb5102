"""SimHash near-duplicates: candidates that share bit blocks, compared bit plane by bit plane.

Where a similarity of shingles is asked for, fingerprints only propose pairs; the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain as joined
from itertools import combinations
from math import acos, ceil, comb, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_saved, free_name, sample_key, save, table
from .components import connected_components, hook

#: Rows of a bucket that one task compares with one another; larger buckets are compared chunk by chunk.
CHUNK = 2048
#: Points in a bucket on average, above which fingerprints are cut into more blocks.
BUCKET = 256
#: Pairs of (row, word of 64 rows) that are compared at once.
SLAB = 1 << 15
#: One row in so many is looked at for common shingles; how often one must stand there to count as common, and how many count.
SAMPLE, COMMON, MOST_COMMON = 32, 4, 200_000
#: Columns of a parity sketch, 64 bits each.
SKETCH = ["s0", "s1", "s2", "s3"]


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of words, in order; a text of fewer words is one run; no words: none."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    n = max(1, len(words) - shingle + 1)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """64 bits: each is set if it is set in more than half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for part in range(0, n, 8192):
        counts += np.unpackbits(hashes[part : part + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: each is set if it is set in more than half of the shingles' XXH64 (seed 42); no words: 0."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id and ``fp`` (the 64 bits as a signed long), row by row."""

    def run(batches):
        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def close_lanes(queries: np.ndarray, words: np.ndarray, planes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a query fingerprint and a word of 64 lanes: which lanes are within the radius.

    ``planes[p, w]`` has bit p of the 64 fingerprints of word w.  Distances of all lanes grow together in carry-save
    counters; every 8 planes, pairs whose 64 lanes all exceed the radius are abandoned.  Returns the positions of the
    pairs that are left and a 64-bit mask of close lanes for each.
    """
    bits = radius.bit_length() + 1
    alive = np.arange(len(queries))
    counters = [np.zeros(len(alive), np.uint64) for _ in range(bits)]
    over, full = np.zeros(len(alive), np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)

    def exceeded() -> np.ndarray:
        above, equal = over.copy(), np.full(len(alive), full)
        for k in range(bits - 1, -1, -1):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return above

    for p in range(0, 64, 2):
        x = planes[p, words] ^ (np.uint64(0) - (queries >> np.uint64(p) & np.uint64(1)))
        y = planes[p + 1, words] ^ (np.uint64(0) - (queries >> np.uint64(p + 1) & np.uint64(1)))
        half = counters[0] ^ x
        carry = (counters[0] & x) | (half & y)
        counters[0] = half ^ y
        for k in range(1, bits):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 6 or p == 62:
            keep = exceeded() != full
            if not keep.all():
                alive, queries, words, over = alive[keep], queries[keep], words[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(alive):
                break
    return alive, ~exceeded()


def close_pairs(fps: np.ndarray, groups: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``groups`` is sorted.  All pairs of rows of one group within the radius, a < b, slab by slab."""
    first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    size = np.diff(np.append(first, len(fps)))
    n_words = (size + 63) // 64
    word_of_group = np.cumsum(n_words) - n_words
    inside = np.arange(len(fps)) - np.repeat(first, size)
    lane = np.repeat(word_of_group, size) * 64 + inside
    lanes = np.zeros(int(n_words.sum()) * 64, np.uint64)
    lanes[lane] = fps
    row_of = np.full(len(lanes), -1, np.int64)
    row_of[lane] = np.arange(len(fps))
    planes = np.packbits(np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.copy(), axis=1, bitorder="little").view("<u8")
    # a row is compared with the words from its own onwards
    todo = np.repeat(n_words, size) - inside // 64
    todo[np.repeat(size, size) < 2] = 0
    bounds = np.cumsum(todo)
    at = 0
    while at < len(fps):
        stop = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + SLAB, "right")))
        rows = np.repeat(np.arange(at, stop), todo[at:stop])
        step = np.arange(len(rows)) - np.repeat(np.cumsum(todo[at:stop]) - todo[at:stop], todo[at:stop])
        pairs, masks = close_lanes(fps[rows], lane[rows] // 64 + step, planes, radius)
        if len(pairs):
            hits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(hits)
            a, b = rows[pairs[k]], row_of[(lane[rows[pairs[k]]] // 64 + step[pairs[k]]) * 64 + bit]
            yield a[b > a], b[b > a]
        at = stop


def local_links(fps: np.ndarray, groups: np.ndarray, radius: int) -> np.ndarray:
    """``groups`` is sorted.  The label of each row: the first row that it reaches over links inside its group."""
    label = np.arange(len(fps))
    for a, b in close_pairs(fps, groups, radius):
        hook(label, a, b)
    return label


def link(points: DataFrame, radius: int = 4) -> DataFrame:
    """``points`` (fp, rep; distinct fps) to edges (a, b) between reps that connect all fps within the radius.

    The 64 bits are cut into blocks so that two fingerprints within the radius agree on some combination of whole
    blocks: every link falls in a bucket.  The number of blocks follows the number of points (any number gives all
    links; more blocks give smaller buckets but more of them).  Buckets of over CHUNK points are dealt in chunks, and
    every two chunks meet in one task.  Inside a task the links are reduced to a spanning forest.
    """
    n = points.count()
    agree = next((g for g in range(1, 5) if n <= BUCKET << (64 * g // (radius + g))), 5)
    blocks = radius + agree
    borders = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for pick in combinations(range(blocks), agree):
        mask = sum((1 << borders[i + 1]) - (1 << borders[i]) for i in pick)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    assert len(masks) == comb(blocks, agree)
    keyed = points.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("k", "m"))
    hot = keyed.groupBy("k", "m").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CHUNK)
    keyed = keyed.join(hot, ["k", "m"], "left")

    def out(cols, groups):
        label = local_links(cols["fp"].view(np.uint64), groups, radius)
        at = np.flatnonzero(label != np.arange(len(label)))
        return cols["rep"][at], cols["rep"][label[at]]

    return meet(keyed, ["k", "m"], ["fp", "rep"], out)


def meet(rows: DataFrame, keys: list[str], columns: list[str], compare, names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Bring the ``rows`` of a bucket (equal ``keys``, long or int) together; ``size`` is its number of rows, null if small.

    Buckets of over CHUNK rows are dealt in chunks, and every two chunks meet in one task.  ``compare`` gets the columns of
    some buckets (and ``own``, a row's chunk), and sorted group numbers, and returns the ends of edges (a, b), or columns
    of whole numbers by other ``names``.
    """
    own = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
    dealt = rows.withColumn("c", F.ceil(F.coalesce("size", F.lit(1)) / CHUNK).cast("int")).withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("c") > 1, F.sequence(F.lit(0), F.col("c") - 1)).otherwise(F.array(F.lit(0)))))
    places = [*keys, "i", "j"]
    dealt = dealt.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *columns)

    def run(batches: Iterator[pa.RecordBatch]):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            new = np.zeros(len(cols[0]), bool)
            new[0] = True
            for c in cols[: len(places)]:
                new[1:] |= c[1:] != c[:-1]
            last = int(np.flatnonzero(new)[-1])
            rest = [c[last:] for c in cols]
            yield from out([c[:last] for c in cols], np.cumsum(new[:last]))
        if rest is not None:
            yield from out(rest, np.zeros(len(rest[0]), np.int64))

    def out(cols, groups):
        if len(groups) > 1:
            made = compare(dict(zip([*places, "own", *columns], cols, strict=True)), groups)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], names=list(names))

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return dealt.repartition(parts, *places).sortWithinPartitions(*places).mapInArrow(run, ", ".join(f"{x} long" for x in names))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: doc_id, ``fingerprint`` (16 hex digits) and ``component_id``.

    Fingerprints link at ``radius`` or fewer differing bits; a component's id is the smallest doc_id in it.  Equal
    fingerprints are one point from the start, so copies cost one row.  Null and empty texts, and texts of white space,
    have fingerprint 0 and link like any other.  ``doc_id`` is a whole number.  Repeated rows are returned as often; null doc_ids take no part in the
    naming of a component, and get a null id if they are alone.  Other columns are ignored.
    """
    marked = save(fingerprints(docs, shingle), "fingerprints")
    points = save(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "points")
    named = connected_components(link(points, radius))
    home = points.join(named, points.rep == named.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return marked.join(home, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_radius(similarity: float) -> int:
    """A distance that pairs of this similarity hardly ever exceed: five deviations above the mean."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(64 * share + 5 * sqrt(64 * share * (1 - share)))


def common_shingles(rows: DataFrame, shingle: int) -> np.ndarray:
    """Hashes (sorted, as signed longs) of shingles that stand often in a sample of ``rows`` (uid, text)."""

    def run(batches):
        for b in batches:
            own = [np.unique(shingle_hashes(t, shingle)) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<u8"), *own]).view(np.int64))], names=["h"])

    seen = rows.where(sample_key("uid") < 1 / SAMPLE).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = seen.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    return np.sort(top["h"].to_numpy(np.int64))


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Four words of 64 bits: bit k tells whether an odd number of the distinct ``hashes`` end in byte k.

    A hash that two sets share changes a bit of both, so the sketches of two sets differ in no more bits than the sets have
    hashes that the other lacks.
    """
    odd = np.bincount(hashes.view(np.uint8)[7::8], minlength=64 * len(SKETCH)) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def most_unshared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many elements of two sets of this similarity or more stand in one of them only, at most."""
    return np.floor((1 - similarity) / (1 + similarity) * (n + m) + 1e-9).astype(np.int64)


def describe(rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``rows`` (uid, text) to uid, ``fp``, ``n`` (distinct shingles), a parity sketch and ``prefix``: the shingles to search with.

    Two sets of at least this Jaccard similarity share ``similarity`` of either one, so whatever order all shingles are put
    in, they share one of the first n - ceil(similarity n) + 1 of each: no pair is lost.  Common shingles come last, which
    keeps boilerplate out of the search; the sample that finds them decides about speed only.
    """
    common = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, shingle))

    def run(batches):
        hot = common.value
        for b in batches:
            fps, sizes, prefixes, sketches = [], [], [], [np.zeros(0, np.uint64)]
            for t in b.column(1).to_pylist():
                hashes = shingle_hashes(t, shingle)
                own = np.unique(hashes).view(np.int64)
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own
                    own = np.concatenate([own[~late], own[late]])
                fps.append(majority(hashes))
                sketches.append(parity_sketch(own))
                sizes.append(len(own))
                prefixes.append(own[: len(own) - ceil(similarity * len(own) - 1e-9) + 1])
            ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            parity = np.concatenate(sketches).view(np.int64).reshape(-1, len(SKETCH))
            columns = [b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(np.array(sizes, np.int32)), lists, *map(pa.array, parity.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "fp", "n", "prefix", *SKETCH])

    return rows.select("uid", "text").mapInArrow(run, "uid long, fp long, n int, prefix array<long>, " + ", ".join(f"{s} long" for s in SKETCH))


def verified(pairs: DataFrame, rows: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of uids whose sets of shingle hashes have this Jaccard similarity or more."""

    def run(batches):
        for b in batches:
            own = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int64()))], names=["uid", "s"])

    asked = pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()
    sets = save(rows.join(asked, "uid", "left_semi").select("uid", "text").mapInArrow(run, "uid long, s array<long>"), "shingle-sets")
    both = pairs.join(sets.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared"), (F.size("sa") + F.size("sb")).alias("total"))
    links = save(both.where(F.col("shared") >= F.lit(similarity) * (F.col("total") - F.col("shared")) - 1e-9).select("a", "b"), "links")
    drop_saved(sets)
    return links


def least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """How many search shingles two sets of this similarity share at least: they share similarity / (1 + similarity) of
    both sizes, and beyond the search shingles of the one whose search ends first there is only the rest of that one."""
    rest = np.ceil(similarity * np.maximum(n, m) - 1e-9) - 1
    return (np.ceil(similarity / (1 + similarity) * (n + m) - 1e-9) - rest).astype(np.int64)


def neighbours(rows: DataFrame, radius: int, similarity: float) -> DataFrame:
    """``rows`` (h, uid, n, fp) to those whose bucket (equal h) holds another, with ``centre``: the middle of the bucket, if
    it looks like the row.

    The middle is the row whose fingerprint is closest to the majority of the bucket's bits.  A bucket of any size is read
    in pieces of CHUNK rows, each with a middle of its own.  Middles only say which pairs are worth a comparison first.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        rest = before = None  # the bucket of the last row that has gone out
        for b in joined(batches, [None]):
            if b is not None:
                cols = [c.to_numpy() for c in b.columns]
                rest = cols if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            if rest is None or not len(rest[0]):
                continue
            h = rest[0]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            stop = len(h) if b is None or len(h) - start[-1] >= CHUNK else int(start[-1])
            if not stop:
                continue
            cols, rest = [c[:stop] for c in rest], [c[stop:] for c in rest]
            start = start[start < stop]
            size = np.diff(np.append(start, stop))
            several = size > 1
            several[0] |= before is not None and before == cols[0][0]
            before = cols[0][-1]
            h, uid, n, fp = (c[np.repeat(several, size)] for c in cols)
            size = size[several]
            inside = np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
            first = np.flatnonzero(inside % CHUNK == 0)  # of each piece
            for k in range(0, len(first), 4096):
                end = first[k + 4096] if k + 4096 < len(first) else len(h)
                yield pieces(*(c[first[k] : end] for c in (h, uid, n, fp)), first[k : k + 4096] - first[k])

    def pieces(h, uid, n, fp, first):
        size = np.diff(np.append(first, len(h)))
        bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        most = np.add.reduceat(bits, first, axis=0, dtype=np.int32) * 2 > size[:, None]
        middle = np.repeat(np.packbits(most, axis=1, bitorder="little").view("<u8")[:, 0], size)
        away = np.bitwise_count(fp.view(np.uint64) ^ middle).astype(np.int64) * len(h) + np.arange(len(h))
        centre = np.repeat(np.minimum.reduceat(away, first) % len(h), size)
        close = (np.bitwise_count((fp ^ fp[centre]).view(np.uint64)) <= radius) & (uid != uid[centre])
        close &= np.minimum(n, n[centre]) >= similarity * np.maximum(n, n[centre]) - 1e-9
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(uid), pa.array(n), pa.array(fp), pa.array(uid[centre], mask=~close)], names=["h", "uid", "n", "fp", "centre"])

    return rows.select("h", "uid", "n", "fp").repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, uid long, n int, fp long, centre long")


def near_links(rows: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """(node, component) of the ``rows`` (uid, text; each with a word) that have a near duplicate.

    Components are those of the graph of all pairs of at least this similarity that share a search shingle, as all such
    pairs do, and whose fingerprints lie within ``radius``.  Pairs of a row and the middle of its bucket are verified
    first.  Then fingerprints are compared bit plane by bit plane inside buckets that hold rows of more than one component,
    and the close pairs across components are verified, but for those whose parity sketches or whose number of shared search
    shingles already show that they are less similar.
    """
    described = save(describe(rows, shingle, similarity), "described")
    searched = described.select(F.explode("prefix").alias("h"), "uid", "n", "fp")
    shared = save(neighbours(searched, radius, similarity), "shared")
    first = shared.where("centre is not null").groupBy("uid", "centre").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    # pairs of one or two shingles are not worth a comparison yet; what is missed here is found below
    first = first.where(F.col("c") > F.lit((1 - similarity) / 4) * F.col("n")).select(F.greatest("uid", "centre").alias("a"), F.least("uid", "centre").alias("b"))
    named = connected_components(verified(save(first.distinct(), "pairs"), rows, shingle, similarity))

    placed = shared.join(named, F.col("uid") == F.col("node"), "left").select("h", "uid", "n", "fp", F.coalesce("component", "uid").alias("component"))
    open_ = placed.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("h", "size")
    left = placed.join(open_, "h").join(described.select("uid", *SKETCH), "uid")

    def across(cols, groups):
        found = [(np.zeros(0, np.int64),) * 2]
        for a, b in close_pairs(cols["fp"].view(np.uint64), groups, radius):
            n, m = cols["n"][a], cols["n"][b]
            ok = (cols["component"][a] != cols["component"][b]) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9)
            ok &= (cols["i"][a] == cols["j"][a]) | (cols["own"][a] != cols["own"][b])
            a, b = a[ok], b[ok]
            apart = sum(np.bitwise_count((cols[s][a] ^ cols[s][b]).view(np.uint64)).astype(np.int64) for s in SKETCH)
            ok = apart <= most_unshared(cols["n"][a].astype(np.int64), cols["n"][b].astype(np.int64), similarity)
            found.append((a[ok], b[ok]))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        need = least_shared(cols["n"][a].astype(np.int64), cols["n"][b].astype(np.int64), similarity)
        return np.maximum(cols["uid"][a], cols["uid"][b]), np.minimum(cols["uid"][a], cols["uid"][b]), need

    pairs = meet(left, ["h"], ["uid", "n", "fp", "component", *SKETCH], across, ("a", "b", "need"))
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).where("c >= need").select("a", "b")
    more = verified(save(pairs, "pairs"), rows, shingle, similarity)
    drop_saved(shared)
    drop_saved(described)
    return connected_components(named.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The rows of ``docs``, with all their columns: one of each component, the one with the smallest doc_id.

    Rows link if the Jaccard similarity of their sets of word shingles is ``similarity`` or more (as 64-bit hashes, so but
    for colliding hashes exactly); a text shorter than a shingle is one shingle.  Texts without a word are not compared
    and stay.  A row with a null doc_id stays only if no row of its component has one; of rows with the same doc_id one
    stays, whichever was numbered first.

    ``radius`` is the distance of fingerprints up to which pairs are looked at, ``wide_radius`` if not given; 64 looks at all
    that share a search shingle, so no pair of this similarity is missed.
    """
    uid = free_name(docs, "_uid")
    held = save(docs.withColumn(uid, F.monotonically_increasing_id()), "near-rows")
    rows = held.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col(uid).alias("uid"), F.col("text").cast("string").alias("text"))
    named = near_links(rows, shingle, similarity, wide_radius(similarity) if radius is None else radius)
    members = held.select(F.col(uid).alias("_uid"), "doc_id").join(named, F.col("_uid") == F.col("node")).select("_uid", "component", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_uid").alias("rank"))
    first = members.groupBy("component").agg(F.min("rank").alias("first"))
    gone = save(members.join(first, "component").where(F.col("_uid") != F.col("first._uid")).select(F.col("_uid").alias(uid)), "near-copies")
    return held.join(gone, uid, "left_anti").select(docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the group of documents that it is linked to."""
    return near_duplicates(table(spark, sf_dir, "documents"))
