"""How five filters interact: what each removes at each step of every order in which they can be applied.

A document is known by the set of filters that it fails, its mask.  The orders are numbered lexicographically (their Lehmer
rank), so all orders that begin alike are neighbours: what happens to a mask at a step, which depends on the order's first
letters only, holds on whole intervals of ranks.  A mask's count is added where such an interval begins and taken off where
it ends; running sums over the 120 ranks then give every order's totals.  The work per document is its mask; everything
after that depends on the 32 masks and the parts alone.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import SPACE, table

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT, MARKS = 200, 50, 3, r"[#$%&*|]"
RANKS = factorial(len(FILTERS))
#: What the difference arrays count, by the number of rows, of good and of toxic ones.
MEASURES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")


def lehmer_rank(prefix: str) -> int:
    """The rank of the first order that begins with ``prefix``."""
    left, rank = list(FILTERS), 0
    for letter in prefix:
        rank += left.index(letter) * factorial(len(left) - 1)
        left.remove(letter)
    return rank


def interval_ends(letters: str = FILTERS) -> list[tuple[int, int, int, str, int]]:
    """(mask, step, rank, state, sign): where the intervals of each mask's states begin (1) and end (-1).

    The state of a mask at a step: ``removed`` if the step's filter is the first that it fails, ``redundant`` if it fails
    this and an earlier one, and beside these ``kept`` while it has failed none.
    """
    out = []
    for step in range(1, len(letters) + 1):
        for prefix in permutations(letters, step):
            start, width = lehmer_rank("".join(prefix)), factorial(len(letters) - step)
            seen = [1 << letters.index(x) for x in prefix]
            for mask in range(1 << len(letters)):
                before, now = any(mask & b for b in seen[:-1]), mask & seen[-1]
                state = "redundant" if before and now else "removed" if now else "" if before else "kept"
                if state:
                    out += [(mask, step, start, state, 1), (mask, step, start + width, state, -1)]
    return out


def own_conditions(text: Column) -> Column:
    """The mask of the four filters that look at a text alone."""
    words = F.array_remove(F.split(text, SPACE), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = [n < MIN_WORDS, 100 * distinct.cast("long") < MIN_DISTINCT_PERCENT * n, 100 * upper.cast("long") > MAX_UPPER_PERCENT * F.length(text), text.rlike(MARKS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def document_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of each row of ``docs``; null text counts as empty, null lang as an empty part.

    Equal texts are found by SHA-256.  Only the smallest id of texts that repeat is joined back, and the rows carry no text
    there; the adaptive join splits a text that a third of all rows share.  Rows with a null id have no smaller id and are
    none; repeated rows with the smallest id all pass.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    rows = rows.select("doc_id", "part", own_conditions(F.col("_text")).alias("_own"), F.unhex(F.sha2("_text", 256)).alias("_sha"))
    hashes = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("_sha"))
    first = hashes.groupBy("_sha").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_sha", "_first")
    copy = F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False))
    return rows.join(first, "_sha", "left").select("doc_id", "part", (F.col("_own") + F.when(copy, 16).otherwise(0)).alias("mask"))


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order and step from ``counts`` (part, mask, n, good, toxic), zeros included."""
    spark = counts.sparkSession
    ends = F.broadcast(spark.createDataFrame(interval_ends(), "mask int, step int, rank int, state string, sign int"))
    at = counts.join(ends, "mask").groupBy("part", "step", "rank").agg(
        *[F.sum(F.when(F.col("state") == s, F.col("sign") * F.col("n")).otherwise(0)).alias(s) for s in ("kept", "removed", "redundant")],
        *[F.sum(F.when(F.col("state") == "removed", F.col("sign") * F.col(c)).otherwise(0)).alias(f"{c}_lost") for c in ("good", "toxic")],
    )
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = F.broadcast(spark.createDataFrame([(r, o, s, o[s - 1]) for r, o in enumerate(orders) for s in range(1, len(o) + 1)], "rank int, filter_order string, step int, filter string"))
    unique = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)).alias(f"_only{x}") for i, x in enumerate(FILTERS)]
    parts = counts.groupBy("part").agg(F.map_from_arrays(F.array(*[F.lit(x) for x in FILTERS]), F.array(*unique)).alias("_only"))
    grid = parts.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(RANKS - 1)))).join(steps, "rank")  # 600 rows for each part
    so_far = W.Window.partitionBy("part", "step").orderBy("rank").rowsBetween(W.Window.unboundedPreceding, 0)
    full = grid.join(at, ["part", "step", "rank"], "left")
    full = full.select("part", "filter_order", "step", "filter", F.col("_only")[F.col("filter")].alias("unique_fails"), *[F.coalesce(F.sum(m).over(so_far), F.lit(0)).alias(m) for m in MEASURES])
    shapley = F.sum("removed").over(W.Window.partitionBy("part", "filter"))
    return full.select("part", "filter_order", "step", *MEASURES[:3], "unique_fails", *MEASURES[3:], shapley.alias("shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of ``docs`` (doc_id, text, lang) with ``labels`` (doc_id, quality, toxic), by part.

    ``part`` is the lang value, the empty string where it is null.  A row is good (toxic) if any label of its id says so;
    rows with a null id have no label.  Repeated rows count as often as they stand.  An empty table gives an empty result;
    other columns are ignored.
    """
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = document_masks(docs).join(flags, "doc_id", "left")
    counts = marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    return audit(counts)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interaction of the five filters over all documents."""
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
f as (
  select part, doc_id, len(w) < 200 as a, 100 * len(list_distinct(w)) < 50 * len(w) as b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * len(t) as c,
         regexp_matches(t, '[#$%&*|]') as d, doc_id > min(doc_id) over (partition by t) as e from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
m as (
  select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end) || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as failed,
         count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as k),
o as (
  select a.k || b.k || c.k || d.k || e.k as filter_order from x a, x b, x c, x d, x e
  where a.k not in (b.k, c.k, d.k, e.k) and b.k not in (c.k, d.k, e.k) and c.k not in (d.k, e.k) and d.k <> e.k),
s as (
  select part, filter_order, step::int as step, n, good, toxic, failed, filter_order[step] as filter, contains(failed, filter_order[step]) as fails,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda y: y <> '' and contains(failed, y))) > 0 as gone
  from m, o, range(1, 6) r(step)),
r as (
  select part, filter_order, step, filter, coalesce(sum(n) filter (not gone and not fails), 0)::bigint as kept, coalesce(sum(n) filter (not gone and fails), 0)::bigint as removed,
         coalesce(sum(n) filter (gone and fails), 0)::bigint as redundant, coalesce(sum(n) filter (failed = filter), 0)::bigint as unique_fails,
         coalesce(sum(good) filter (not gone and fails), 0)::bigint as good_lost, coalesce(sum(toxic) filter (not gone and fails), 0)::bigint as toxic_lost from s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, filter))::bigint as shapley from r
"""
