"""Connected components: local contraction and alternating stars; all state stays in Spark tables."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_saved, save

#: Edges that one task contracts.
TASK_EDGES = 1_000_000


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of ``label`` (each node's parent is its root) along edges of node numbers; the smaller root stays."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label[:] = up


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    """The edges of each of ``parts`` tasks as stars: every node with the smallest one that it reaches inside the task."""

    def run(batches):
        ends = [b.columns for b in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(e[k].to_numpy() for e in ends)]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = np.arange(len(nodes))
        hook(label, at[: len(a)], at[len(a) :])
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])

    return edges.coalesce(parts).mapInArrow(run, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component): the smallest node reachable.  Nodes without edges are not in it.

    Each round contracts the edges task by task, TASK_EDGES in each.  While there is more than one task, large-star then
    joins each node's larger neighbours to its smallest one and small-star its smaller ones, until nothing changes: every
    component becomes one star in about log(n) rounds.  No node's neighbours are ever gathered: a round is two aggregations
    with map-side combine and two joins, which adaptive execution splits where a node is hot.  Each round is written to
    the shared folder.  Null ends and loops are ignored.
    """
    stars = save(edges.where("a is not null and b is not null and a <> b").select("a", "b"), "edges")
    seen = None
    while True:
        parts = max(1, ceil(stars.count() / TASK_EDGES))
        following = save(_contract(stars, parts), "edges")
        drop_saved(stars)
        stars = following
        if parts == 1:
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        following = save(small.select("e.*").where("a <> b").distinct(), "edges")
        drop_saved(stars)
        stars = following
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
