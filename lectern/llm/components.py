"""Distributed union-find: connected components by repeated contraction.

Each round lets every node point to its neighbour of least hashed id, follows the pointers a few steps and
contracts the edges to the nodes reached. Ids are compared by hash, so chains in id order shorten too. Tables are
written to the shared folder, so a lost executor costs one round's tasks. Minima are pre-aggregated before each
shuffle and joins read plain exchanges on both sides, so a hub's rows can be split at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the component's smallest node.

    Null ends and loops are ignored (a node with loops alone is not returned); no edges give no rows.
    """
    live = stored(edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b").distinct(), "edges")
    labels = stored(live.select(F.col("a").alias("node")).union(live.select("b")).distinct().withColumn("label", F.col("node")), "labels")
    while not live.isEmpty():
        both = live.union(live.select("b", "a"))
        best = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        parents = stored(best.select(F.col("a").alias("node"), F.when(F.col("m.h") < F.xxhash64("a"), F.col("m.to")).otherwise(F.col("a")).alias("up")), "parents")
        for _ in range(2):
            step = parents.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = stored(parents.join(step, "up").select("node", F.col("upper").alias("up")), "parents")
            release(parents)
            parents = jumped
        a, b = (parents.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        less = stored(
            live.join(a, "a").join(b, "b").where("up_a <> up_b")
            .select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct(), "edges")
        moved = stored(labels.join(parents.select(F.col("node").alias("label"), "up"), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
        for old in (live, labels, parents):
            release(old)
        live, labels = less, moved
    release(live)
    roots = labels.groupBy("label").agg(F.min("node").alias("root"))
    return labels.join(roots, "label").select("node", "root")
