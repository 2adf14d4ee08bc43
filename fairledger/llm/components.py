"""Connected components of a table of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairledger.plans.staging import stage

#: Links that one task thins out at once.
TASK_LINKS = 500_000


def thinned(links: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the written table `links` connects, fewer in dense groups.

    A task keeps those of its links that join what its links before did not join yet, so it returns
    fewer than it has nodes. Tasks hold `TASK_LINKS` links each, whatever there are in all.
    """
    def forest(batches):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            kept = []
            for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
                p, q = root(a), root(b)
                if p != q:
                    up[p] = q
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[side] for k in kept], pa.int64()) for side in (0, 1)], names=["a", "b"])

    tasks = -(-links.count() // TASK_LINKS)
    return links.select("a", "b").repartition(max(1, tasks)).mapInArrow(forest, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b); the component is its smallest node.

    Every node has a label in its component, at first the smallest of its neighbours and itself. In
    a round each node sees the labels of its neighbours' labels; the smallest becomes its own, and
    that of the node which its old label names. This takes about log(length of the longest path)
    rounds. What is joined to all links of a node is a written table, so a hot node is split.
    """
    pairs = links.select("a", "b").where("a != b")
    edges = stage(pairs.unionByName(
        pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(
        F.least("node", F.min("b")).alias("component")))
    while True:
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        seen = stage(labels.join(up, "component"))
        around = edges.join(seen.select(F.col("node").alias("b"), "up"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("up").alias("low"))
        moved = seen.join(around, "node").select(F.explode(F.array(
            F.struct("node", F.least("low", "up").alias("to"), F.col("component").alias("was")),
            F.struct(F.col("component").alias("node"), F.col("low").alias("to"),
                     F.lit(None).cast("long").alias("was")),
        )).alias("m")).groupBy("m.node").agg(
            F.min("m.to").alias("component"), F.max("m.was").alias("was"))
        found = stage(moved.withColumn("component", F.least("component", "was")))
        labels = found.select("node", "component")
        if found.where("component < was").isEmpty():
            return labels
