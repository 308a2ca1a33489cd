"""Connected components of a graph given by its links.

Up to ``FEW`` distinct links (a counted bound) one task joins them; beyond that large
and small stars alternate until nothing moves, and no task holds more than its
share of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import materialise


def large_star(edges: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


FEW = 500_000
LABELS = "node bigint, component bigint"


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of each one's component: least labels travel along links, then along labels."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], least)
        np.minimum.at(new, label[y], least)
        while (jump := new[new]).sum() != new.sum():
            new = jump
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def in_one_task(edges: DataFrame) -> DataFrame:
    def run(group: pa.Table) -> pa.Table:
        nodes, labels = joined(group["a"].to_numpy(), group["b"].to_numpy())
        return pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(labels, pa.int64())})

    return edges.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, LABELS)


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge.  edges: a, b, whole numbers; loops are ignored."""
    now = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").distinct(), name)
    if now.count() <= FEW:
        return in_one_task(now)
    mark = None
    while True:
        now = materialise(small_star(large_star(now)), name)
        seen = now.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if mark == (seen["n"], seen["x"]):
            break
        mark = (seen["n"], seen["x"])
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
