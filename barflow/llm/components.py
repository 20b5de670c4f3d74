"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGES, LEAST_TASKS = 1 << 15, 8  # edges that a task takes, and tasks at least
ROUNDS = 200  # rounds need the logarithm of a component's size; a loop that never settles is an error


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for these edges; roots are left out."""
    nodes, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _state(e: DataFrame):
    """The number of edges and a sum over them."""
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node long, root long) of every node of edges (a long, b long): root is the component's least node.

    Lineage is cut by checkpoint() each round.  A round runs in as many tasks as its edges need, whatever the session's shuffle
    partitions.  Self-loops and repeated edges don't matter."""
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    now = _state(e)
    for _ in range(ROUNDS):
        before, tasks = now, max(LEAST_TASKS, -(-now[0] // EDGES))
        e = e.coalesce(tasks)
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).coalesce(tasks)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct().coalesce(tasks)
        low = large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(low.select("u", F.col("m").alias("v")))
        e = small.coalesce(tasks).distinct().coalesce(tasks).checkpoint()
        now = _state(e)
        if now == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
