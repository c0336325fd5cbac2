"""Connected components of a graph whose edges live in a DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, discard, materialise

#: Edges up to which one task finds the components (16 bytes each), as star rounds of tiny tables cost more memory and time than they save.
ONE_TASK = 500_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges (a, b): every root is hooked to the least one it meets, which at least halves those that meet another."""
    got = list(batches)
    a, b = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in got] or [np.empty(0, np.int64)]) for c in ("a", "b"))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours.

    The minima are written first, so both sides of the join are plain exchanges and adaptive execution can split a hub's edges.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them; edges come as (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the least node reachable.

    edges: two long columns a and b in any order; repeated edges, loops and an empty table are fine (a node with loops
    only is left out). Up to ONE_TASK edges go through one task. Of more, alternating large-star and small-star rounds keep the number of edges bounded by the input and end
    after about log2 of the longest path; each round is written to the shared folder, which cuts the lineage. Grouping by
    min() combines before the shuffle, so a hub costs a task no more than any other node.
    """
    spark = edges.sparkSession
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _state(edges)
    if before[0] <= ONE_TASK:
        with batch_rows(spark, 50_000):
            return materialise(edges.coalesce(1).mapInArrow(_in_one_task, "node long, root long"), "roots")
    while before[0]:
        star = materialise(_large_star(edges), "large-star")
        discard(spark, edges)
        edges = materialise(_small_star(star), "small-star")
        discard(spark, star)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
