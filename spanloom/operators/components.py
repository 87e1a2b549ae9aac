"""Connected components by alternating large-star and small-star steps.

The edges of a task are contracted in the task, in blocks of bounded size, and a
step is one aggregation, one join and one window over what is left; each round is
cut in the shared folder, so lost executors cost one round at most. The number of
rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spanloom.sources.checkpoints import cut


def _least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b) that reach a smaller one, and the smallest that each reaches."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = place[: len(a)], place[len(a) :], np.arange(len(nodes))
    while (apart := low[x] != low[y]).any():
        x, y = x[apart], y[apart]
        np.minimum.at(low, np.maximum(low[x], low[y]), np.minimum(low[x], low[y]))
        while (low[low] != low).any():
            low = low[low]
    child = low != np.arange(len(nodes))
    return nodes[child], nodes[low[child]]


def _contracted(block: int):
    """Edges (a, b) to edges that link the same nodes: in each block of a task every node but the smallest of its component is linked to that one.

    A block ends where a changes, so that edges that are sorted by a do not come twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        for batch in batches:
            held = np.concatenate([held, [np.asarray(batch.column(0)), np.asarray(batch.column(1))]], 1)
            if held.shape[1] >= block:
                change = np.flatnonzero(held[0] != held[0, -1])
                end = change[-1] + 1 if len(change) > block // 2 else held.shape[1]
                yield least(*held[:, :end])
                held = held[:, end:]
        if held.shape[1]:
            yield least(*held)

    def least(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _least_reachable(a, b)], ["a", "b"])

    return run


def _star_steps(edges: DataFrame) -> DataFrame:
    """A large-star and a small-star step on edges (a, b) with a > b. An edge stays one edge.

    The parents of the smaller ends come by a join on theirs, since the smallest
    node of a component may have all others as children. A node has at most as
    many parents as there are blocks that hold it, which a window may gather.
    """
    parent = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("p"))
    large = edges.join(parent, "b", "left").select("a", F.coalesce("p", "b").alias("b"))
    small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _is_final(edges: DataFrame) -> bool:
    """Whether every node has one parent, or is one, and not both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child")).union(edges.select(F.col("b").alias("node"), F.lit(0).alias("child")))
    roles = ends.groupBy("node").agg(F.sum("child").alias("up"), F.min("child").alias("low"))
    return not roles.where("up > 1 or (up = 1 and low = 0)").take(1)


def parents(edges: DataFrame, max_rounds: int = 60, block: int = 250_000) -> DataFrame:
    """Rows (node, component) for every node of the undirected edges (a, b) that reaches a smaller one; component is the smallest.

    Nodes are whole numbers. Self loops and rows with nulls are ignored; repeated
    edges count once. An error is raised if max_rounds do not reach the fixpoint.
    ``block`` is the number of edges that a task contracts at a time.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    links = edges.where("a is not null and b is not null and a <> b").select(a.cast("long").alias("a"), b.cast("long").alias("b"))
    contracted = lambda df: cut(df.mapInArrow(_contracted(block), "a long, b long"))
    now = contracted(links)
    for _ in range(max_rounds):
        if _is_final(now):
            break
        now = contracted(_star_steps(now))
    else:
        if not _is_final(now):
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """As parents(), with the smallest node of each component as a row too; no edges give no rows."""
    members = parents(edges, max_rounds)
    return members.union(members.select(F.col("component").alias("node"), "component").distinct())


def _star(edges: DataFrame, key: str, large: bool) -> DataFrame:
    """A step on edges within values of key, as windows: rows dealt by key stay where they are."""
    both = edges
    if large:
        both = edges.select(key, F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select(key, "e.a", "e.b")
    least = F.min("b").over(Window.partitionBy(key, "a"))
    if large:
        return both.withColumn("m", F.least(F.col("a"), least)).where("b > a").select(key, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    out = F.explode(F.array_compact(F.array(F.struct("a", F.col("m").alias("b")), moved)))
    return both.withColumn("m", least).select(key, out.alias("e")).select(key, "e.a", "e.b").distinct()


def components_within(edges: DataFrame, key: str, max_rounds: int = 60) -> DataFrame:
    """As components(), for edges (key, a, b) that lie within values of key: rows (key, node, component). A round deals the edges by key once."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = cut(edges.where("a is not null and b is not null and a <> b").select(key, a.alias("a"), b.alias("b")).distinct())
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("child")), F.struct(F.col("b").alias("node"), F.lit(0).alias("child"))))

    def final() -> bool:
        roles = now.repartition(key).select(key, ends.alias("e")).groupBy(key, "e.node").agg(F.sum("e.child").alias("up"), F.min("e.child").alias("low"))
        return not roles.where("up > 1 or (up = 1 and low = 0)").take(1)

    for _ in range(max_rounds):
        if final():
            break
        now = cut(_star(_star(now.repartition(key), key, True), key, False))
    else:
        if not final():
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = F.explode(F.array(F.col("a"), F.col("b")))
    return now.repartition(key).select(key, nodes.alias("node"), F.col("b").alias("component")).distinct()
