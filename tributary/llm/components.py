"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .io import stored

#: Edges that one process may hold (16 bytes each); more are contracted by joins.
LOCAL_EDGES = 4_000_000
#: Edges that a task contracts at once.
TASK_EDGES = 500_000


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node it is linked to,
    over any number of links. Repeated edges, both directions and loops do no harm."""
    edges = stored(_contracted(edges.select("a", "b")))
    if edges.count() <= local_edges:
        return _local(edges)
    return _stars(edges)


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: each task links its nodes to the smallest one that it knows
    them to be linked to, so a node has one edge a task, however many links a cluster has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, least = [], 0, 0
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
            size += batch.num_rows
            # as long as contracting helps
            if size > max(TASK_EDGES, 2 * least):
                held = [_roots(*(np.concatenate(x) for x in zip(*held)))]
                size = least = len(held[0][0])
        if held:
            nodes, root = _roots(*(np.concatenate(x) for x in zip(*held)))
            for k in range(0, len(nodes), TASK_EDGES):
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + TASK_EDGES], pa.int64()) for x in (nodes, root)], ["a", "b"])

    return edges.select(F.col("a").cast("bigint"), F.col("b").cast("bigint")).mapInArrow(run, "a bigint, b bigint")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of some edges, and the smallest that each is linked to."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    # hook to the smaller root and halve the paths, all edges at once
    while True:
        p, q = root[x], root[y]
        low = np.minimum(p, q)
        if (p == q).all():
            break
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        while not (root == root[root]).all():
            root = root[root]
    return nodes, nodes[root]


def _local(edges: DataFrame) -> DataFrame:
    t = edges.toArrow()
    nodes, root = _roots(*(t.column(i).to_numpy() for i in (0, 1)))
    return edges.sparkSession.createDataFrame(pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array(root, pa.int64())}))


def _stars(edges: DataFrame) -> DataFrame:
    """Alternating large and small stars; each round is written, so that no lineage grows and no
    executor's loss undoes more than a round. A node's row count halves in few rounds, and hubs are
    pre-aggregated to their minimum before any shuffle of theirs."""
    now, before = edges.where("a <> b"), None
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        m = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = stored(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    tops = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    alone = edges.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    found = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(tops)
    return found.union(alone.join(found, "node", "left_anti")).groupBy("node").agg(F.min("root").alias("root"))
