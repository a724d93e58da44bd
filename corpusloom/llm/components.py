"""Connected components of a distributed link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.storage import cut, discard


#: Links that one task joins in memory, as a broadcast of a checked size would be; more go through the rounds.
TASK_LINKS = 200_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of links by hooking each root to a lesser one and halving paths."""
    parts = [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
    if not parts:
        return
    a, b = (np.concatenate(x) for x in zip(*parts))
    nodes, codes = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = codes[: len(a)], codes[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Join every neighbour of a node (only the smaller ones if ``small``) to the node's least neighbour."""
    if small:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = near.join(least, "u")
    if small:
        made = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        made = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return made.where("a <> b").distinct()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; the component is its least node.

    Nulls and links of a node to itself are no links. The rounds, about log2 of the longest path, stop when the
    links are stars; every round is written to the shared folder, so a lost executor repeats one round at most.
    """
    edges = cut(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b"), "edges")
    if edges.count() <= TASK_LINKS:
        kind = edges.schema["a"].dataType.simpleString()
        return edges.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, component {kind}")
    state = None
    while True:
        after = cut(_star(_star(edges, False), True), "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(edges)
        edges = after
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
