"""Connected components of an undirected graph by alternating large-star and small-star steps.

A graph whose edges a count proves to be few is settled in one task, which spares many
short stages; all others by the steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstrata.llm.common import materialise


#: Edges up to which one task holds the graph (16 bytes each).
SMALL_GRAPH = 500_000


def _settle(batches):
    """(node, component) of all edges that a task gets: hooking to the smaller label, with pointer jumping."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    names, at = np.unique(np.concatenate(parts, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(names))
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for end in (a, b):
            np.minimum.at(new, label[end], low)
            np.minimum.at(new, end, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(names))
    yield pa.record_batch([pa.array(names[moved]), pa.array(names[label[moved]])], names=["node", "component"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over directed pairs a > b: hang neighbours on the smallest node in reach.

    The minimum of a node's neighbourhood is a partial aggregate and comes back by an
    equi-join, so that a hub is never gathered in one task.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        new = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        hung = edges.join(low, "a")
        new = hung.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return new.where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60, small: int = SMALL_GRAPH) -> DataFrame:
    """Map each node of ``edges`` (longs a, b) that reaches a smaller one to the smallest: (node, component).

    The smallest node of a component has no row; callers coalesce a node without one to itself.

    Each pair of steps is written in the shared folder. The loop ends when a round
    changes no edge; the number of rounds grows with the logarithm of the largest
    component, and running out of ``rounds`` is an error, not a partial result.
    Null ends and loops are dropped; an empty graph gives no rows.
    """
    now = materialise(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    if now.limit(small + 1).count() <= small:
        return now.coalesce(1).mapInArrow(_settle, "node long, component long")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        now = materialise(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
