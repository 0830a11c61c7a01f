"""Connected components of an edge table, without ever gathering edges or components on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .workspace import BROADCAST_ROWS, Workspace

#: So many counted edges, of 16 bytes, are joined by one task.
TASK_EDGES = 250_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a bounded number of edges: roots are hooked to smaller ones, all at once, until every edge lies within one."""
    held = pa.Table.from_batches(list(batches), pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    nodes, at = np.unique(np.concatenate([held.column(0).to_numpy(), held.column(1).to_numpy()]), return_inverse=True)
    u, v = at[: held.num_rows], at[held.num_rows :]
    root = np.arange(len(nodes))
    while True:
        high, low = np.maximum(root[u], root[v]), np.minimum(root[u], root[v])
        apart = high != low
        if not apart.any():
            break
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long); component is the smallest node reachable.

    Up to TASK_EDGES edges, which are counted, are joined by one task. More go through alternating large-star and small-star steps: each is one partially aggregated minimum per node and one join back, and the
    number of rounds grows with the logarithm of the longest path. Each round's edges are a written table, so a lost executor
    costs no more than a part of one round. Self-loops and nulls are ignored; no edges give no rows.
    """
    now = ws.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star-0")
    n = now.count()
    if n <= TASK_EDGES:
        return ws.write(blocks.map_arrow(now.coalesce(1), _joined, "node long, component long"), "components")
    before, turn = None, 0
    # Minima of few nodes go to every task, so that no hub's edges meet in one; beyond that both sides are shuffled.
    side = F.broadcast if n <= BROADCAST_ROWS // 8 else lambda df: df
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(side(low), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # v <= u holds on every edge by now, so a node's smaller neighbours are exactly its edges.
        small = large.join(side(low), "u").select("v", "m").where("v <> m").union(low)
        turn += 1
        now = ws.write(small.toDF("u", "v").distinct(), f"star-{turn}")
        ws.drop(f"star-{turn - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
