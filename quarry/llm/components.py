"""Connected components of an edge table, by alternating large and small stars.

Every round is two aggregations and two joins on node ids; each round's edges
are written to the shared folder, so the lineage stays short and a lost executor
costs one round at most.  Rounds grow with the logarithm of a component's
diameter; nothing is collected but a count and a checksum.  FEW_EDGES or fewer, which
are counted first, are joined inside one task instead: some MB, and none of the rounds'
jobs, whose tasks and plans the driver would hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import work

#: Edges (16 bytes each) that one task joins.
FEW_EDGES = 500_000


def _stamp(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (u, v), and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        x, y = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if table is not None and table.num_rows:
        nodes, least = least_nodes(*(np.asarray(table.column(c)) for c in ("u", "v")))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of integers -> (node, label), label the least node of the component; nodes without edges do not occur."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = work.save(pairs, "components")
    before = _stamp(current)
    if 0 < before[0] <= FEW_EDGES:
        kind = dict(current.dtypes)["u"]
        return work.save(work.map_arrow(current.coalesce(1), _joined, f"node {kind}, label {kind}"), "labels")
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        starred = large.join(least, "u")
        small = starred.select("u", F.col("m").alias("v")).unionByName(starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        current = work.save(small, "components")
        after = _stamp(current)
        if after == before:
            break
        before = after
    labels = current.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(labels.select(F.col("label").alias("node"), "label").distinct())
