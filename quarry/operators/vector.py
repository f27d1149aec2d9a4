"""Exact nearest-neighbour search.

A single query vector is a literal in a native expression, whose top k plans as
TakeOrderedAndProject.  A batch of queries is scored block by block with one
matrix product for each CELLS distances, so its memory is bounded; every task keeps its own k best per query, so
what is shuffled is tasks x queries x k small rows, whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions import text as T

#: Query vectors of one pass over the table.
BLOCK_QUERIES = 4096
#: Distances that a task holds at once.
CELLS = 1 << 20


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, op: str = "<=>") -> Column:
    """Cosine distance, negative inner product or Euclidean distance; null where a norm is zero."""
    if op == "<#>":
        return -dot(a, b)
    if op == "<->":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))
    if op != "<=>":
        raise ValueError(f"unknown distance {op!r}")
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def score(d: Column) -> Column:
    """Half a distance from 1, at least 0; the same for all distances."""
    return F.greatest(F.lit(0.0), 1 - d / 2)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with a vector that is neither null nor zero."""
    return vectors.where(F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0))


def top_k(vectors: DataFrame, query: list[float], k: int, op: str = "<=>", min_score: float = 0.05) -> DataFrame:
    """(chunk_id, distance, score, rank) of the k nearest, of which those under min_score then go."""
    literal = F.array(*[F.lit(float(x)) for x in query])
    d = distance(F.col("embedding"), literal, op)
    near = usable(vectors).select("chunk_id", d.alias("distance")).where("distance IS NOT NULL").orderBy(T.order_key(F.col("distance")), "chunk_id").limit(k)
    ranked = near.withColumn("rank", F.row_number().over(Window.orderBy(T.order_key(F.col("distance")), "chunk_id")))  # k rows
    return ranked.withColumn("score", score(F.col("distance"))).where(F.col("score") >= min_score)


def _best(block: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, row number and distance of the k least distances of each column (more where the last ones tie) of those whose key is at most the column's least."""
    keys = np.floor(block * 1e9 + 0.5)
    if k < len(keys) and np.isinf(least).any():
        least = np.minimum(least, np.partition(keys, k - 1, axis=0)[k - 1])
    rows, q = np.nonzero(keys <= least)
    return q, rows, block[rows, q]


def _first_k(q: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> list[np.ndarray]:
    order = np.lexsort((ids, np.floor(d * 1e9 + 0.5), q))
    q, ids, d = q[order], ids[order], d[order]
    inside = np.arange(len(q)) - np.searchsorted(q, q) < k
    return [q[inside], ids[inside], d[inside]]


def _taken(kept: list[np.ndarray] | None, least: np.ndarray, d: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray] | None:
    """The k best of each query after the distances d (rows x queries); least, the key that a hit may have at most, follows them."""
    of, row, near = _best(d, k, least)
    if not len(of):
        return kept
    found = of, ids[row], near
    kept = _first_k(*(np.concatenate(x) for x in zip(kept, found, strict=True)) if kept else found, k)
    # A query that has k hits takes none beyond its last one.
    full = np.flatnonzero(np.bincount(kept[0], minlength=len(least)) >= k)
    least[full] = np.floor(kept[2][np.searchsorted(kept[0], full, side="right") - 1] * 1e9 + 0.5)
    return kept


def batch_top_k(vectors: DataFrame, queries: DataFrame, k: int, op: str = "<=>", min_score: float = 0.05) -> DataFrame:
    """(qid, chunk_id, distance, score, rank) for queries (qid, embedding); ids of any type.

    Vectors that are null or zero, of rows and of queries alike, match nothing."""
    spark = vectors.sparkSession
    kinds = dict(vectors.dtypes)["chunk_id"], dict(queries.dtypes)["qid"]
    schema = f"qid {kinds[1]}, chunk_id {kinds[0]}, distance double"
    qid_kind, id_kind = (to_arrow_type(t.schema[c].dataType) for t, c in ((queries, "qid"), (vectors, "chunk_id")))
    rows = ((r["qid"], r["embedding"]) for r in usable(queries).select("qid", "embedding").toLocalIterator())
    out = spark.createDataFrame([], schema)
    while part := list(islice(rows, BLOCK_QUERIES)):  # the driver holds one block of queries
        shared = spark.sparkContext.broadcast(([i for i, _ in part], np.array([v for _, v in part], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qids, q = shared.value
            kept, least = None, np.full(len(q), np.inf)
            step = max(1, CELLS // len(q))
            for batch in batches:
                for a in range(0, batch.num_rows, step):
                    piece = batch.slice(a, step)
                    v = np.asarray(piece.column("embedding").flatten(), dtype=np.float64).reshape(piece.num_rows, -1)
                    ids = np.array(piece.column("chunk_id").to_pylist())
                    if op == "<=>":
                        d = 1 - (v @ q.T) / (np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))[None])
                    elif op == "<#>":
                        d = -(v @ q.T)
                    else:
                        d = np.sqrt(np.maximum((v * v).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (v @ q.T), 0))
                    kept = _taken(kept, least, d, ids, k)
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in kept[0]], qid_kind), pa.array(kept[1].tolist(), id_kind), pa.array(kept[2], pa.float64())], ["qid", "chunk_id", "distance"])

        out = out.unionByName(usable(vectors).select("chunk_id", "embedding").mapInArrow(run, schema))
    order = Window.partitionBy("qid").orderBy(T.order_key(F.col("distance")), "chunk_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.withColumn("score", score(F.col("distance"))).where(F.col("score") >= min_score)
