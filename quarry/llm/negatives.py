"""Hard-negative mining over one-dimensional distance keys.

A vector x gets one more component, sqrt(M^2 - |x|^2), and a query q a zero, so that
distance^2 = |q|^2 + M^2 - 2 <q, x> and the largest inner products are the nearest
vectors.  Each vector belongs to its nearest pivot; vectors lie sorted by (pivot,
distance to it), whose file statistics are the index.  By the triangle inequality a
vector at distance r from the query has a key within r of the query's distance to
that pivot, so a search scans key intervals around the query, in rounds: each takes
the annuli of keys that the rounds before left out, and a search ends when the k-th
best result is nearer than any key left can be.

`mine` takes anchors in blocks: a block's vectors and radii are broadcast, a task
compares the vectors whose keys are due as matrix products and keeps k results for
each anchor and band.  First come the anchors' positives, the best of their own
label; each positive then gives a band of scores for the negatives, the best of
other labels inside it.  All results are exact, whatever the pivots.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part; shorter vectors are filled with zeros; components become
floor(scale * x), exact while inner products stay below 2^50; scores are integers,
ties go to smaller ids; repeated rows are rows of their own, each an anchor of its
own too; anchors without positives or without negatives in a band give no rows; an
empty table gives none; other columns are not read.  Ids and labels are integers.
Memory: a block has BLOCK anchors at most, a task one Arrow batch and the block's
results; pivots come from a sample of SAMPLE rows, all rows are indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

POSITIVES, NEGATIVES, SCALE = 5, 10, 256.0
#: Percent of a positive's score that a negative's may have.
LOW, HIGH = 30, 90
PIVOTS, SAMPLE = 32, 4096
#: Anchors of a block, of a matrix product, and keys that the first round looks for around an anchor's own.
BLOCK, TILE, FIRST = 8192, 256, 4000
STORED = "pivot int, dist double, rid long, id long, label long, anchor boolean, v array<double>"


class Index(NamedTuple):
    rows: DataFrame
    pivots: np.ndarray
    #: Of every pivot: rows, least and greatest distance.
    stats: np.ndarray
    norm: float


def usable(vectors: DataFrame, vec_id: str, label: str, embedding: str, anchor: Column) -> DataFrame:
    """rid, id, label, anchor, x of the rows that take part."""
    x = F.col(embedding).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & x.isNotNull()).where(~bad)
    return rows.select(F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), x.alias("x"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width, short ones filled with zeros."""
    n = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    out = np.zeros((len(lists), width))
    out[np.arange(width) < n[:, None]] = np.asarray(lists.flatten(), dtype=np.float64)
    return out


def augmented(x: np.ndarray, norm: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))[:, None]])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Centres of the sample by Lloyd's rounds from points far from each other."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = [sample[0]]
    gap = distances(sample, sample[:1])[:, 0]
    while len(centres) < min(n, len(sample)) and gap.max() > 0:
        centres.append(sample[int(gap.argmax())])
        gap = np.minimum(gap, distances(sample, centres[-1][None])[:, 0])
    made = np.array(centres)
    for _ in range(5):
        near = distances(sample, made).argmin(axis=1)
        made = np.array([sample[near == k].mean(axis=0) if (near == k).any() else made[k] for k in range(len(made))])
    return made


def build(rows: DataFrame, scale: float = SCALE) -> Index:
    """The rows of usable(), sorted by (pivot, distance) and written."""
    spark = rows.sparkSession
    scaled = F.transform("x", lambda c: F.floor(c * scale).cast("double"))
    size = rows.select(F.size("x").alias("d"), F.aggregate(scaled, F.lit(0.0), lambda s, c: s + c * c).alias("n")).agg(F.max("d"), F.max("n")).first()
    width, norm = size[0] or 0, float(size[1] or 0.0)
    sample = rows.select(scaled.alias("v"), F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    pivots = choose_pivots(augmented(matrix(sample, width), norm))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.floor(matrix(batch.column("x"), width) * scale)
            d = distances(augmented(v, norm), pivots)
            near = d.argmin(axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * width), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(d[np.arange(len(v)), near]), *(batch.column(c) for c in ("rid", "id", "label", "anchor")), lists], ["pivot", "dist", "rid", "id", "label", "anchor", "v"])

    # Equal vectors have equal keys: ids spread them over the files.
    order = ["pivot", "dist", "id"]
    stored = work.save(work.map_arrow(rows, run, STORED).repartitionByRange(*order).sortWithinPartitions(*order), "vectors")
    stats = np.zeros((len(pivots), 3))
    for r in stored.groupBy("pivot").agg(F.count("*"), F.min("dist"), F.max("dist")).collect():  # a row a pivot
        stats[r[0]] = r[1:]
    return Index(stored, pivots, stats, norm)


class Block(NamedTuple):
    """Anchors and what they look for: bands of scores from lo to hi, at least `least` (k results of that score are known)."""

    rid: np.ndarray
    label: np.ndarray
    v: np.ndarray
    to_pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    least: np.ndarray
    #: Keys farther than `after` and up to `upto` from the anchor's are due.
    after: np.ndarray
    upto: np.ndarray


def best(score: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of the last axis, higher scores and then smaller ids first."""
    order = np.lexsort((rids, ids, -score), axis=-1)[..., :k]
    return tuple(np.take_along_axis(a, order, axis=-1) for a in (score, ids, rids))


def scan(index: Index, block: Block, same_label: bool, k: int) -> DataFrame:
    """a (the anchor's place in its block), band, id, rid, score: a task's k best for each anchor and band among the keys that are due."""
    spark = index.rows.sparkSession
    shared = spark.sparkContext.broadcast(block)
    none, width = -(2.0**60), block.v.shape[1]
    due = block.upto > block.after
    reach = F.lit(False)
    for p in np.flatnonzero(index.stats[:, 0] > 0).tolist() if due.any() else []:
        low, high = (block.to_pivot[due, p] - block.upto[due]).min(), (block.to_pivot[due, p] + block.upto[due]).max()
        # A little wider: the tasks decide what lies on the edge of an annulus.
        reach = reach | ((F.col("pivot") == p) & F.col("dist").between(float(low - 1e-6 * (1 + abs(low))), float(high + 1e-6 * (1 + high))))

    def tile(b: Block, rows: slice, state: list[np.ndarray], p: int, dist: np.ndarray, label: np.ndarray, ids: np.ndarray, rids: np.ndarray, v: np.ndarray) -> None:
        gap = np.abs(dist - b.to_pivot[rows, p][:, None])
        open_ = (gap > b.after[rows][:, None]) & (gap <= b.upto[rows][:, None])
        mine = np.flatnonzero(open_.any(axis=1))
        if not len(mine):
            return
        at = mine + rows.start
        open_ = open_[mine] & ((b.label[at][:, None] == label) if same_label else (b.label[at][:, None] != label)) & (b.rid[at][:, None] != rids)
        score = np.rint(b.v[at] @ v.T)
        place = np.arange(len(ids))
        for band in range(b.lo.shape[1]):
            floor = np.maximum(np.maximum(b.lo[at, band], b.least[at, band]), state[0][at, band, -1])
            hit = open_ & (score >= floor[:, None]) & (score <= b.hi[at, band][:, None])
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            # Columns ascend by id, so score and place in one integer order both.
            key = np.where(hit[some], score[some], -(2.0**50)).astype(np.int64) * 4096 - place
            top = np.argpartition(-key, k - 1, axis=1)[:, :k] if len(ids) > k else np.broadcast_to(place, key.shape)
            found = np.where(np.take_along_axis(hit[some], top, axis=1), np.take_along_axis(score[some], top, axis=1), none)
            where = at[some]
            merged = best(*(np.concatenate([s[where, band], f], axis=1) for s, f in zip(state, (found, ids[top], rids[top]), strict=True)), k)
            for s, m in zip(state, merged, strict=True):
                s[where, band] = m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        n, bands = b.lo.shape
        state = [np.full((n, bands, k), none), np.zeros((n, bands, k), dtype=np.int64), np.zeros((n, bands, k), dtype=np.int64)]
        for batch in batches:
            columns = {c: np.asarray(batch.column(c)) for c in ("pivot", "dist", "label", "id", "rid")}
            v = matrix(batch.column("v"), width)
            order = np.lexsort((columns["rid"], columns["id"], columns["pivot"]))
            for part in np.split(order, np.flatnonzero(np.diff(columns["pivot"][order])) + 1) if len(order) else []:
                for start in range(0, len(part), 2000):
                    some = part[start : start + 2000]
                    for first in range(0, n, TILE):
                        tile(b, slice(first, min(first + TILE, n)), state, int(columns["pivot"][some[0]]), columns["dist"][some], columns["label"][some], columns["id"][some], columns["rid"][some], v[some])
        at = np.nonzero(state[0] > none)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0]), pa.array(at[1]), pa.array(state[1][at]), pa.array(state[2][at]), pa.array(state[0][at].astype(np.int64))], ["a", "band", "id", "rid", "score"]
        )

    return work.map_arrow(index.rows.where(reach).select("pivot", "dist", "rid", "id", "label", "v"), run, "a long, band long, id long, rid long, score long")


def search(index: Index, block: Block, same_label: bool, k: int) -> DataFrame:
    """a, band, id, rid, score, rank: the k best rows of each anchor and band, written."""
    n, bands = block.lo.shape
    spread = (block.v * block.v).sum(axis=1) + index.norm
    slack = 1e-6 * (1 + np.sqrt(spread))
    to_distance = lambda score: np.sqrt(np.maximum(spread[:, None] - 2 * score, 0)) + slack[:, None]
    farthest = (block.to_pivot + index.stats[:, 2])[:, index.stats[:, 0] > 0].max(axis=1, initial=0) + slack
    # No result of a band lies beyond the distance of its lowest score; an empty band needs none.
    need = np.where(block.lo <= block.hi, np.minimum(to_distance(np.maximum(block.lo, -(2.0**52))), farthest[:, None]), -1.0)
    # The first annulus reaches into the pivot whose keys are nearest to the query's.
    count, low, high = index.stats.T
    outside = np.where(count > 0, np.maximum(np.maximum(low - block.to_pivot, block.to_pivot - high), 0), np.inf)
    home = outside.argmin(axis=1)
    step = np.maximum((high - low)[home] * FIRST / np.maximum(count[home], 1) / 2, slack)
    block = block._replace(after=np.full(n, -1.0), upto=np.minimum(outside.min(axis=1, initial=farthest.max(initial=0)) + step, need.max(axis=1)))
    found: DataFrame | None = None
    while True:
        new = scan(index, block, same_label, k)
        first = Window.partitionBy("a", "band").orderBy(F.desc("score"), "id", "rid")
        both = new if found is None else new.unionByName(found.drop("rank"))
        found = work.save(both.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k), "nearest")
        # One row for an anchor of the block and a band that is full.
        full = found.where(F.col("rank") == k).select("a", "band", "score").toArrow()
        a, band, score = (np.asarray(full[c].combine_chunks()) for c in ("a", "band", "score"))
        least = np.full((n, bands), -(2.0**60))
        least[a, band] = score
        bound = np.minimum(need, np.where(least > -(2.0**60), to_distance(least), np.inf))
        left = bound > block.upto[:, None]
        if not left.any():
            return found
        # A full band says how far its search must go; others go on in doubling steps.
        step = step * 2
        reach = np.where(least > -(2.0**60), bound, np.minimum(bound, (block.upto + step)[:, None]))
        # Nothing more is due for anchors that are certified.
        upto = np.where(left.any(axis=1), np.where(left, reach, -1.0).max(axis=1), block.upto)
        block = block._replace(least=least, after=block.upto, upto=upto)


def blocks_of(index: Index, size: int) -> list[Column]:
    """Conditions that part the anchors: whole pivots together up to size anchors, larger pivots by a hash of their rows."""
    counts = {r[0]: r[1] for r in index.rows.where("anchor").groupBy("pivot").count().collect()}  # a row a pivot
    out, now, total = [], [], 0
    for p in sorted(counts):
        if counts[p] > size:
            deals = -(-counts[p] * 5 // (size * 4))
            out += [(F.col("pivot") == p) & (F.pmod(F.xxhash64("rid"), F.lit(deals)) == d) for d in range(deals)]
            continue
        if total + counts[p] > size:
            out.append(F.col("pivot").isin(now))
            now, total = [], 0
        now.append(p)
        total += counts[p]
    return [*out, F.col("pivot").isin(now)] if now else out


def mine(
    vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchor is a condition on vectors."""
    index = build(usable(vectors, vec_id, label, embedding, anchor), scale)
    spark, width = vectors.sparkSession, index.pivots.shape[1] - 1
    path = work.new_path(spark, "negatives")
    kind = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], kind).write.parquet(path)
    for part in blocks_of(index, block):
        rows = index.rows.where("anchor").where(part).select("rid", "id", "label", "v").toArrow().combine_chunks()
        rid, label_, v = np.asarray(rows["rid"]), np.asarray(rows["label"]), matrix(rows["v"].combine_chunks(), width)
        n = len(rid)
        to_pivot = distances(np.hstack([v, np.zeros((n, 1))]), index.pivots)
        any_ = np.full((n, 1), 2.0**51)
        radii = np.zeros(n)
        start = Block(rid, label_, v, to_pivot, -any_, any_, np.full((n, 1), -(2.0**60)), radii, radii)
        near = search(index, start, True, positives)
        got = near.select("a", "rank", "score").toArrow()  # positives rows an anchor of the block
        lo, hi = np.full((n, positives), 1.0), np.full((n, positives), 0.0)
        a, r, score = (np.asarray(got[c].combine_chunks(), dtype=np.int64) for c in ("a", "rank", "score"))
        lo[a, r - 1], hi[a, r - 1] = -((-low * score) // 100), (high * score) // 100
        hard = search(index, start._replace(lo=lo, hi=hi, least=np.full(lo.shape, -(2.0**60))), False, negatives)
        ids = spark.createDataFrame(pa.table({"a": np.arange(n), "anchor_id": rows["id"]}))
        pairs = near.select("a", (F.col("rank") - 1).cast("long").alias("band"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = hard.select("a", "band", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["a", "band"]).join(ids, "a")
        out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(path)
    return spark.read.schema(kind).parquet(path)
