"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A document is a weighted set of five-word shingles of lower-cased words; each
occurrence weighs the mean damped inverse document frequency of its words,
counted over the whole corpus.  K consistent weighted samples a document are banded; texts
with equal words are one representative first.  In each band bucket every member
meets the bucket's least member; the pairs are verified by exact weighted Jaccard
similarity of the whole texts.  Of the buckets whose members are then in different
components all pairs are compared exactly, inside tasks that hold up to two blocks
of a bucket, or many small buckets; only links that join components leave a task.
Classes are the connected components of the verified links, so every pair that
shares a band and reaches the threshold is in one class.  Recall against brute
force is measured in the tests and the README.

Defined results: documents without words are copies of each other (null, empty
and blank texts alike); texts of one to four words link only to equal words; the
least id of a class stands for it; rows with a null id are never linked and have
a null class; repeated rows share their class, and `accept` keeps one of them; different
texts of one id are judged each for itself, and no class goes without a row that stays;
an empty table gives no rows; other columns pass through `accept` whatever their
names.  Groups: only ids, keys and sketches are grouped, aggregated before each
shuffle; a bucket of n members makes n - 1 pairs at first, and while it spans
components n rows for each of its n / BLOCK_ROWS blocks (one up to BLOCK_ROWS
members or BLOCK_BYTES of text, so rows grow with n up to there); a task holds two
blocks at most.  Ids are integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import allpairs, ragged, weights, work
from .components import components

WIDTH, THRESHOLD = 5, 0.8
#: 1 - (1 - 0.8^4)^12 = 0.998 of pairs at the threshold share a band.
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Members and bytes of text of a block of a bucket.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4_000_000
#: Ids are broadcast up to this number (8 bytes each), else joined by shuffle.
BROADCAST_IDS = 1_000_000
POOL = 1 << 16


def _pool(seed: int = 17) -> tuple[np.ndarray, ...]:
    r = np.random.default_rng(seed)
    gamma = lambda: -np.log(r.random(POOL) * r.random(POOL))  # noqa: E731  Gamma(2, 1)
    odd = r.integers(1 << 62, size=SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return gamma().astype(np.float32), np.log(gamma()).astype(np.float32), r.random(POOL).astype(np.float32), odd


def elements(h: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and weight of every shingle occurrence (the second of a shingle differs from its first), with row offsets."""
    s, starts, first = ragged.shingles(h, offsets, WIDTH)
    if not len(s):
        return s, starts, np.zeros(0, np.float32)
    total = np.concatenate([[0], np.cumsum(idf[weights.bucket(h)], dtype=np.float64)])
    end = np.minimum(first + WIDTH, np.repeat(offsets[1:], np.diff(starts)))
    weight = ((total[end] - total[first]) / (end - first)).astype(np.float32)
    row = np.repeat(np.arange(len(starts) - 1, dtype=np.uint64), np.diff(starts))
    both = ragged.mix(s + row * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(both, kind="stable")
    run = np.concatenate([[True], both[order][1:] != both[order][:-1]])
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(run, np.arange(len(order)), 0))
    again = order[rank > 0]
    s[again] = ragged.mix(s[again] + rank[rank > 0].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return s, starts, weight


def sketches(s: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples (64-bit) for each row with elements."""
    step, log_c, beta, odd = _POOL
    n = np.diff(starts)
    begin, count = starts[:-1][n > 0], n[n > 0]
    log_w = np.log(weight)
    row = np.repeat(np.arange(len(begin)), count)
    out = np.empty((len(begin), SAMPLES), dtype=np.uint64)
    for k in range(SAMPLES if len(begin) else 0):
        at = ((s * odd[k]) >> np.uint64(48)).astype(np.int64)
        r, b = step[at], beta[at]
        t = np.floor(log_w / r + b)
        a = log_c[at] - r * (t - b + 1)
        hit = np.flatnonzero(a == np.repeat(np.minimum.reduceat(a, begin), count))
        first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
        out[:, k] = ragged.mix(s[first] + t[first].astype(np.int64).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    return out


_POOL = _pool()


def word_key(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's sequence of words."""
    place = (np.arange(len(h)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
    out = []
    for c in (0x8CB92BA72F3D8DD7, 0xE7037ED1A0B428DB):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ragged.mix(h ^ ragged.mix(place + np.uint64(c))), dtype=np.uint64)])
        out.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def sign(docs: DataFrame, idf: np.ndarray, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, t1, t2 (the words' 128 bits), size (bytes of text), bands."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ragged.pieces(batch):
                h, offsets = ragged.hashed(piece.column("text"))
                s, starts, weight = elements(h, offsets, shared.value)
                samples = sketches(s, starts, weight)
                bands = np.zeros((len(samples), BANDS), dtype=np.uint64)
                for k in range(ROWS):
                    bands = ragged.mix(bands * np.uint64(31) + samples[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
                full = np.diff(starts) > 0
                ends = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
                t1, t2 = word_key(h, offsets)
                size = pc.fill_null(pc.binary_length(piece.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), pa.array(t1), pa.array(t2), size,
                        pa.ListArray.from_arrays(pa.array(ends * BANDS), pa.array(bands.reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "t1", "t2", "size", "bands"],
                )
        ragged.release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return work.map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, t1 long, t2 long, size long, bands array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two sets of distinct elements, sorted by hash, whose weights follow from the element."""
    total = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64))
    at = np.minimum(np.searchsorted(b[0], a[0]), max(len(b[0]) - 1, 0))
    both = float(a[1][b[0][at] == a[0]].sum(dtype=np.float64)) if len(a[0]) and len(b[0]) else 0.0
    return both / (total - both) if total else 1.0


def texts_of(pairs: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """(id, text) of all documents in pairs (a, b), written once."""
    needed = work.save(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "near-needed")
    few = needed.count() <= BROADCAST_IDS
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    return work.save(texts.join(F.broadcast(needed) if few else needed, "id", "left_semi"), "near-texts")


def verify(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Of pairs (a, b) those with a similarity of threshold or more, written once."""
    spark = pairs.sparkSession
    shared = spark.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list] = {}
        for batch in batches:
            for piece in ragged.pieces(batch, "ta", "tb"):
                sides = {}
                for side in ("a", "b"):
                    # A centre's text comes again and again: each distinct id of the piece is cut once.
                    ids = piece.column(side).to_pylist()
                    rows = list({i: k for k, i in enumerate(ids) if i not in kept}.values()) if side == "b" else range(len(ids))
                    s, starts, w = elements(*ragged.hashed(piece.column("t" + side).take(pa.array(rows, pa.int64()))), shared.value)
                    cut = []
                    for x, y in zip(starts[:-1], starts[1:], strict=True):
                        order = np.argsort(s[x:y])
                        cut.append((s[x:y][order], w[x:y][order]))
                    if side == "a":
                        sides["a"] = cut
                    else:
                        if len(kept) > 50:
                            lost = {i for i in ids if i in kept}
                            kept = {i: kept[i] for i in lost}
                        kept.update((ids[k], c) for k, c in zip(rows, cut, strict=True))
                        sides["b"] = [kept[i] for i in ids]
                sim = np.array([similarity(x, y) for x, y in zip(sides["a"], sides["b"], strict=True)], dtype=np.float64)
                good = pa.array(sim >= threshold)
                yield pa.RecordBatch.from_arrays([piece.column("a").filter(good), piece.column("b").filter(good), pa.array(sim).filter(good)], ["a", "b", "similarity"])
        ragged.release()

    joined = (
        pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        .select("a", "b", "ta", "tb")
    )
    kind = dict(pairs.dtypes)["a"]
    return work.save(work.map_arrow(joined, run, f"a {kind}, b {kind}, similarity double"), "near-links")


def _linker(shared, threshold: float) -> Callable[[pa.Table], pa.Table]:
    """Links of the bucket blocks that a task holds: of each two components at most one, the others follow from it."""

    def run(table: pa.Table) -> pa.Table:
        key, node, label, block, i, j = (np.asarray(table.column(c)) for c in ("key", "node", "label", "block", "i", "j"))
        distinct, first, at = np.unique(node, return_index=True, return_inverse=True)
        texts = pa.RecordBatch.from_arrays([table.column("text").take(pa.array(first)).combine_chunks()], ["text"])
        parts = [elements(*ragged.hashed(piece.column("text")), shared.value) for piece in ragged.pieces(texts)]
        s, w = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
        out: dict[tuple[int, int], float] = {}
        order = np.lexsort((node, key))
        for rows in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            left, right = rows[block[rows] == i[rows]], rows[block[rows] == j[rows]]
            if not len(left) or not len(right):
                continue
            share = allpairs.similarities(s, w, starts, at[left], at[right])
            apart = label[left][:, None] != label[right]
            # Near the threshold single precision does not decide.
            for x, y in zip(*np.nonzero(apart & (np.abs(share - threshold) < 1e-4)), strict=True):
                sets = []
                for n in (at[left[x]], at[right[y]]):
                    one = np.argsort(s[starts[n] : starts[n + 1]])
                    sets.append((s[starts[n] : starts[n + 1]][one], w[starts[n] : starts[n + 1]][one]))
                share[x, y] = 1 if similarity(*sets) >= threshold else 0
            for x, y in allpairs.joining(apart & (share >= threshold), label[left], label[right]):
                a, b = int(node[left[x]]), int(node[right[y]])
                out[max(a, b), min(a, b)] = float(share[x, y])
        ragged.release()
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64()), pa.array(out.values(), pa.float64())], ["a", "b", "similarity"])

    return run


def open_buckets(stars: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, size of the buckets of three or more that span components; buckets of the same members once."""
    labelled = stars.where("n > 2").join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    of = [F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (1, 2)]
    spans = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes"), *of).where("low <> high")
    once = spans.groupBy("n", "x1", "x2").agg(F.min("key").alias("key"), F.first("bytes").alias("bytes"))
    return labelled.join(once, "key").select("key", "node", "label", "n", "bytes")


def links(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed documents, verified links (a, b, similarity) between representatives, components of the links)."""
    # Damped by a root, so that a few rare words cannot outweigh a text that is otherwise the same.
    idf = np.sqrt(weights.idf(*weights.frequencies(docs, text)))
    signed = work.save(sign(docs, idf, text, doc_id), "near-signed")
    reps = signed.where("doc_id IS NOT NULL").groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    members = work.save(reps.select("node", "size", F.explode("bands").alias("key")), "near-members")
    centres = work.save(members.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "near-centres")
    stars = members.join(centres, "key")
    pairs = work.save(stars.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "near-pairs")
    # All members of any bucket are in these pairs, so the blocks need no other texts.
    texts = texts_of(pairs, docs, text, doc_id)
    found = verify(pairs, texts, idf)
    labels = components(found)
    rest = work.save(open_buckets(stars, labels), "near-open")
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(BLOCK_ROWS)), F.ceil(F.col("bytes") / F.lit(BLOCK_BYTES))).cast("int")
    deals = max(1, (rest.agg(F.sum(F.col("bytes") / F.col("n"))).first()[0] or 0) // BLOCK_BYTES)
    rest = rest.select("key", "node", "label", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    # Small buckets are dealt out many to a task, large ones by pairs of blocks.
    small = rest.where("blocks = 1").select("key", "node", "label", "block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.pmod(F.xxhash64("key"), F.lit(int(deals))).alias("deal"))
    large = rest.where("blocks > 1").select("key", "node", "label", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("key", "node", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("key").alias("deal"))
    dealt = small.unionByName(large).join(texts.withColumnRenamed("id", "node"), "node")
    linker = _linker(docs.sparkSession.sparkContext.broadcast(idf), THRESHOLD)
    more = work.save(dealt.groupBy("deal", "i", "j").applyInArrow(linker, "a long, b long, similarity double"), "near-links")
    if not more.isEmpty():
        # The labels are edges that stand for all earlier links.
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more.select("a", "b")))
    return signed, found.unionByName(more), labels


def _classes(rows: DataFrame) -> DataFrame:
    """doc_id, class_id, copies of rows (uid, text), ids and classes being uids."""
    signed, _, labels = links(rows, "text", "uid")
    groups = signed.groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    classes = groups.join(labels, "node", "left").select("t1", "t2", F.coalesce("label", "node").alias("class_id"), "copies")
    return signed.select("doc_id", "t1", "t2").join(classes, ["t1", "t2"]).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"), "copies")


def classify(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id (the least id of the class), copies (rows with equal words) for every row."""
    known = work.identified(docs, text, doc_id)
    found = _classes(known.rows.select("uid", "text"))
    if known.names is None:
        return found
    found = known.named(work.save(found, "near-classes").withColumn("class_uid", F.col("class_id")), "doc_id")
    least = found.groupBy("class_uid").agg(F.min("doc_id").alias("class_id")).where("class_uid IS NOT NULL")
    return found.drop("class_id").join(least, "class_uid", "left").select("doc_id", "class_id", "copies")


def accept(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class, all columns kept: that of the least id, or one of those whose id has several texts; rows with a null id all stay."""
    known = work.identified(docs, text, doc_id)
    gone = work.save(_classes(known.rows.select("uid", "text")).where("doc_id <> class_id").select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    few = gone.count() <= BROADCAST_IDS
    kept = known.rows.select("row", "uid").join(F.broadcast(gone) if few else gone, F.col("uid") == F.col("gone"), "left_anti")
    if not known.rows.groupBy("uid").count().where("count > 1 AND uid IS NOT NULL").isEmpty():
        kept = kept.where("uid IS NULL").unionByName(kept.where("uid IS NOT NULL").dropDuplicates(["uid"]))
    return kept.select("row.*")
