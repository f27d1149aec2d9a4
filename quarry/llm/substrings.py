"""Substring dedup: MinHash banding of overlapping paragraphs.

A paragraph is LENGTH words that start at an anchor; anchors are the least
hashes of word pairs in every window of SPREAD places (winnowing), so they
depend on nearby words alone and any passage of LENGTH + SPREAD words or more
that two documents share has an anchor, and so a paragraph, in common, wherever
it stands.  Paragraphs of equal words form a class by hash; the classes that
collide in a band are compared, all pairs of a bucket, by exact Jaccard similarity
of their shingles, and clustered by connected components.
Of each component the first occurrence (least document id, then place) stays,
all others are removals.  A removal at the edge of a repeat, or with words between
it and the next, is compared word by word with the words around its kept
occurrence, up to SPREAD before and after, so a passage that repeats goes from its
first word to its last.  A document's removals merge into spans.

Defined results: texts of fewer than LENGTH words, null and empty ones have no
paragraphs; rows with a null id are not compared; equal rows are one
document, different texts of one id are documents of their own; repeats inside a document count too; ties go to the least id and
place; other columns pass through `cut`.  Equal paragraphs, however many, are
one row per task before any shuffle by class or band; nothing is collected but
counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import allpairs, ragged, work
from .components import components

LENGTH, SPREAD, WIDTH = 22, 28, 5
THRESHOLD = 0.8
#: 1 - (1 - 0.8^2)^3 = 0.953 of pairs at the threshold share a band, 0.993 at 0.9.
BANDS, ROWS = 3, 2
#: Classes of a bucket that a task compares with as many others at once, rows of small buckets that it is given together,
#: and classes of a bucket up to which buckets of one size are compared together.
BLOCK, DEAL, TOGETHER = 1024, 20_000, 6
#: Classes that a task remembers to have given bands.
REMEMBERED = 400_000
_ODD = np.random.default_rng(41).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(values: np.ndarray, size: int, of: np.ufunc) -> np.ndarray:
    """of(values[i : i + size]) for every i for which it is inside, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = of(out[:-step], out[step:])
        have += step
    return out


def anchors(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the paragraphs, in order, and the row of each."""
    n = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    ends = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(offsets[:-1], n)
    if not len(at):
        return at, row
    score = ragged.mix(h[at] * np.uint64(3) + h[at + 1]) | np.uint64(1)
    chosen = np.zeros(len(at), dtype=bool)
    if len(at) >= SPREAD:
        least = rolling(score, SPREAD, np.minimum)
        least[row[: len(least)] != row[SPREAD - 1 :]] = 0  # windows across rows choose nothing
        padded = np.concatenate([np.zeros(SPREAD - 1, np.uint64), least, np.zeros(SPREAD - 1, np.uint64)])
        chosen = rolling(padded, SPREAD, np.maximum) == score
    # A row with fewer places than a window has its least.
    short = np.flatnonzero((n > 0) & (n < SPREAD))
    if len(short):
        least_of = np.minimum.reduceat(score, ends[:-1][n > 0])[np.searchsorted(np.flatnonzero(n > 0), short)]
        inside = np.zeros(len(n), np.uint64)
        inside[short] = least_of
        chosen |= inside[row] == score
    return at[chosen], row[chosen]


def grams(h: np.ndarray) -> np.ndarray:
    """A hash of the WIDTH words from each place on."""
    padded = np.concatenate([h, np.zeros(WIDTH, np.uint64)])
    out = np.zeros(len(h), np.uint64)
    for k in range(WIDTH):
        out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(h)]
    return ragged.mix(out)


def classes_at(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class (a hash of the words) of the paragraph at each place."""
    g = grams(h)
    every = np.zeros(len(at), np.uint64)
    for k in range(0, LENGTH - WIDTH + 1):
        every = every * np.uint64(0xD6E8FEB86659FD93) + g[at + k]
    return ragged.mix(every).view(np.int64)


def keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class (a hash of the paragraph's words) and the band keys of each paragraph."""
    g = grams(h)
    span = at[:, None] + np.arange(LENGTH - WIDTH + 1)
    least = np.stack([ragged.mix(g * odd)[span].min(axis=1) for odd in _ODD], axis=1) if len(at) else np.zeros((0, BANDS * ROWS), np.uint64)
    bands = np.zeros((len(at), BANDS), np.uint64)
    for k in range(ROWS):
        bands = ragged.mix(bands * np.uint64(31) + least[:, k::ROWS] + np.arange(BANDS, dtype=np.uint64))
    return classes_at(h, at), bands.view(np.int64)


def homes_of(bands: np.ndarray, at: np.ndarray, row: np.ndarray, offsets: np.ndarray, ids: pa.Array) -> np.ndarray:
    """A number for each paragraph and band: paragraphs that overlap one before them in the same document, in the same band, share its number.

    A band's bucket with one number holds such paragraphs alone, of which no pair is a repeat."""
    head = np.broadcast_to(np.arange(len(at))[:, None], bands.shape).copy()
    for lag in (1, 2, 3):
        near = (row[lag:] == row[:-lag]) & (at[lag:] - at[:-lag] < LENGTH)
        same = near[:, None] & (bands[lag:] == bands[:-lag])
        head[lag:] = np.where(same, np.arange(len(same))[:, None], head[lag:])
    further = np.take_along_axis(head, head, axis=0)
    head = np.where(at[:, None] - at[further] < LENGTH, further, head)
    name = np.fromiter((xxhash.xxh64_intdigest(str(x)) for x in ids.to_pylist()), dtype=np.uint64, count=len(ids))
    place = ragged.mix(name[row] + (at - offsets[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (place >> np.uint64(32)).astype(np.uint32).view(np.int32)[head]


def paragraphs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, pos (first word), ph (class), bands, homes (see homes_of); of the equal paragraphs that a task meets soon after each other only the first carries bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.int64)
        for batch in batches:
            for piece in ragged.pieces(batch):
                h, offsets = ragged.hashed(piece.column("text"))
                at, row = anchors(h, offsets)
                ph, bands = keys(h, at)
                fresh = np.zeros(len(ph), dtype=bool)
                fresh[np.unique(ph, return_index=True)[1]] = True
                if len(seen):
                    fresh &= seen[np.minimum(np.searchsorted(seen, ph), len(seen) - 1)] != ph
                seen = np.union1d(seen, ph[fresh]) if len(seen) < REMEMBERED else np.unique(ph)
                ends = pa.array(np.concatenate([[0], np.cumsum(fresh * BANDS)]).astype(np.int32))
                homes = pa.array(homes_of(bands, at, row, offsets, piece.column("doc_id"))[fresh].reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array(row)), pa.array((at - offsets[row]).astype(np.int32)), pa.array(ph), pa.ListArray.from_arrays(ends, pa.array(bands[fresh].reshape(-1))), pa.ListArray.from_arrays(ends, homes)],
                    ["doc_id", "pos", "ph", "bands", "homes"],
                )
        ragged.release()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id IS NOT NULL")
    return work.map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, pos int, ph long, bands array<long>, homes array<int>")


def shingle_sets(docs: DataFrame, places: DataFrame, text: str, doc_id: str) -> DataFrame:
    """ph, doc_id, pos and shingles (32-bit hashes) of the paragraphs at places (doc_id, pos, ph)."""
    at = work.save(places.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "ph")).alias("at")), "paragraph-places")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(at, "doc_id").select("doc_id", "text", F.transform("at", lambda x: x["pos"]).alias("pos"), F.transform("at", lambda x: x["ph"]).alias("ph"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in ragged.pieces(batch):
                h, offsets = ragged.hashed(piece.column("text"))
                g = grams(h)
                pos, ph = piece.column("pos"), piece.column("ph")
                n = np.asarray(pos.value_lengths(), dtype=np.int64)
                first = np.asarray(pos.flatten(), dtype=np.int64) + np.repeat(offsets[:-1], n)
                size = LENGTH - WIDTH + 1
                flat = (g[first[:, None] + np.arange(size)] >> np.uint64(32)).astype(np.uint32).reshape(-1).view(np.int32)
                own = piece.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n)))
                sets = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * size), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ph.flatten(), own, pos.flatten(), sets], ["ph", "doc_id", "pos", "shingles"])
        ragged.release()

    return work.map_arrow(rows, run, f"ph long, doc_id {dict(rows.dtypes)['doc_id']}, pos int, shingles array<int>")


def linked(table: pa.Table, threshold: float = THRESHOLD) -> pa.Table:
    """Links (a, b) of the buckets that a task holds: rows key, ph, doc_id, pos, shingles, block, i, j.

    Small buckets of one size are compared together, all pairs of each; a large
    bucket's two blocks as matrices, of which the links that join anything leave."""
    key, ph, pos, block, i, j = (np.asarray(table.column(c)) for c in ("key", "ph", "pos", "block", "i", "j"))
    # Documents count by number: ids may be of any type.
    doc = np.asarray(table.column("doc_id").combine_chunks().dictionary_encode().indices)
    sets = np.asarray(table.column("shingles").combine_chunks().flatten()).reshape(len(key), -1) if len(key) else np.zeros((0, 1), np.int32)
    order = np.lexsort((ph, key))
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))[: len(key)]
    size = np.diff(np.append(first, len(key)))
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)]
    one = (i == 0) & (j == 0) & (block == 0)

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        # Paragraphs that overlap in one document share words without a repeat.
        apart = (doc[x] != doc[y]) | (np.abs(pos[x] - pos[y]) >= LENGTH)
        out.append(np.stack([np.maximum(ph[x], ph[y])[apart], np.minimum(ph[x], ph[y])[apart]], axis=1))

    for n in range(2, TOGETHER + 1):
        rows = order[first[(size == n) & one[order[first]]][:, None] + np.arange(n)]
        for x, y in combinations(range(n), 2):
            for k in range(0, len(rows), 20_000):
                a, b = rows[k : k + 20_000, x], rows[k : k + 20_000, y]
                # Both sides may repeat a shingle: only different ones count.
                sa, sb = np.sort(sets[a], axis=1), np.sort(sets[b], axis=1)
                new_a, new_b = (np.diff(z, axis=1, prepend=z[:, :1] - 1) != 0 for z in (sa, sb))
                both = ((sa[:, :, None] == sb[:, None, :]).any(axis=2) & new_a).sum(axis=1)
                good = both >= threshold * (new_a.sum(axis=1) + new_b.sum(axis=1) - both)
                keep(a[good], b[good])
    for f, n in zip(first, size, strict=True):
        rows = order[f : f + n]
        if n <= TOGETHER and one[rows[0]]:
            continue
        left, right = (np.flatnonzero(block[rows] == z[rows[0]]) for z in (i, j))
        if not len(left) or not len(right):
            continue
        flat = [np.unique(x) for x in sets[rows]]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in flat])])
        s = np.concatenate(flat)
        share = allpairs.similarities(s, np.ones(len(s), np.float32), starts, left, right)
        near = (doc[rows][left][:, None] == doc[rows][right]) & (np.abs(pos[rows][left][:, None] - pos[rows][right]) < LENGTH)
        for x, y in allpairs.joining((share >= threshold - 1e-6) & ~near & (left[:, None] != right), ph[rows][left], ph[rows][right]):
            keep(rows[left[x : x + 1]], rows[right[y : y + 1]])
    ragged.release()
    found = np.unique(np.concatenate(out), axis=0)
    return pa.table([found[:, 0], found[:, 1]], ["a", "b"])


def contexts(docs: DataFrame, places: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, pos, before, after: 32-bit hashes of the SPREAD words next to the paragraph at each of places (doc_id, pos), nearest first; 0 is no word."""
    at = work.save(places.groupBy("doc_id").agg(F.collect_set("pos").alias("at")), "paragraph-edges-of")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).join(at, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = np.arange(SPREAD)
        for batch in batches:
            for piece in ragged.pieces(batch):
                h, offsets = ragged.hashed(piece.column("text"))
                short = np.append((h >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.uint32(0))
                n = np.asarray(piece.column("at").value_lengths(), dtype=np.int64)
                row = np.repeat(np.arange(len(n)), n)
                first = np.asarray(piece.column("at").flatten(), dtype=np.int64) + offsets[row]
                # A row of a repeated id may be shorter than the one whose places these are.
                inside = first + LENGTH <= offsets[row + 1]
                row, first = row[inside], first[inside]
                before, after = first[:, None] - 1 - step, first[:, None] + LENGTH + step
                before = short[np.where(before >= offsets[row][:, None], before, len(h))]
                after = short[np.where(after < offsets[row + 1][:, None], after, len(h))]
                ends = pa.py_buffer(np.arange(len(row) + 1, dtype=np.int32) * (4 * SPREAD))
                sides = [pa.Array.from_buffers(pa.binary(), len(row), [None, ends, pa.py_buffer(np.ascontiguousarray(x))]) for x in (before, after)]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row)), pa.array((first - offsets[row]).astype(np.int32)), *sides], ["doc_id", "pos", "before", "after"])
        ragged.release()

    return work.map_arrow(rows, run, f"doc_id {dict(rows.dtypes)['doc_id']}, pos int, before binary, after binary")


def reaches(edges: DataFrame, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Of edges (doc_id, pos, kept): doc_id, pos, kept, left and right, the words by which the repeat goes on before and after the paragraph."""
    at = edges.select("doc_id", "pos").unionByName(edges.select("kept.doc_id", "kept.pos")).distinct()
    near = work.save(contexts(docs, at, text, doc_id), "paragraph-contexts")
    of = lambda x: near.groupBy("doc_id", "pos").agg(F.min("before").alias(f"{x}before"), F.min("after").alias(f"{x}after"))  # noqa: E731  repeated rows
    both = edges.join(of("x"), ["doc_id", "pos"]).alias("e")
    both = both.join(of("y").select(F.struct("doc_id", "pos").alias("kept"), "ybefore", "yafter"), "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(-1, SPREAD) for c in ("xbefore", "ybefore", "xafter", "yafter")}
            n = [np.cumprod((grid["x" + c] == grid["y" + c]) & (grid["x" + c] > 0), axis=1).sum(axis=1).astype(np.int32) for c in ("before", "after")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("pos"), batch.column("kept"), *map(pa.array, n)], ["doc_id", "pos", "kept", "left", "right"])

    kinds = dict(edges.dtypes)
    return work.map_arrow(both, run, f"doc_id {kinds['doc_id']}, pos int, kept {kinds['kept']}, left int, right int")


def near_links(docs: DataFrame, paras: DataFrame, classes: DataFrame, text: str, doc_id: str, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b) between classes of different words; classes: ph, first (struct of doc_id and pos)."""
    # One shuffle by key serves the count of a bucket's classes and the rows of those with several.
    banded = paras.select("ph", F.explode(F.arrays_zip("bands", "homes")).alias("b")).select("ph", F.col("b.bands").alias("key"), F.col("b.homes").alias("home"))
    banded = banded.repartition("key").groupBy("key", "ph").agg(F.min("home").alias("home"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), F.min("home").alias("low"), F.max("home").alias("high"), *[F.bit_xor(F.xxhash64(F.lit(k), "ph")).alias(f"x{k}") for k in (1, 2)]).where("n > 1 AND low <> high")
    # Buckets of the same classes count once.
    once = work.save(sizes.groupBy("n", "x1", "x2").agg(F.min("key").alias("key")).select("key", "n"), "paragraph-buckets")
    members = work.save(banded.join(once, "key").select("key", "ph", "n"), "paragraph-members")
    places = members.select("ph").distinct().join(classes, "ph").select("first.doc_id", "first.pos", "ph")
    sets = shingle_sets(docs, places, text, doc_id)
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    total = members.agg(F.coalesce(F.count("*"), F.lit(0))).first()[0]
    rows = members.select("key", "ph", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("ph"), "blocks").cast("int"))
    small = rows.where("blocks = 1").select("key", "ph", "block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.pmod(F.xxhash64("key"), F.lit(max(1, total // DEAL))).alias("deal"))
    large = rows.where("blocks > 1").select("key", "ph", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("key", "ph", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), F.col("key").alias("deal"))
    dealt = small.unionByName(large).join(sets, "ph")
    found = dealt.groupBy("deal", "i", "j").applyInArrow(lambda t: linked(t, threshold), "a long, b long")
    out = work.save(found.distinct(), "paragraph-links")
    work.discard(once, members)
    return out


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, spans (array of struct(start, end) in words), n_removed (words), kept_in (ids where the text stays), uid, for
    documents that lose text; uid is the id, but tells the texts of one id apart (see work.identified)."""
    known = work.identified(docs, text, doc_id)
    found = _removals(known.rows.select("uid", "text"), "text", "uid").withColumn("uid", F.col("doc_id"))
    if known.names is None:
        return found
    found = work.save(found, "removals")
    kept = known.named(found.select("uid", F.explode("kept_in").alias("kept")), "kept").groupBy("uid").agg(F.sort_array(F.collect_set("kept")).alias("kept_in"))
    return known.named(found.drop("kept_in").join(kept, "uid"), "doc_id").select("doc_id", "spans", "n_removed", "kept_in", "uid")


def _removals(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    paras = work.save(paragraphs(docs, text, doc_id), "paragraphs")
    classes = work.save(paras.groupBy("ph").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count("*").alias("n")), "paragraph-classes")
    labels = work.save(components(near_links(docs, paras, classes, text, doc_id)), "paragraph-labels")
    grouped = classes.join(labels, F.col("ph") == F.col("node"), "left").where("n > 1 OR label IS NOT NULL").select("ph", "first", "label")
    joined = grouped.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least"))
    kept = grouped.join(joined, "label", "left").select("ph", F.coalesce("least", "first").alias("kept"))
    hits = paras.select("doc_id", "pos", "ph").join(kept, "ph").select("doc_id", "pos", "kept")
    gone = hits.where(F.struct("doc_id", "pos") != F.col("kept"))
    # A repeat goes on beyond its first and last paragraph, and over the words between two that do not touch.  Paragraphs
    # that are no more than SPREAD words from bare ones are compared with what is around their kept occurrence, the
    # others lie inside a covered run.
    line = Window.partitionBy("doc_id").orderBy("pos")
    gone = gone.withColumn("starts", F.coalesce(F.lag("pos").over(line) + LENGTH < F.col("pos"), F.lit(True)))
    gone = gone.withColumn("from", F.max(F.when(F.col("starts"), F.col("pos"))).over(line.rangeBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy("doc_id").orderBy(F.col("pos").desc())
    gone = gone.withColumn("next", F.lead("pos").over(line)).withColumn("to", F.min(F.when(F.coalesce(F.col("next") > F.col("pos") + LENGTH, F.lit(True)), F.col("pos"))).over(back.rangeBetween(Window.unboundedPreceding, 0)))
    along = lambda f: (lambda x: F.coalesce((x["kept"]["doc_id"] == F.col("kept.doc_id")) & (x["pos"] - x["kept"]["pos"] == F.col("pos") - F.col("kept.pos")), F.lit(False)))(f(F.struct("pos", "kept")).over(line))
    # Between two paragraphs of one alignment that touch nothing is left to find.
    bare = ((F.col("pos") - F.col("from") <= SPREAD) & (F.col("starts") | ~along(F.lag))) | ((F.col("to") - F.col("pos") <= SPREAD) & ((F.col("to") == F.col("pos")) | ~along(F.lead)))
    gone = work.save(gone.select("doc_id", "pos", "kept", bare.alias("bare")), "paragraph-gone")
    work.discard(paras, classes, labels)
    inner = gone.where("NOT bare").select("doc_id", "pos", "kept", F.lit(0).alias("left"), F.lit(0).alias("right"))
    gone = inner.unionByName(reaches(gone.where("bare").select("doc_id", "pos", "kept"), docs, text, doc_id))
    # What stays is not cut by its own repeat, where the two overlap.
    start = F.col("pos") - F.col("left")
    own = F.when((F.col("kept.doc_id") == F.col("doc_id")) & (F.col("kept.pos") < F.col("pos")), F.greatest(start, F.col("kept.pos") + LENGTH)).otherwise(start)
    gone = gone.select("doc_id", F.struct(own.cast("int").alias("start"), (F.col("pos") + LENGTH + F.col("right")).cast("int").alias("end")).alias("span"), F.col("kept.doc_id").alias("kept_in"))
    return merged(gone.groupBy("doc_id").agg(F.collect_set("span").alias("at"), F.sort_array(F.collect_set("kept_in")).alias("kept_in")))


def merged(spans: DataFrame) -> DataFrame:
    """Of rows (doc_id, at, kept_in): doc_id, the merged spans of at, their words n_removed, kept_in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(at.value_lengths(), dtype=np.int64))
            start, end = (np.asarray(at.flatten().field(k), dtype=np.int64) for k in (0, 1))
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], end[order]
            # Rows apart on one line, so that a running maximum stays within its row.
            far = int(end.max(initial=0)) + 1
            upto = np.maximum.accumulate(end + row * far) if len(row) else end
            new = np.append(True, (row[1:] != row[:-1]) | (start[1:] + row[1:] * far > upto[:-1]))[: len(row)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(row))[: len(first)] - 1
            a, b, of = start[first], (upto - row * far)[last], row[first]
            ends = np.searchsorted(of, np.arange(batch.num_rows + 1))
            flat = pa.StructArray.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["start", "end"])
            total = np.bincount(of, weights=b - a, minlength=batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat), pa.array(total), batch.column("kept_in")], ["doc_id", "spans", "n_removed", "kept_in"])

    kinds = dict(spans.dtypes)
    return work.map_arrow(spans, run, f"doc_id {kinds['doc_id']}, spans array<struct<start:int,end:int>>, n_removed long, kept_in {kinds['kept_in']}")


def cut(docs: DataFrame, removed: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (a struct of the input's columns) and kept, the text without its removed spans, for every row."""
    wrapped = work.identified(docs, text, doc_id).rows
    rows = wrapped.join(removed.select(F.col("uid").alias("of"), "spans"), F.col("uid") == F.col("of"), "left")
    rows = rows.select("row", "text", F.transform("spans", lambda s: s["start"]).alias("start"), F.transform("spans", lambda s: s["end"]).alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        for batch in batches:
            out = []
            for t, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "end")), strict=True):
                if not starts or t is None:
                    out.append(t)
                    continue
                at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)]
                parts, done = [], 0
                for a, b in zip(starts, ends, strict=True):
                    parts.append(t[done : at[a][0]])
                    done = at[b - 1][1]
                out.append("".join([*parts, t[done:]]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.string())], ["row", "kept"])

    return work.map_arrow(rows, run, f"row {wrapped.schema['row'].dataType.simpleString()}, kept string")
