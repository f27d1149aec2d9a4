"""Benchmark decontamination by latent semantic retrieval.

Passages are windows of WINDOW words at every STRIDE words of a document, and
at every word of a benchmark item.  Their TF-IDF vectors (hashed words, document
frequencies of the whole corpus) are projected on the leading right singular
vectors of the passage-term matrix of all documents, found by a distributed randomised
SVD: of the start, RANK directions are first turned by the passages of about FIT_DOCS
documents, chosen by hash, EXTRA ones are random; one pass over all passages then gives
the basis and its singular values.
Every document is searched.  Candidates are pairs of windows with a cosine of
MIN_COSINE or more (less for items that are too short to align with a window), found through clusters of the benchmark windows; a candidate
counts when the longest common subsequence of the item and the aligned part of
the document covers MIN_LCS of the item's words, and the answer check finds
MIN_ANSWER of the item's most informative words there.

Defined results: null and empty documents or items match nothing; items of one
to three words are skipped, they say too little; a null item id is carried;
repeated rows match alike; equal pairs of ids are reported once with their best
figures; other columns pass through `accept` whatever their names.  The query
set is broadcast in blocks of about BLOCK_WINDOWS windows (an item stays whole), one
pass over the documents each; nothing else is shuffled but partial sums of the SVD and the matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, weights, work

WINDOW, STRIDE = 12, 6
TERMS, RANK, EXTRA, ROUNDS = 1 << 15, 48, 8, 2
FIT_DOCS, FIT_DOCS_A_TASK = 3000, 1000
#: Documents of one of the tasks that sum over all of them, and the most such tasks (but one a core): each hands on sums of the size of the basis.
DOCS_A_TASK, MOST_TASKS = 20_000, 256
#: Bytes of text whose passages are summed at once: their vectors stay near the processor.
GRAM_BYTES = 250_000
MIN_COSINE, MIN_LCS, MIN_ANSWER = 0.88, 0.7, 0.5
MIN_WORDS = 4
#: Each benchmark window lies in this many clusters, the nearest; a document window looks into one.  Those of short items lie in more.
NEAREST, NEAREST_SHORT = 3, 8
#: Benchmark windows of one pass over the documents; what the driver holds and broadcasts (about 400 bytes a window) is bounded by them.
BLOCK_WINDOWS = 200_000
SLACK = 5
#: Different words that two windows of a candidate must share, at least (or all that the benchmark window has).
COMMON = 6
BROADCAST_IDS = 1_000_000


def term(word_hashes: np.ndarray) -> np.ndarray:
    return (word_hashes & np.uint64(TERMS - 1)).astype(np.int64)


def blocks(offsets: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks of `stride` words and the offsets of rows into them; a row's last block may be shorter."""
    n = -(-np.diff(offsets) // stride)
    ends = np.concatenate([[0], np.cumsum(n)])
    return np.repeat(offsets[:-1] - ends[:-1] * stride, n) + np.arange(ends[-1]) * stride, ends


def passages(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every window of a piece: two blocks in a row, or a row's only block."""
    start, ends = blocks(offsets)
    n = np.diff(ends)
    row = np.repeat(np.arange(len(n)), n)
    last = np.zeros(len(start), dtype=bool)
    last[ends[1:][n > 1] - 1] = True
    at = np.flatnonzero(~last)
    stop = np.minimum(start[at] + WINDOW, offsets[1:][row[at]])
    return start[at], stop, row[at]


# ---- the latent space


def add_runs(total: np.ndarray, keys: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> None:
    """Adds vectors[at[i]] to total[keys[i]], for ascending keys: the rows of a key are added up in pairs, again and again."""
    begin = np.flatnonzero(np.diff(keys, prepend=-1))
    n, key = np.diff(np.append(begin, len(keys))), keys[begin]
    while len(n):
        done = n == 1
        total[key[done]] += vectors.take(at[begin[done]], axis=0)
        begin, n, key = begin[~done], n[~done], key[~done]
        half = (n + 1) // 2
        ends = np.cumsum(half)
        left = np.arange(half.sum()) * 2 + np.repeat(begin - 2 * (ends - half), half)
        pair = np.flatnonzero(left + 1 < np.repeat(begin + n, half))
        x = vectors.take(at[left], axis=0)
        if len(pair) == len(x):
            x += vectors.take(at[left + 1], axis=0)
        else:
            x[pair] += vectors.take(at[left[pair] + 1], axis=0)
        vectors, at, begin, n = x, np.arange(len(x)), ends - half, half


def add_passages(total: np.ndarray, h: np.ndarray, offsets: np.ndarray, weight: np.ndarray, table: np.ndarray) -> None:
    """Adds, for the unit-length TF-IDF passages of a piece, its share of A'A basis to total by bucket, but for the words' own weights; table: word_vectors of the basis."""
    b = weights.bucket(h)
    # Of a block: the sum of its words' vectors, and of their squared weights; a passage is two of them, or a row's only one.
    start, ends = blocks(offsets)
    size = np.diff(np.append(start, len(h)))
    sums = project(h, start, start + size, table)
    squares = np.add.reduceat(weight[b] ** 2, start)
    first, stop, _ = passages(offsets)
    one = np.searchsorted(start, first)
    more = np.flatnonzero(stop - first > STRIDE)
    two = one[more] + 1
    seen, norm = sums.take(one, axis=0), squares[one]
    seen[more] += sums.take(two, axis=0)
    norm[more] += squares[two]
    seen /= norm[:, None]
    back = np.zeros_like(sums)
    back[one] = seen
    back[two] += seen.take(more, axis=0)
    # By bucket: sorts of 16 bits count instead of comparing.
    order = np.argsort((b & 0xFFFF).astype(np.uint16), kind="stable")
    order = order[np.argsort((b[order] >> 16).astype(np.uint16), kind="stable")]
    add_runs(total, b[order], back, np.repeat(np.arange(len(size)), size)[order])


def folded(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The sums by bucket, times the words' weights, as sums by term."""
    return np.sum((weight[:, None] * total).reshape(-1, TERMS, total.shape[1]), axis=0, dtype=np.float32)


def _gram(rows: DataFrame, basis: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A'A basis over the TF-IDF passages A of the rows, summed in blocks of terms."""
    shared = rows.sparkSession.sparkContext.broadcast((basis.astype(np.float32), idf))
    width, parts = basis.shape[1], 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, weight = shared.value
        table = word_vectors(weight, q)
        total = np.zeros((weights.BUCKETS, width), dtype=np.float32)
        for batch in batches:
            for piece in ragged.pieces(batch, limit=GRAM_BYTES):
                h, offsets = ragged.hashed(piece.column("text"))
                if len(h):
                    add_passages(total, h, offsets, weight, table)
        total = folded(total, weight)
        rows_per = TERMS // parts
        yield pa.RecordBatch.from_arrays([pa.array(range(parts)), pa.array([total[k * rows_per : (k + 1) * rows_per].tobytes() for k in range(parts)])], ["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x.as_py(), dtype=np.float32) for x in group["sums"]], axis=0, dtype=np.float32)
        return pa.table({"part": group["part"].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    out = work.map_arrow(rows, run, "part long, sums binary").groupBy("part").applyInArrow(add, "part long, sums binary").toArrow().sort_by("part")
    return np.concatenate([np.frombuffer(x.as_py(), dtype=np.float32) for x in out["sums"]]).reshape(TERMS, width).astype(np.float64) if out.num_rows else np.zeros((TERMS, width))


def fit(docs: DataFrame, n_docs: int, idf: np.ndarray, text: str = "text", doc_id: str = "doc_id", seed: int = 3) -> np.ndarray:
    """TERMS x RANK: right singular vectors, each divided by its singular value, so that all directions count alike."""
    share = min(1.0, FIT_DOCS / max(1, n_docs))
    chosen = docs.where(F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.col(text).cast("string").alias("text"))
    # Each task makes a partial sum of the size of the basis, so there are few.
    chosen = work.save(chosen.repartition(max(1, round(min(n_docs, FIT_DOCS) / FIT_DOCS_A_TASK))), "fit-passages")
    basis = np.random.default_rng(seed).standard_normal((TERMS, RANK + EXTRA))
    for _ in range(ROUNDS):
        basis, _ = np.linalg.qr(_gram(chosen, basis, idf))
    q, _ = np.linalg.qr(np.concatenate([basis[:, :RANK], np.random.default_rng(seed + 1).standard_normal((TERMS, EXTRA)) / np.sqrt(TERMS)], axis=1))
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, min(MOST_TASKS, -(-n_docs // DOCS_A_TASK)))
    y = _gram(docs.select(F.col(text).cast("string").alias("text")).coalesce(tasks), q, idf)
    # Of all passages, A'A is y (q'y)^-1 y' on the space that y spans (Nystrom).
    value, vector = np.linalg.eigh((q.T @ y + y.T @ q) / 2)
    held = value > max(1e-12, 1e-9 * value[-1])
    u, strength, _ = np.linalg.svd(y @ (vector / np.sqrt(np.where(held, value, np.inf))), full_matrices=False)
    return (u[:, :RANK] / np.maximum(strength[:RANK], 1e-6)).astype(np.float32)


# ---- the query set


@dataclass
class Items:
    ids: list
    words: list[np.ndarray]  # hashes of each item's words
    informative: list[np.ndarray]
    item: np.ndarray  # of each window
    offset: np.ndarray
    vectors: np.ndarray
    least: np.ndarray  # cosine that a document window must reach
    centres: np.ndarray
    members: list[np.ndarray]
    windows: np.ndarray  # word hashes, padded with 1
    sizes: np.ndarray
    bits: np.ndarray


def word_vectors(idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A row for each bucket of the document frequencies, which hold the terms' buckets in their low bits; a last row of zeros."""
    return np.concatenate([idf[:, None] * basis[np.arange(weights.BUCKETS) % TERMS], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32, copy=False)


def project(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of word vectors over blocks of up to STRIDE words."""
    b = np.append(weights.bucket(h), weights.BUCKETS)
    out = table.take(b[starts], axis=0)
    for k in range(1, STRIDE):
        out += table.take(b[np.where(starts + k < stops, starts + k, len(h))], axis=0)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)[:, None]


def least_cosine(n_words: np.ndarray) -> np.ndarray:
    """MIN_COSINE for items that some document window covers as one of theirs does; for shorter ones times the share that the best aligned window has."""
    n = np.minimum(n_words, WINDOW + STRIDE - 1)
    # Places at which a window of the item may start, against one of the document at every STRIDE words.
    off = np.maximum(0, -(-(STRIDE - np.abs(n - WINDOW) - 1) // 2))
    held = np.minimum(n, WINDOW) - np.where(n <= STRIDE + 1, 0, off)
    return (MIN_COSINE * held / np.sqrt(np.minimum(n, WINDOW) * WINDOW)).astype(np.float32)


def nearest(v: np.ndarray, centres: np.ndarray, k: int, step: int = 20_000) -> np.ndarray:
    """The k centres with the highest cosine for each row, in no order, some rows at a time."""
    out = np.empty((len(v), k), dtype=np.int64)
    for a in range(0, len(v), step):
        cos = v[a : a + step] @ centres.T
        out[a : a + step] = np.argpartition(cos, len(centres) - k, axis=1)[:, len(centres) - k :] if k > 1 else cos.argmax(axis=1)[:, None]
    return out


def items(rows: list[tuple], idf: np.ndarray, basis: np.ndarray) -> Items | None:
    h, offsets = ragged.hashed(pa.array([t for _, t in rows], pa.large_string()))
    keep = [i for i in range(len(rows)) if offsets[i + 1] - offsets[i] >= MIN_WORDS]
    if not keep:
        return None
    own = [h[offsets[i] : offsets[i + 1]] for i in keep]
    informative = []
    for x in own:
        once = np.unique(x)
        w = idf[weights.bucket(once)]
        informative.append(once[np.argsort(-w, kind="stable")[: max(1, len(once) // 4)]])
    item, offset, vectors = [], [], []
    for k in range(len(keep)):
        x = own[k]
        each = np.concatenate([np.zeros((1, basis.shape[1])), np.cumsum(idf[weights.bucket(x)][:, None] * basis[term(x)], axis=0, dtype=np.float64)])
        n = max(1, len(x) - WINDOW + 1)
        item += [k] * n
        offset += range(n)
        vectors.append(each[np.minimum(np.arange(n) + WINDOW, len(x))] - each[:n])
    v = unit(np.concatenate(vectors)).astype(np.float32)
    centres = v[np.linspace(0, len(v) - 1, max(1, int(np.sqrt(len(v))))).astype(int)]
    for _ in range(8):  # spherical k-means
        near = nearest(v, centres, 1)[:, 0]
        total = np.zeros_like(centres)
        np.add.at(total, near, v)
        centres = np.where((total**2).sum(axis=1, keepdims=True) > 0, unit(total), centres).astype(np.float32)
    near = nearest(v, centres, min(NEAREST, len(centres)))
    short = np.flatnonzero(np.array([len(x) for x in own])[item] < WINDOW + STRIDE - 1)
    wide = nearest(v[short], centres, min(NEAREST_SHORT, len(centres)))
    members = [np.union1d(np.flatnonzero((near == k).any(axis=1)), short[(wide == k).any(axis=1)]) for k in range(len(centres))]
    at = np.array(offset)[:, None] + np.arange(WINDOW)
    n_words = np.array([len(x) for x in own])[item]
    flat, base = np.append(np.concatenate(own), np.uint64(1)), np.cumsum([0, *(len(x) for x in own)])
    inside = at < n_words[:, None]
    words = np.where(inside, flat[np.where(inside, at + base[item][:, None], len(flat) - 1)], np.uint64(1))
    return Items([rows[i][0] for i in keep], own, informative, np.array(item), np.array(offset), v, least_cosine(n_words), centres, members, words, inside.sum(axis=1), bits_of(np.where(inside, words, np.uint64(0))))


# ---- the search


def bits_of(words: np.ndarray) -> np.ndarray:
    """A 64-bit set of each row's words, of which 0 is none."""
    one = np.uint64(1)
    return np.bitwise_or.reduce(np.where(words == 0, np.uint64(0), one << (words & np.uint64(63))), axis=1)


def candidates(vectors: np.ndarray, q: Items, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document window, benchmark window) with a cosine of the threshold, else of what the benchmark window asks, or more."""
    near = np.concatenate([np.argmax(vectors[a : a + 50_000] @ q.centres.T, axis=1) for a in range(0, len(vectors), 50_000)]) if len(vectors) else np.zeros(0, int)
    order = np.argsort(near, kind="stable")
    edge = np.searchsorted(near[order], np.arange(len(q.centres) + 1))
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for k, m in enumerate(q.members):
        mine = order[edge[k] : edge[k + 1]]
        for a in range(0, len(mine), 20_000):
            # Few pass, and their flat positions are found faster than pairs.
            x, y = np.divmod(np.flatnonzero(vectors[mine[a : a + 20_000]] @ q.vectors[m].T >= (q.least[m] if threshold is None else threshold)), max(1, len(m)))
            left.append(mine[a : a + 20_000][x])
            right.append(m[y])
    return np.concatenate(left), np.concatenate(right)


def lcs_many(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common subsequences of rows of a and rows of b (0 pads a, 1 pads b)."""
    best = np.zeros((b.shape[1] + 1, len(a)), dtype=np.int8)
    for i in range(a.shape[1]):
        before = np.zeros(len(a), dtype=np.int8)
        for j in range(b.shape[1]):
            here = best[j + 1].copy()
            best[j + 1] = np.where(a[:, i] == b[:, j], before + 1, np.maximum(best[j + 1], best[j]))
            before = here
    return best[-1]


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bits of one large integer."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & places.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def matches(h: np.ndarray, offsets: np.ndarray, q: Items, table: np.ndarray) -> list[tuple[int, int, float, float, int]]:
    """(row, item number, share of the item in the common subsequence, share of its informative words, first word)."""
    if not len(h):
        return []
    start, ends = blocks(offsets)
    sums = project(h, start, np.repeat(offsets[1:], np.diff(ends)), table)
    first, stop, row = passages(offsets)
    at = np.searchsorted(start, first)
    single = stop - first <= STRIDE
    vectors = sums[at].copy()
    two = np.flatnonzero(~single)
    vectors[two] += sums[at[two] + 1]
    left, right = candidates(unit(vectors).astype(np.float32), q)
    # Windows that share fewer than COMMON different words cannot pass the next test but for repeated words.
    own = np.zeros(len(first), dtype=np.uint64)
    if len(left):
        seen = np.zeros(len(first), dtype=bool)
        seen[left] = True
        used = np.flatnonzero(seen)
        span = np.minimum(first[used][:, None] + np.arange(WINDOW), stop[used][:, None] - 1)
        own[used] = bits_of(h[span])
        some = np.bitwise_count(own[left] & q.bits[right]) >= np.minimum(COMMON, np.bitwise_count(q.bits[right]))
        left, right = left[some], right[some]
    padded = np.concatenate([h, np.zeros(WINDOW, np.uint64)])
    found: dict[tuple[int, int], tuple] = {}
    for a in range(0, len(left), 100_000):
        x, y = left[a : a + 100_000], right[a : a + 100_000]
        span = first[x][:, None] + np.arange(WINDOW)
        mine = np.where(span < stop[x][:, None], padded[span], np.uint64(0))
        theirs = q.windows[y]
        close = np.flatnonzero(lcs_many(mine, theirs) * 2 >= np.minimum(stop[x] - first[x], q.sizes[y]))
        for i in close:
            r, k = int(row[x[i]]), int(q.item[y[i]])
            lo = int(first[x[i]] - q.offset[y[i]])
            key, old = (r, k), found.get((r, k))
            if old and (old[0] == 1 or abs(old[2] - lo) <= 1):
                continue
            n = len(q.words[k])
            part = h[max(int(offsets[r]), lo - SLACK) : min(int(offsets[r + 1]), lo + n + SLACK)]
            share = lcs(q.words[k], part) / n
            answer = float(np.isin(q.informative[k], part).mean())
            if share >= MIN_LCS and answer >= MIN_ANSWER and (not old or share > old[0]):
                found[key] = (share, answer, lo)
    return [(r, k, s, w, lo - int(offsets[r])) for (r, k), (s, w, lo) in found.items()]


def search(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, lcs_share, answer_share, first_word of every contaminated pair."""
    spark = docs.sparkSession
    n_docs, df = weights.frequencies(docs, text)
    idf = weights.idf(n_docs, df)
    basis = fit(docs, n_docs, idf, text, doc_id)
    table = word_vectors(idf, basis)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    n_windows = asked.agg(F.coalesce(F.sum(F.size(F.split("text", r"\s+"))), F.lit(0))).first()[0]
    n_blocks = max(1, -(-n_windows // BLOCK_WINDOWS))
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(asked.dtypes)['item_id']}, lcs_share double, answer_share double, first_word long"
    out = spark.createDataFrame([], schema)
    for k in range(n_blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).orderBy("item_id", "text")
        q = items([(r["item_id"], r["text"]) for r in block.toArrow().to_pylist()], idf, basis)
        if q is not None:
            out = out.unionByName(work.map_arrow(rows, _searcher(spark.sparkContext.broadcast((q, table)), out.schema), schema))
    q = table = basis = None
    ragged.release()  # the driver has other stages to run
    best = F.max_by(F.struct("lcs_share", "answer_share", "first_word"), F.struct("lcs_share", "answer_share", -F.col("first_word"))).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def _searcher(shared, schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, table = shared.value
        for batch in batches:
            for piece in ragged.pieces(batch):
                found = matches(*ragged.hashed(piece.column("text")), q, table)
                if found:
                    r, k, s, w, at = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(r)), pa.array([q.ids[i] for i in k], kind.field("item_id").type), pa.array(s), pa.array(w), pa.array(at, pa.int64())], schema=kind)
        ragged.release()

    return run


def accept(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that match no item, all columns kept; rows of one id, or of none, are judged by their own texts."""
    known = work.identified(docs, text, doc_id, nulls=True)
    gone = work.save(search(known.rows.select("uid", "text"), benchmark, "text", "uid").select(F.col("doc_id").alias("gone")).distinct(), "contaminated")
    few = gone.count() <= BROADCAST_IDS
    return known.rows.select("row", "uid").join(F.broadcast(gone) if few else gone, F.col("uid") == F.col("gone"), "left_anti").select("row.*")
