"""Texts as ragged numpy arrays: one flat array of word codes with row offsets.

Words are maximal runs of characters other than white space; splitting and
dictionary encoding run inside Arrow, so Python touches each distinct word of a
batch once.  Batches are cut into pieces of bounded size; only a single text
can exceed that bound.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1_000_000


def pieces(batch: pa.RecordBatch, *texts: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about `limit` bytes together, or one row."""
    size = np.cumsum(sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(c)), 0), dtype=np.int64) for c in texts or ("text",)))
    start, n = 0, batch.num_rows
    while start < n:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def release() -> None:
    """Gives memory that a task has used back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """codes of all words in order, row offsets (one more than rows), distinct words."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    split = pc.utf8_split_whitespace(texts)
    encoded = pc.dictionary_encode(split.flatten())
    codes, distinct = np.asarray(encoded.indices, dtype=np.int64), encoded.dictionary.to_pylist()
    offsets = np.asarray(split.offsets, dtype=np.int64) - split.offsets[0].as_py()
    if "" in distinct:  # of leading and trailing white space, and of empty texts
        kept = codes != distinct.index("")
        before = np.concatenate([[0], np.cumsum(kept)])
        codes, offsets = codes[kept], before[offsets]
    return codes, offsets, distinct


_MULTIPLIER, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(29).integers(1, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for i, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def hashed(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word in order, and row offsets (one more than rows).

    Words here are runs of bytes other than ASCII white space.  Hashes are polynomials
    over the words' bytes, taken as differences of one running sum, so no word becomes
    a Python object."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if lower:
        texts = pc.utf8_lower(texts)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    gap = np.concatenate([[True], _IS_SPACE[data], [True]])
    word = ~gap[1:-1]
    starts = np.flatnonzero(word & (gap[:-2] | cut[:-1]))
    ends = np.flatnonzero(word & (gap[2:] | cut[1:])) + 1
    power, inverse = _power(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return h, np.searchsorted(starts, offsets)


def hashes(distinct: list[str]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def shingles(word_hashes: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every window of `width` words, offsets of rows into them, and each window's first word.

    A row of one to width-1 words has a single window, all its words; an empty row none."""
    n_words = np.diff(offsets)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    starts = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(starts[-1]) + np.repeat(offsets[:-1] - starts[:-1], n)
    padded = np.concatenate([word_hashes, np.zeros(width, dtype=np.uint64)])
    out = np.zeros(len(first), dtype=np.uint64)
    short = np.repeat(n_words < width, n)
    size = np.repeat(n_words, n) if short.any() else None
    for k in range(width):
        w = padded[first + k]
        if size is not None:
            w = np.where(short & (size <= k), np.uint64(0), w)
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + w + np.uint64(k + 1))
    return out, starts, first
