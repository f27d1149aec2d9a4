"""Document frequencies of hashed words over a whole corpus.

Words fall into BUCKETS buckets by hash, so that the table has a fixed size
(1 MB) at any scale and can be collected and broadcast; every document counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ragged, work

BUCKETS = 1 << 17


def bucket(word_hashes: np.ndarray) -> np.ndarray:
    return (word_hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with a word in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for piece in ragged.pieces(batch):
                h, offsets = ragged.hashed(piece.column("text"))
                row = np.repeat(np.arange(piece.num_rows), np.diff(offsets))
                pairs = np.sort(row * BUCKETS + bucket(h))
                pairs = pairs[np.diff(pairs, prepend=-1) > 0]
                total += np.bincount(pairs % BUCKETS, minlength=BUCKETS)
                rows += piece.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["bucket", "n"])
        ragged.release()

    found = work.map_arrow(docs.select(F.col(text).cast("string").alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(found["bucket"]), np.asarray(found["n"])
    out = np.zeros(BUCKETS, dtype=np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return int(n[at < 0].sum()), out


def idf(n_rows: int, df: np.ndarray) -> np.ndarray:
    """1 + ln((1 + rows) / (1 + df)), never below 1."""
    return (1 + np.log((1 + n_rows) / (1 + df))).astype(np.float32)
