"""Token ids of a tokenizers file, written as ORC in ascending document order.

A dataset is a folder of two tables.  `ids` holds doc_id, shard, at (the ids before
the document within its shard), n_ids and ids; a shard is one file, the shards
ascend by document, and ORC keeps their integers run-length encoded in stripes, with
a row index every STRIDE rows and a Bloom filter on doc_id, so readers take single
stripes and skip what a predicate on doc_id rules out.  `shards` holds a row a shard:
its rows, its ids and its start, the ids of all shards before it.

Documents are ranged by id before their texts are tokenised, so one shuffle orders
all and a task writes what it makes.  Byte-level BPE never merges across the start of
a word: texts are cut before single spaces, around single line feeds and where letters
end, the library encodes the different words of a batch that none before it had, and
ids are gathered; texts with other white space, adjacent blanks or special strings go
to the library whole.

Defined results: null and empty texts have the end id only; a null id comes first and
no lookup finds it; rows of one id follow each other by their texts; special strings
inside texts are what the library makes of them by default; an empty table gives a
dataset without shards; other columns are not read.  A task's memory holds one Arrow
batch and its ids; a single text is one row.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ragged, work

END = 2
STRIPE_BYTES, STRIDE, FALSE_POSITIVES = 32 << 20, 1000, 0.01
#: Words kept between batches, and the most ids of one that is.
CACHE, CACHED = 300_000, 64
PIECE_BYTES = 2_000_000
#: Characters and texts that the library gets at once.
BATCH_BYTES, BATCH_TEXTS = 500_000, 5000
IDS = "doc_id long, shard int, at long, n_ids long, ids array<int>"
LEAD = "\x01"
#: Two adjacent blanks, or a character that may be white space in its own right (the lead mark too): no cut is sure there.
_UNSURE = r"[ \n][ \n]|[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{feff}]"
#: Letters end where an ASCII digit or sign follows them.
_LETTER = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]"
_AFTER_LETTERS = (rf"({_LETTER})([!-@\[-`{{-~])", r"\1 \2")
_LETTERS = rf"^ ?{_LETTER}+$"
#: Byte-level BPE writes bytes as characters: printable ones as themselves, the others, in order, as those from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """The library's ids of texts, each different word encoded once."""

    def __init__(self, tokenizer_file: str, end: int | None = END):
        # One thread a task: Spark has the others at work already.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(tokenizer_file)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = b"" if end is None else np.int32(end).tobytes()
        # Words that the library has encoded: their ids lie in the pool.
        self.known = pa.array([], pa.large_string())
        self.pool = np.zeros(0, dtype="<i4")
        self.starts, self.sizes, self.used, self.round = *(np.zeros(0, dtype=np.int64) for _ in range(3)), 0
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        cut = re.search(r'"pre_tokenizer":\{"type":"ByteLevel","add_prefix_space":false,"trim_offsets":(?:true|false),"use_regex":true\}', self.library.to_str())
        self.cuts = bool(cut) and self.library.normalizer is None

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids as bytes of little-endian integers, from the library alone."""
        out = []
        for some in _batches(texts):
            out += [array("i", e.ids).tobytes() for e in self.library.encode_batch_fast(some, add_special_tokens=False)]
        return out

    def apart(self, words: pa.Array) -> list[bytes]:
        """Ids of words; letters after at most one space are one pre-token, which the library's model takes as it is."""
        single = np.asarray(pc.match_substring_regex(words, _LETTERS))
        texts, out, model = words.to_pylist(), [b""] * len(words), self.library.model
        # In ASCII only the space is written otherwise.
        shown = pc.replace_substring(words, " ", chr(_ALPHABET[0x20])).to_pylist()
        plain = np.asarray(pc.string_is_ascii(words))
        for i in np.flatnonzero(single & ~plain).tolist():
            shown[i] = texts[i].encode().decode("latin-1").translate(_ALPHABET)
        for i in np.flatnonzero(single).tolist():
            out[i] = array("i", [t.id for t in model.tokenize(shown[i])]).tobytes()
        rest = np.flatnonzero(~single).tolist()
        for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Start in the pool and number of the ids of each of the (different) words."""
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1), dtype=np.int64)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            new = words.take(pa.array(fresh))
            made = self.apart(pc.replace_substring(new, LEAD, " "))
            size = np.fromiter((len(b) // 4 for b in made), dtype=np.int64, count=len(made))
            at[fresh] = len(self.known) + np.arange(len(fresh))
            self.known = pa.concat_arrays([self.known, new])
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(size) - size])
            self.sizes = np.concatenate([self.sizes, size])
            self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(made), dtype="<i4")])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), dtype=np.int64)])
        self.round += 1
        self.used[at] = self.round
        return self.starts[at], self.sizes[at]

    def forget(self) -> None:
        """Beyond CACHE words or the pool's bound, the half that was used last stays."""
        if len(self.known) <= CACHE and len(self.pool) <= 16 * CACHE:
            return
        kept = np.sort(np.argsort(self.used, kind="stable")[-(CACHE // 2) :])
        kept = kept[self.sizes[kept] <= CACHED]
        size = self.sizes[kept]
        starts = np.cumsum(size) - size
        self.pool = self.pool[np.repeat(self.starts[kept] - starts, size) + np.arange(size.sum())]
        self.known, self.starts, self.sizes, self.used = self.known.take(pa.array(kept)), starts, size, self.used[kept]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id after each text, and the texts' offsets in them."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        n = len(texts)
        unsure = pc.match_substring_regex(texts, _UNSURE) if self.cuts else pa.array(np.ones(n, dtype=bool))
        for token in self.added:
            unsure = pc.or_(unsure, pc.match_substring(texts, token))
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(unsure, pa.scalar("", pa.large_string()), texts), " ", " " + LEAD), "\n", " \n ")
        marked = pc.replace_substring_regex(marked, *_AFTER_LETTERS)
        split = pc.split_pattern(marked, " ")
        parts = pc.dictionary_encode(split.flatten())
        starts, sizes = self.words(parts.dictionary)
        code = np.asarray(parts.indices, dtype=np.int64)
        row = np.repeat(np.arange(n), np.diff(np.asarray(split.offsets, dtype=np.int64)))
        long = np.flatnonzero(np.asarray(unsure))
        own = self.whole([texts[int(i)].as_py() for i in long])
        count = np.bincount(row, sizes[code], minlength=n).astype(np.int64)
        count[long] += np.fromiter((len(b) // 4 for b in own), dtype=np.int64, count=len(own))
        offsets = np.concatenate([[0], np.cumsum(count + len(self.end) // 4)])
        out = np.empty(offsets[-1], dtype="<i4")
        # Each word's ids go to its place: words follow each other within a text, texts by their offsets.
        each = sizes[code]
        before = np.cumsum(each) - each
        first = np.concatenate([[0], np.cumsum(np.bincount(row, each, minlength=n).astype(np.int64))])[:-1]
        at = np.repeat(offsets[:-1][row] - first[row], each) + np.arange(each.sum())
        out[at] = self.pool[np.repeat(starts[code] - before, each) + np.arange(each.sum())]
        for i, ids in zip(long, own, strict=True):
            out[offsets[i] : offsets[i] + len(ids) // 4] = np.frombuffer(ids, dtype="<i4")
        if self.end:
            out[offsets[1:] - 1] = np.frombuffer(self.end, dtype="<i4")[0]
        self.forget()
        return out, offsets


def _batches(texts: list[str]) -> Iterator[list[str]]:
    """The library keeps much beside the ids, so it gets little at once."""
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t) + BATCH_BYTES // BATCH_TEXTS
        if size >= BATCH_BYTES:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


_ENCODERS: dict[str, Encoder] = {}


def write(docs: DataFrame, path: str, tokenizer_file: str, text: str = "text", doc_id: str = "doc_id", shards: int | None = None, stripe_bytes: int = STRIPE_BYTES, stride: int = STRIDE) -> None:
    """Writes the dataset of docs; shards (else the session's shuffle partitions) bounds the number of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(tokenizer_file) or _ENCODERS.setdefault(tokenizer_file, Encoder(tokenizer_file))
        shard, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            # A piece looks up its different words at once, which costs a pass over the known ones.
            for piece in ragged.pieces(batch, limit=PIECE_BYTES):
                ids, offsets = encoder.encode(piece.column("text"))
                n = len(offsets) - 1
                arrays = [
                    piece.column("doc_id"), pa.array(np.full(n, shard, dtype=np.int32)), pa.array(offsets[:-1] + before), pa.array(np.diff(offsets)),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "shard", "at", "n_ids", "ids"])
                before += int(offsets[-1])
        ragged.release()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranged = rows.repartitionByRange(*([shards] if shards else []), "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": FALSE_POSITIVES, "orc.create.index": "true",
        "orc.row.index.stride": stride, "orc.stripe.size": stripe_bytes, "compression": "zstd",
    }
    work.map_arrow(ranged, run, IDS).write.options(**options).orc(f"{path}/ids")
    per = rows.sparkSession.read.schema(IDS).orc(f"{path}/ids").groupBy("shard").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_rows"), F.sum("n_ids").alias("n_ids"))
    start = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids")
    per.withColumn("start", start).coalesce(1).write.orc(f"{path}/shards")


def shards_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("shard int, first_id long, last_id long, n_rows long, n_ids long, start long").orc(f"{path}/shards")


def read(spark: SparkSession, path: str, condition: Column | None = None) -> DataFrame:
    """doc_id, start, n_ids, ids of the documents that the condition on doc_id keeps; it reaches the stripes' statistics and Bloom filters."""
    ids = spark.read.schema(IDS).orc(f"{path}/ids")
    ids = ids if condition is None else ids.where(condition)
    starts = shards_of(spark, path).select("shard", F.col("start").alias("before"))
    return ids.join(starts, "shard").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_ids", "ids")


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    return read(spark, path, F.col("doc_id").isin(doc_ids))


def checksums(dataset: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (CRC-32 of the ids as little-endian unsigned 32-bit integers)."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(np.asarray(ids.values), dtype="<i4")
            ends = np.asarray(ids.offsets, dtype=np.int64)
            crc = np.fromiter((zlib.crc32(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)), dtype=np.int64, count=len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_ids"), pa.array(crc)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return work.map_arrow(dataset, run, "doc_id long, start long, n_tokens long, ids_crc32 long")
