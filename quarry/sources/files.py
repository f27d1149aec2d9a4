"""File discovery and reading with the binary file source."""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import batches, paths

# Folders and files that are never read.
SKIP_DIRS = [
    "node_modules", ".git", "__pycache__", ".venv", "venv", ".env", ".tox",
    ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".next",
    ".nuxt", ".output", "vendor", "target", ".gradle", ".idea", ".vscode",
    ".svn", ".hg", "coverage", ".turbo", ".cache", "bower_components", ".eggs",
    ".copilot", ".obsidian", ".claude", ".chroma_db", ".hive", "codex",
]
SKIP_FILES = [
    "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "Gemfile.lock",
    "poetry.lock", "composer.lock", "Cargo.lock", "go.sum",
    ".env", "cacert.pem", ".gitconfig", ".ragconfig",
]


def wanted(listed: DataFrame, root: str, extensions: list[str], max_bytes: int | None = 204_800) -> DataFrame:
    """Of rows with path and length those to read: by extension, size and name, outside skipped folders below root."""
    below = paths.relative(F.col("path"), F.lit(root))
    folders = F.slice(F.split(below, "/"), 1, F.size(F.split(below, "/")) - 1)
    skipped = F.exists(folders, lambda d: d.isin(*SKIP_DIRS) | F.endswith(d, F.lit(".egg-info")))
    ext = F.substring(paths.extension(F.col("path")), 2, 100)
    out = listed.where(~skipped & ~paths.basename(F.col("path")).isin(*SKIP_FILES) & ext.isin(*[e.lstrip(".").lower() for e in extensions]))
    return out if max_bytes is None else out.where(F.col("length") <= max_bytes)


def named(extensions: list[str]) -> str:
    """A glob of the file names with these extensions, in any case."""
    either = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e.lstrip(".").lower())
    return "*.{" + ",".join(map(either, extensions)) + "}"


def listing(spark: SparkSession, roots: str | list[str], extensions: list[str] | None = None, recursive: bool = True) -> DataFrame:
    """uri, path (without scheme), length, modified, bytes of the files below roots; of the given extensions only, in any case, if any are given.

    What a query does not use of them is not read: without bytes it is a listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    if extensions:
        reader = reader.option("pathGlobFilter", named(extensions))
    files = reader.load(roots)
    return files.select(F.col("path").alias("uri"), F.regexp_replace("path", "^[a-z0-9]+:/+", "/").alias("path"), "length", F.col("modificationTime").alias("modified"), F.col("content").alias("bytes"))


def _located(spark: SparkSession, root: str, extensions: list[str], max_bytes: int | None) -> tuple[str, DataFrame, list[str]]:
    """The root as paths begin with it, the listing of the wanted files below it, and globs of the folders that hold them (the driver gets a row a folder)."""
    base = root.rstrip("/").removeprefix("file://")
    found = wanted(listing(spark, root, extensions), base, extensions, max_bytes)
    folders = sorted(r[0] for r in found.select(F.regexp_replace("uri", "/[^/]*$", "")).distinct().collect())
    return base, found, [escaped(f) + "/" + named(extensions) for f in folders]


def escaped(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", path)


def collect(spark: SparkSession, root: str, extensions: list[str], max_bytes: int | None = 204_800) -> DataFrame:
    """file_id, path, content, content_hash (of the text), raw_hash (of the bytes), length, modified of the wanted files in order of path.

    Two phases: a listing names the folders that hold wanted files, then those are read, so no byte of a skipped folder,
    another extension or a larger file is.  A row holds a whole file; see `hashed` for files of any size."""
    base, found, globs = _located(spark, root, extensions, max_bytes)
    rows = wanted(listing(spark, globs, extensions, False), base, extensions, max_bytes) if globs else found.limit(0)
    text = F.make_valid_utf8(F.col("bytes").cast("string"))
    return rows.dropDuplicates(["path"]).select(
        paths.relative(F.col("path"), F.lit(base)).alias("file_id"), "path", text.alias("content"), F.sha2(F.encode(text, "UTF-8"), 256).alias("content_hash"), F.sha2("bytes", 256).alias("raw_hash"), "length", "modified"
    ).orderBy("path")


def hashed(spark: SparkSession, root: str, extensions: list[str], max_bytes: int | None = None) -> DataFrame:
    """collect() without content, for files of any size: their lines come in pieces and are hashed as they go by in order.

    A hash is a chain, so one task follows one file, but it holds a batch of lines (a single line may be larger) and the
    sort spills; no row holds a file."""
    base, found, globs = _located(spark, root, extensions, max_bytes)
    files = wanted(listing(spark, globs, extensions, False), base, extensions, max_bytes) if globs else found.limit(0)
    files = files.dropDuplicates(["path"]).select(paths.relative(F.col("path"), F.lit(base)).alias("file_id"), "path", "length", "modified")
    if not globs:
        empty = F.sha2(F.lit(""), 256)
        return files.select("file_id", "path", empty.alias("content_hash"), empty.alias("raw_hash"), "length", "modified")
    lines = spark.read.option("lineSep", "\n").text(globs)
    at = F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.col("_metadata.file_block_start")
    # Within a block of a file ids grow line by line.
    placed = lines.select(F.col("value").cast("binary").alias("line"), at[0].alias("uri"), at[1].alias("size"), at[2].alias("block"), F.monotonically_increasing_id().alias("i"))
    batches.small(spark)
    sums = placed.repartition("uri").sortWithinPartitions("uri", "block", "i").select("uri", "size", "line").mapInArrow(_chained, "uri string, content_hash string, raw_hash string")
    plain = sums.select(F.regexp_replace(F.url_decode(F.replace("uri", F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/+", "/").alias("path"), F.col("content_hash").alias("c"), F.col("raw_hash").alias("r"))
    empty = F.sha2(F.lit(""), 256)  # a file without bytes has no line
    out = files.join(plain, "path", "left")
    return out.select("file_id", "path", F.coalesce("c", empty).alias("content_hash"), F.coalesce("r", empty).alias("raw_hash"), "length", "modified").orderBy("path")


class _Chain:
    """Hashes of bytes and of their text."""

    def __init__(self, data: bytes = b""):
        self.raw, self.text, self.decode = hashlib.sha256(), hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace").decode
        self.add(data)

    def add(self, data: bytes, final: bool = False) -> None:
        self.raw.update(data)
        self.text.update(self.decode(data, final).encode())


def _chained(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes of each file's lines, which lie together in order."""

    def ended(uri: str, size: int, seen: int, chains: list[_Chain]) -> pa.RecordBatch:
        # The reader drops a byte order mark and says nothing of a last line end: the size tells of both.
        left = size - seen
        if left not in (0, 1, 3, 4):
            raise ValueError(f"{uri}: {seen} bytes were read of {size}")
        chain = chains[left >= 3]
        chain.add(b"\n" if left in (1, 4) else b"", True)
        return pa.RecordBatch.from_pydict({"uri": [uri], "content_hash": [chain.text.hexdigest()], "raw_hash": [chain.raw.hexdigest()]})

    at, size, seen, chains = None, 0, 0, []
    for batch in given:
        for uri, n, line in zip(*(batch.column(c).to_pylist() for c in ("uri", "size", "line")), strict=True):
            if at != uri:
                if at is not None:
                    yield ended(at, size, seen, chains)
                at, size, seen, chains = uri, n, 0, [_Chain(), _Chain(codecs.BOM_UTF8)]
            else:
                line = b"\n" + line
            seen += len(line)
            for chain in chains:
                chain.add(line)
    if at is not None:
        yield ended(at, size, seen, chains)
