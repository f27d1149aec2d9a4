"""Line dedup over batches with levelled sorted runs of line hashes.

A run is a Parquet folder of (h1, h2, n): a 128-bit line key and the number of
documents of one or more batches that hold it, hash-partitioned and sorted by
key.  A new batch is reduced to its own key counts, merge-anti-joined with the
keys that the runs already know to be frequent, and written as a run of level
0; `fanout` runs of a level are merged into one of the next.  Lines whose keys
reach `min_docs` documents over all runs are dropped everywhere.

Defined results: null and empty texts are one empty line, which no key matches;
a line that repeats inside a document counts once for it; repeated rows are
documents of their own and all change alike; ids may be null; a document whose
lines all go keeps an empty text.  Counting is pre-aggregated before the only
shuffle by key, so a line that a third of all documents share is one row per
task; the join back is small and, where the frequent keys are small by their
written size, a broadcast that the planner chooses, else a merge join that
adaptive execution splits where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import work
from .quality import SPACE
from .urls import LOWER, UPPER

MIN_DOCS = 10
MIN_LENGTH = 1


def key_text(line: Column) -> Column:
    """A-Z lower-cased; where all characters are ASCII the faster lower() does the same."""
    k = F.btrim(line, F.lit(SPACE))
    return F.when(F.length(k) == F.octet_length(k), F.lower(k)).otherwise(F.translate(k, UPPER, LOWER))


def hash128(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(7), text)]


def _hashed(key: Column) -> list[Column]:
    return [h.alias(n) for h, n in zip(hash128(key), ("h1", "h2"), strict=True)]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """Runs under one shared folder; `levels` holds the paths, oldest level last."""

    def __init__(self, spark: SparkSession, root: str, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, fanout: int = 4):
        self.spark, self.root, self.min_docs, self.min_length, self.fanout = spark, root, min_docs, min_length, fanout
        self.levels: list[list[str]] = []
        self.made = 0

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h1 long, h2 long, n long").parquet(*paths)

    def _write(self, counts: DataFrame, level: int) -> None:
        path = f"{self.root}/level{level}-{self.made:05d}"
        self.made += 1
        counts.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def paths(self) -> list[str]:
        return [p for level in self.levels for p in level]

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """One batch: count its keys, leave out those already known to be frequent, add the rest as a run."""
        keys = docs.select(F.explode(F.array_distinct(F.transform(lines_of(F.col(text)), key_text))).alias("k")).where(F.length("k") >= self.min_length)
        counts = keys.select(*_hashed(F.col("k"))).groupBy("h1", "h2").agg(F.count("*").alias("n"))
        if self.paths():
            known = self._read(self.paths()).where(F.col("n") >= self.min_docs).select("h1", "h2")
            counts = counts.join(known, ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merging, self.levels[level] = self.levels[level], []
            self._write(self._read(merging).groupBy("h1", "h2").agg(F.sum("n").alias("n")), level + 1)
            level += 1

    def frequent(self) -> DataFrame:
        """(h1, h2) of all keys that min_docs documents or more hold, written once."""
        if not self.paths():
            return self.spark.createDataFrame([], "h1 long, h2 long")
        total = self._read(self.paths()).groupBy("h1", "h2").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_docs).select("h1", "h2")
        return work.save(total, "frequent-lines")

    def drop(self, docs: DataFrame, frequent: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """row (a struct of the input's columns), n_lines, n_dropped, kept text."""
        whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        id_, t = F.col("row")[doc_id], F.coalesce(F.col("row")[text], F.lit(""))
        keyed = [id_.alias("id"), *[h.alias(n) for h, n in zip(hash128(t), ("t1", "t2"), strict=True)]]
        lines = whole.select(*keyed, F.posexplode(lines_of(t)).alias("pos", "line")).select("id", "t1", "t2", "pos", key_text(F.col("line")).alias("k"))
        hits = lines.where(F.length("k") >= self.min_length).select("id", "t1", "t2", "pos", *_hashed(F.col("k"))).join(frequent, ["h1", "h2"])
        gone = hits.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("gone"))
        rows = whole.select("row", *keyed).alias("a").join(gone.alias("b"), F.expr("a.id <=> b.id AND a.t1 = b.t1 AND a.t2 = b.t2"), "left")
        all_lines = lines_of(F.col("a.row")[text])
        n = F.size(all_lines)
        stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("b.gone"))
        kept = F.when(F.col("b.gone").isNull(), F.coalesce(F.col("a.row")[text], F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
        return rows.select("a.row", n.cast("long").alias("n_lines"), F.coalesce(F.size("b.gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))


def file_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """A table as batches of its files, as if they had come one after another; what docs filters or changes holds in them too."""
    name = F.pmod(F.xxhash64(F.input_file_name()), F.lit(batches))
    return [docs.where(name == k) for k in range(batches)]


def dedup(docs: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """All documents with their frequent lines dropped; batches: the same rows in the order in which they come."""
    spark = docs.sparkSession
    runs = LineRuns(spark, work.new_path(spark, "line-runs"), min_docs, min_length)
    for batch in batches or [docs]:
        runs.add(batch, text)
    frequent = runs.frequent()
    work.remove(spark, runs.root)  # these runs serve this call alone; the frequent keys are written
    return runs.drop(docs, frequent, text, doc_id)
