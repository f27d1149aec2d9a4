"""Streaming ingestion: files that arrive are chunked and put in place of their older chunks.

The store is the state: each chunk notes when its file was modified, and a version of
a file counts only if it is later than the one that is stored (of one time, the one
of the greater content hash).  So versions may come in any order, and a micro-batch
that runs twice changes nothing more."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import paths
from quarry.operators import chunks, code
from quarry.sources import staging
from quarry.sources.store import Store

FILES = "file_id string, path string, content string, repo_root string, project_id string, modified timestamp"
MODIFIED = "modified"


def read(spark: SparkSession, folder: str, fmt: str = "json") -> DataFrame:
    """A stream of file rows from a folder of JSON or Parquet files; a missing time is the earliest."""
    return spark.readStream.format(fmt).schema(FILES).load(folder)


def newest(files: DataFrame) -> DataFrame:
    """One row a path, the latest; with doc_path, at (microseconds) and content_hash."""
    at = F.coalesce(F.unix_micros("modified"), F.lit(0)) if "modified" in files.columns else F.lit(0)
    rows = files.withColumns({"doc_path": paths.relative(F.col("path"), F.col("repo_root")), "at": at.cast("long"), "content_hash": F.sha2(F.encode("content", "UTF-8"), 256)})
    last = F.max_by(F.struct("*"), F.struct("at", "content_hash", "file_id"))
    return rows.groupBy("path").agg(last.alias("f")).select("f.*")


def later(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of newest() that come after what the store has of their document."""
    at = F.coalesce(F.element_at("extra", MODIFIED).cast("long"), F.lit(0))
    have = stored.groupBy("doc_path").agg(F.max(F.struct(at.alias("at"), F.coalesce("content_hash", F.lit("")).alias("hash"))).alias("have"))
    joined = rows.join(have, "doc_path", "left")
    return joined.where(F.col("have").isNull() | (F.struct(F.col("at"), F.coalesce("content_hash", F.lit("")).alias("hash")) > F.col("have"))).drop("have")


def put(files: DataFrame, store: Store, store_id: str, project_id: str, most: int = 750, overlap: int = 200) -> None:
    """One micro-batch as one version of the store, or none if nothing in it is new."""
    spark = files.sparkSession
    scope = (F.col("store_id") == store_id) & (F.col("project_id") == project_id)
    stage = staging.folder(spark, "arrived")
    # Written once: symbols and contents of a file come from one row.
    later(newest(files), store.read().where(scope)).write.parquet(stage)
    rows = spark.read.parquet(stage)
    if not rows.isEmpty():
        given = rows.select("file_id", "path", "content", "repo_root", "project_id")
        made = chunks.chunk(given, code.definitions(given), most, overlap)
        times = rows.select("file_id", F.create_map(F.lit(MODIFIED), F.col("at").cast("string")).alias("extra"))
        store.upsert(made.join(times, "file_id"), store_id, project_id)
    store.remove(stage)


def start(files: DataFrame, store: Store, store_id: str, project_id: str, checkpoint: str, most: int = 750, overlap: int = 200) -> StreamingQuery:
    """Each micro-batch is one idempotent upsert, chunked by symbols as batch indexing does."""
    batches = files.writeStream.foreachBatch(lambda batch, _: put(batch, store, store_id, project_id, most, overlap))
    return batches.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
