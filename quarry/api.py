"""The request surface as plain functions over a store: search, insert, delete, stats, sources, health, indexing.

Each takes and returns what a thin HTTP or command-line layer would pass on."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import chunks as chunking
from quarry.operators import code, filters, hybrid
from quarry.sources import files as discovery
from quarry.sources import indexes, services, staging, store, sync


class Service:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, embedder: services.Embedder | None = None, rerank: hybrid.Reranker = None):
        self.spark, self.config, self.embedder, self.rerank = spark, config or Config(), embedder, rerank
        self.store = store.Store(spark, path).ensure()
        self.indexes = indexes.Catalogue(self.store)
        #: What the last call of index wrote, and how fast.
        self.metrics: dict[str, float] = {}

    # ---- search

    def search(self, store_id: str, query: str, limit: int | None = None, filters_: Mapping[str, str] | None = None, content_type: str | None = None, project_id: str | None = None, repo_root: str | None = None, mode: str = "hybrid", raw: bool = False, metadata: bool = True) -> DataFrame:
        """Result rows of one query over one version of the store; the lexical index of a scope is found in its catalogue, or brought up to date there."""
        if not query.strip():
            raise ValueError("query is needed")
        chosen = filters.merged(filters_, content_type)
        at = self.store.snapshot()
        rows = filters.scoped(self.store.rows(at).drop("commit", "file", "row"), project_id, repo_root, store_id).withColumn("chunk_id", F.col("id"))
        vector = self.embedder.embed([query])[0] if self.embedder and mode != "lexical" else None
        asked = self.spark.createDataFrame([(0, query, vector)], "qid long, query string, embedding array<float>")
        if vector is None:
            mode = "lexical"
        index = None
        if mode != "semantic":
            found, view = self.indexes.get(store_id, project_id, repo_root, at)
            index = found.part(asked.select("qid", "query"), view)
        out = hybrid.search(rows, asked, self.config, {k: v for k, v in chosen.items() if v is not None}, limit, index, self.rerank, mode)
        return hybrid.shape(out, self.config, raw, metadata).orderBy("rank")

    # ---- changes

    def insert(self, store_id: str, rows: DataFrame, project_id: str | None = None) -> None:
        """Appends rows (content and any other stored column); missing vectors are made where an embedder is set."""
        prepared = self.store.prepared(rows, store_id, project_id)
        if self.embedder:
            prepared = services.embed_missing(prepared, self.embedder, self.config.embed_batch)
        self.store.append(prepared, store_id, project_id)

    def delete(self, store_id: str, query: dict[str, str] | None = None, body: dict[str, str] | None = None) -> int:
        return self.store.delete(store_id, query, body)

    def stats(self, store_id: str, project_id: str | None = None) -> DataFrame:
        return store.stats(filters.scoped(self.store.read(), project_id, None, store_id))

    def sources(self, store_id: str, project_id: str | None = None) -> DataFrame:
        return store.sources(filters.scoped(self.store.read(), project_id, None, store_id))

    def health(self) -> bool:
        return store.health(self.spark)

    # ---- indexing

    def plan(self, root: str, store_id: str, project_id: str, extensions: list[str], force: bool = False) -> tuple[DataFrame, DataFrame]:
        """(sync plan, chunks) of a folder against the store; files are read, parsed and chunked once, into a staged table."""
        found = discovery.collect(self.spark, root, extensions, self.config.max_file_bytes)
        base = root.rstrip("/").removeprefix("file://")
        given = found.select("file_id", "path", "content", F.lit(base).alias("repo_root"), F.lit(project_id).alias("project_id"))
        made = chunking.chunk(given, code.definitions(given), self.config.chunk_chars, self.config.overlap_chars)
        stage = staging.folder(self.spark, "chunks")
        made.write.parquet(stage)
        made = self.spark.read.schema(made.schema).parquet(stage)
        local = made.groupBy("doc_path").agg(F.first("content_hash").alias("content_hash"), F.count("*").alias("expected_chunks"))
        return sync.plan(local, self.sources(store_id, project_id), force), made

    def index(self, root: str, store_id: str, project_id: str, extensions: list[str], force: bool = False, planned: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """Brings the store in line with a folder, or with a plan made before; the counters of what was done."""
        steps, made = planned or self.plan(root, store_id, project_id, extensions, force)
        counted = self.spark.createDataFrame(sync.counters(steps).collect(), sync.counters(steps).schema)
        rows = services.embed_missing(self.store.prepared(made, store_id, project_id), self.embedder, self.config.embed_batch) if self.embedder else made
        seen, start = Observation("indexed"), time.perf_counter()
        sync.apply(self.store, steps, rows, store_id, project_id, lambda new: new.observe(seen, F.count("*").alias("chunks"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")))
        self.metrics = sync.metrics(seen, time.perf_counter() - start)
        for file in made.inputFiles()[:1]:  # the stage is used up
            self.store.remove(file.rsplit("/", 1)[0])
        return counted
