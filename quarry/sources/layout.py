"""Bucketed copies of the store's rows for lookups by symbol and by document.

`symbols` is bucketed and sorted by the symbol name in lower case, `paths` by
document, both over one version of the store; texts that equal the content are kept once.  A lookup by value reads one bucket; a
join of many keys shuffles the keys alone, as the rows lie by key already.  The files
are found again by other processes: a small version file notes their folder, and the
session's catalogue is told of it on first use."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.commits import Versions
from quarry.sources.store import Snapshot, Store, slim, whole

BUCKETS = 64
KEYS = {"symbols": "lower_name", "paths": "doc_path"}


class Layout:
    def __init__(self, store: Store, buckets: int = BUCKETS):
        self.store, self.spark, self.buckets = store, store.spark, buckets
        self.folder = f"{store.path}/layout"
        self.versions = Versions(store.spark, self.folder)

    def publish(self, at: Snapshot | None = None) -> dict[str, Any]:
        """Writes both tables of a version of the store (the latest if None), unless they are there."""
        at = at or self.store.snapshot()
        latest = self.versions.latest()
        noted = self.versions.read(latest) if latest else None
        if noted and noted["store_version"] == at.version:
            return noted
        rows = slim(self.store.rows(at).drop("commit", "file", "row"))
        run = uuid.uuid4().hex
        for name, key in KEYS.items():
            keyed = rows.where("symbol_name IS NOT NULL").withColumn("lower_name", F.lower("symbol_name")) if name == "symbols" else rows.where("doc_path IS NOT NULL")
            # Ranged by bucket first, so a bucket is one file.
            dealt = keyed.repartition(self.buckets, key)
            dealt.write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.folder}/{run}/{name}").format("parquet").saveAsTable(self._name(run, name))
        noted = {"store_version": at.version, "run": run, "buckets": self.buckets}
        if not self.versions.publish(latest + 1, noted):  # another writer was first
            return self.versions.read(self.versions.latest())
        return noted

    @staticmethod
    def _name(run: str, name: str) -> str:
        return f"quarry_{name}_{run}"

    def table(self, name: str, noted: dict[str, Any] | None = None) -> DataFrame:
        """The rows of a table as bucketed in its files."""
        noted = noted or self.versions.read(self.versions.latest())
        known, key = self._name(noted["run"], name), KEYS[name]
        if not self.spark.catalog.tableExists(known):
            folder = f"{self.folder}/{noted['run']}/{name}"
            schema = self.spark.read.parquet(folder).schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
            self.spark.sql(f"CREATE TABLE {known} ({columns}) USING parquet OPTIONS (path '{folder}') CLUSTERED BY ({key}) SORTED BY ({key}) INTO {noted['buckets']} BUCKETS")
        return whole(self.spark.table(known))

    def by_symbol(self, asked: DataFrame, noted: dict[str, Any] | None = None) -> DataFrame:
        """Of queries (qid, q) the rows whose symbol is q in any case, with tier 1 (equal) or 2."""
        keyed = asked.select("qid", "q", F.lower("q").alias("lower_name"))
        return self.table("symbols", noted).join(keyed, "lower_name").withColumn("tier", F.when(F.col("symbol_name") == F.col("q"), 1).otherwise(2))

    def by_path(self, docs: DataFrame, noted: dict[str, Any] | None = None) -> DataFrame:
        """The rows of documents (doc_path)."""
        return self.table("paths", noted).join(docs.select("doc_path").distinct(), "doc_path")
