"""The chunk store: immutable Parquet files, versions that name them, and delete vectors merged when read.

data/commit=<id>/store_id=/project_id= holds rows, deletes/commit=<id> the places
(file, row) of rows that are gone, versions/ a small file for each version.  A change
writes what is new, then publishes one version; until then nobody sees it.  So the
bytes that a change writes follow the change, not its project; `compact` folds the
deletes in, `vacuum` removes files that no kept version names."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import filters as flt

from .commits import Conflict, Files, Versions

SCHEMA = (
    "id string, store_id string, project_id string, content string, semantic_content string, lexical_content string, embedding array<float>, "
    "repo_root string, content_type string, doc_path string, source string, filename string, language string, symbol_name string, chunk_type string, "
    "content_hash string, start_line int, end_line int, chunk_chars int, chunk int, total_chunks int, embedding_model string, extra map<string,string>, created_at timestamp"
)
STORES = "id string, name string, created_at timestamp, metadata map<string,string>"


PLACES = "file string, row long"
#: Texts that are mostly the content again: the files hold null where they are.
SAME = ("semantic_content", "lexical_content")
PARTS = ("store_id", "project_id")
#: Documents named in a filter that reaches the files; more of them are joined.
NAMED_DOCS = 1000
RETRIES = 10


class Snapshot(NamedTuple):
    """One version: the commits of its rows and deletes, and the scopes that were dropped whole."""

    version: int
    data: list[str]
    deletes: list[str]
    #: Of (store_id, project_id) none of the rows in these commits: [store_id, project_id, commits].
    drops: list[list]
    #: What made this version: kind, store_id, project_id (None: all).
    change: list


class Store:
    """One folder of chunks.

    Writers of one scope (store and project) exclude each other: the later one starts again from the version it lost
    to.  Appends exclude nobody."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions, self.files = Versions(spark, self.path), Files(spark)

    def ensure(self) -> Store:
        """Creates the folder's first version if it has none."""
        if not self.versions.latest():
            self.versions.publish(1, Snapshot(1, [], [], [], ["create", None, None])._asdict())
        return self

    # ---- reading

    def snapshot(self, version: int | None = None) -> Snapshot:
        return Snapshot(**self.versions.read(self.versions.latest() if version is None else version))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the latest one if none is given; later changes do not touch them."""
        return self.rows(self.snapshot(version)).drop("commit", "file", "row")

    def rows(self, at: Snapshot, commits: list[str] | None = None) -> DataFrame:
        """The rows of a version (or of some of its commits) with their commit, file and row."""
        wanted = at.data if commits is None else [c for c in at.data if c in commits]
        if not wanted:
            return self.spark.createDataFrame([], f"{SCHEMA}, commit string, {PLACES}")
        data = self.spark.read.schema(f"{SCHEMA}, commit string").option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/commit={c}" for c in wanted])
        columns = [f.split()[0] for f in SCHEMA.split(", ")]
        for store_id, project_id, old in at.drops:
            if set(old) & set(wanted):
                data = data.where(~(F.col("store_id").eqNullSafe(store_id) & F.col("project_id").eqNullSafe(project_id or None) & F.col("commit").isin(old)))
        data = data.select(*[F.coalesce(c, "content").alias(c) if c in SAME else c for c in columns], "commit", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        return data.join(self.places(at.deletes), ["file", "row"], "left_anti").select(*columns, "commit", "file", "row") if at.deletes else data

    def places(self, commits: list[str]) -> DataFrame:
        """(file, row) of the rows that these commits delete."""
        return self.spark.read.schema(PLACES).parquet(*[f"{self.path}/deletes/commit={c}" for c in commits])

    # ---- writing

    def _shaped(self, rows: DataFrame) -> DataFrame:
        kinds = self.spark.createDataFrame([], SCHEMA).schema
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kinds])

    def prepared(self, rows: DataFrame, store_id: str, project_id: str | None = None) -> DataFrame:
        """Rows as they are stored: missing texts default to the content, the request's project wins over the rows'."""
        have = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
        project = F.coalesce(F.lit(project_id), have("project_id"), F.lit(""))
        return self._shaped(
            rows.withColumns(
                {
                    "id": F.coalesce(have("id"), F.uuid()), "store_id": F.lit(store_id), "project_id": project,
                    "semantic_content": F.coalesce(have("semantic_content"), F.col("content")),
                    "lexical_content": F.coalesce(have("lexical_content"), F.col("content")), "created_at": F.current_timestamp(),
                }
            )
        )

    def _write_rows(self, rows: DataFrame) -> str:
        """Rows as a new commit, each file in order of document, so that statistics prune a document's rows."""
        commit = uuid.uuid4().hex
        slim(rows).sortWithinPartitions(*PARTS, "doc_path").write.partitionBy(*PARTS).parquet(f"{self.path}/data/commit={commit}")
        return commit

    def _write_places(self, places: DataFrame) -> tuple[str, int]:
        """The places as a new commit, and their number."""
        commit = uuid.uuid4().hex
        places.select("file", "row").write.parquet(f"{self.path}/deletes/commit={commit}")
        return commit, self.places([commit]).count()

    def _commit(self, kind: str, store_id: str | None, project_id: str | None, change: Callable[[Snapshot], tuple[dict[str, list], Any]], ready: str | None = None) -> Any:
        """Runs change on the latest version and publishes what it adds; again if another writer of the scope came first.

        change returns what the version gains (data, deletes, drops) or loses (less_data, less_deletes, less_drops), and a
        result; ready is a commit that holds for every attempt."""
        for _ in range(RETRIES):
            base = self.snapshot()
            gain, result = change(base)
            if not any(gain.values()):
                return result
            try:
                self._publish(base, gain, [kind, store_id, project_id])
                return result
            except Conflict:
                for folder in ("data", "deletes"):
                    for commit in gain.get(folder, []):
                        if commit != ready:
                            self.files.remove(f"{self.path}/{folder}/commit={commit}")
        raise Conflict(f"{kind} of {store_id}/{project_id} lost to other writers {RETRIES} times")

    def _publish(self, base: Snapshot, gain: dict[str, list], change: list) -> None:
        while True:
            now = self.snapshot()
            for v in range(base.version + 1, now.version + 1):
                if self._excludes(change, self.snapshot(v).change):
                    raise Conflict(str(change))
            lists = {n: [x for x in getattr(now, n) if x not in gain.get(f"less_{n}", [])] + gain.get(n, []) for n in ("data", "deletes", "drops")}
            if self.versions.publish(now.version + 1, {"version": now.version + 1, **lists, "change": change}):
                return

    @staticmethod
    def _excludes(mine: list, other: list) -> bool:
        if "append" in (mine[0], other[0]):
            return False
        meets = lambda a, b: a is None or b is None or a == b
        return meets(mine[1], other[1]) and meets(mine[2], other[2])

    def append(self, rows: DataFrame, store_id: str, project_id: str | None = None) -> None:
        """Adds rows; equal documents are not looked for (see upsert)."""
        prepared = self.prepared(rows, store_id, project_id)
        self._commit("append", store_id, project_id, lambda _: ({"data": [self._write_rows(prepared)]}, None))

    def remove(self, path: str) -> None:
        """Deletes a folder of the store's file system."""
        self.files.remove(path)

    def _held(self, at: Snapshot, scope: Column, docs: DataFrame) -> DataFrame:
        """The rows of docs (doc_path) in a scope; few names go into the scan's filter."""
        inside, names = self.rows(at).where(scope), docs.select("doc_path").distinct()
        few = names.limit(NAMED_DOCS + 1).collect()
        if len(few) <= NAMED_DOCS:
            return inside.where(F.col("doc_path").isin([r[0] for r in few]))
        return inside.join(names, "doc_path", "left_semi")

    def delete_docs(self, store_id: str, docs: DataFrame, project_id: str | None = None) -> int:
        """Removes the chunks of docs (doc_path) in one project, or in all of the store's; how many went."""
        scope = (F.col("store_id") == store_id) & (F.lit(True) if project_id is None else F.col("project_id") == project_id)

        def change(at: Snapshot) -> tuple[dict, int]:
            commit, n = self._write_places(self._held(at, scope, docs))
            if not n:
                self.files.remove(f"{self.path}/deletes/commit={commit}")
            return {"deletes": [commit] if n else []}, n

        return self._commit("delete", store_id, project_id, change)

    def delete_project(self, store_id: str, project_id: str) -> int:
        """Drops a project's rows by a note in the version; no file is written."""
        scope = (F.col("store_id") == store_id) & (F.col("project_id") == project_id)

        def change(at: Snapshot) -> tuple[dict, int]:
            n = self.rows(at).where(scope).count()
            return {"drops": [[store_id, project_id, at.data]] if n else []}, n

        return self._commit("delete", store_id, project_id, change)

    def delete(self, store_id: str, query: dict[str, str] | None = None, body: dict[str, str] | None = None) -> int:
        """Arguments of the request line win over the body's; one of doc_path and project_id is needed."""
        given = (body or {}) | (query or {})
        path, project = given.get("doc_path") or given.get("source"), given.get("project_id")
        if path:
            return self.delete_docs(store_id, self.spark.createDataFrame([(path,)], "doc_path string"), project)
        if project:
            return self.delete_project(store_id, project)
        raise ValueError("doc_path or project_id is needed")

    def upsert(self, rows: DataFrame, store_id: str, project_id: str, removed: DataFrame | None = None) -> None:
        """Replaces the documents of rows and drops those in removed (doc_path), in one version."""
        scope = (F.col("store_id") == store_id) & (F.col("project_id") == project_id)
        new = self._write_rows(self.prepared(rows, store_id, project_id))
        gone = self.spark.read.schema(f"{SCHEMA}, commit string").option("basePath", f"{self.path}/data").parquet(f"{self.path}/data/commit={new}").select("doc_path")
        if removed is not None:
            gone = gone.unionByName(removed.select("doc_path"))

        def change(at: Snapshot) -> tuple[dict, None]:
            commit, n = self._write_places(self._held(at, scope, gone))
            if not n:
                self.files.remove(f"{self.path}/deletes/commit={commit}")
            return {"data": [new], "deletes": [commit] if n else []}, None

        self._commit("upsert", store_id, project_id, change, new)

    # ---- upkeep

    def compact(self) -> None:
        """One commit of all live rows, ranged by document, in place of all commits and deletes so far."""

        def change(at: Snapshot) -> tuple[dict, None]:
            if not at.data:
                return {}, None
            live = self.rows(at).drop("commit", "file", "row").repartitionByRange(*PARTS, "doc_path", "id")
            return {"data": [self._write_rows(live)], "less_data": at.data, "less_deletes": at.deletes, "less_drops": at.drops}, None

        self._commit("compact", None, None, change)

    def vacuum(self, keep: int = 10, older_s: float = 24 * 3600) -> list[str]:
        """Forgets all but the last versions, then removes commits that no version names and nobody wrote lately; their folders."""
        numbers = sorted(self.versions.numbers())
        for n in numbers[:-keep]:
            self.versions.forget(n)
        kept = [self.snapshot(n) for n in numbers[-keep:]]
        named = {c for s in kept for c in (*s.data, *s.deletes)}
        out = []
        for folder in ("data", "deletes"):
            for name, changed in self.files.listed(f"{self.path}/{folder}"):
                if name.removeprefix("commit=") not in named and changed < (time.time() - older_s) * 1000:
                    self.files.remove(f"{self.path}/{folder}/{name}")
                    out.append(f"{folder}/{name}")
        return out

    def changes(self, before: Snapshot, after: Snapshot) -> tuple[DataFrame, DataFrame] | None:
        """(rows added, rows gone) between two versions, reading their new commits and deletes; None if rows were moved or dropped whole meanwhile."""
        if any(c not in after.data for c in before.data) or before.drops != after.drops:
            return None
        fresh = [c for c in after.data if c not in before.data]
        deletes = [c for c in after.deletes if c not in before.deletes]
        added = self.rows(after, fresh)
        old = self.rows(before)
        gone = old.join(self.places(deletes), ["file", "row"], "left_semi") if deletes else old.limit(0)
        return added, gone


def slim(rows: DataFrame) -> DataFrame:
    """Rows of the store without the texts that equal the content; `whole` puts them back."""
    return rows.withColumns({c: F.when(~F.col(c).eqNullSafe(F.col("content")), F.col(c)) for c in SAME})


def whole(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, "content") for c in SAME})


def stats(chunks: DataFrame) -> DataFrame:
    """content_type, n; null types count as unknown.  The sum of n is the number of chunks."""
    return chunks.groupBy(F.coalesce("content_type", F.lit("unknown")).alias("content_type")).agg(F.count("*").alias("n"))


def sources(chunks: DataFrame, need_hash: bool = True) -> DataFrame:
    """doc_path, content_hash, chunk_count; of several hashes of a path the one with most chunks, then the greatest."""
    rows = chunks.where(F.col("doc_path").isNotNull() & (F.col("content_hash").isNotNull() if need_hash else F.lit(True)))
    per = rows.groupBy("doc_path", "content_hash").agg(F.count("*").alias("chunk_count"))
    return per.groupBy("doc_path").agg(F.max(F.struct("chunk_count", "content_hash")).alias("m")).select("doc_path", "m.content_hash", "m.chunk_count")


def symbol_rows(chunks: DataFrame) -> DataFrame:
    """The symbol table as a view over chunks."""
    parent = F.when(F.contains("symbol_name", F.lit(".")), F.regexp_extract("symbol_name", r"^(.*)\.[^.]*$", 1))
    return chunks.where("symbol_name IS NOT NULL").select(F.col("id").alias("chunk_id"), "symbol_name", "chunk_type", "language", "doc_path", "project_id", "start_line", "end_line", parent.alias("parent_symbol"))


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def query(chunks: DataFrame, filters: dict[str, str | None]) -> DataFrame:
    return chunks.where(flt.condition(filters))


def health(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS ok").first()["ok"] == 1

