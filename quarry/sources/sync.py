"""Incremental synchronisation by content hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions import paths


def plan(local: DataFrame, stored: DataFrame, force: bool = False, stale: bool = True, check_counts: bool = True) -> DataFrame:
    """doc_path, action, local_hash, stored_hash, expected_chunks, chunk_count.

    local: doc_path, content_hash, expected_chunks; stored: doc_path, content_hash, chunk_count.
    Actions are new, updated, forced, incomplete, unchanged and stale."""
    a = local.select("doc_path", F.col("content_hash").alias("local_hash"), "expected_chunks")
    b = stored.select("doc_path", F.col("content_hash").alias("stored_hash"), "chunk_count")
    both = a.join(b, "doc_path", "full_outer")
    fewer = (F.col("chunk_count") < F.col("expected_chunks")) if check_counts else F.lit(False)
    action = (
        F.when(F.col("local_hash").isNull(), "stale")
        .when(F.col("stored_hash").isNull() & F.col("chunk_count").isNull(), "new")
        .when(~F.col("local_hash").eqNullSafe(F.col("stored_hash")), "updated")
        .when(F.lit(force), "forced")
        .when(fewer, "incomplete")
        .otherwise("unchanged")
    )
    out = both.withColumn("action", action)
    return out if stale else out.where("action <> 'stale'")


def counters(planned: DataFrame) -> DataFrame:
    """One row of totals; forced and incomplete documents count as updated too."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return planned.agg(
        n("new").alias("n_new"), n("updated", "forced", "incomplete").alias("n_updated"), n("incomplete").alias("n_incomplete"), n("unchanged").alias("n_unchanged"), n("stale").alias("n_stale")
    )


def status(planned: DataFrame) -> DataFrame:
    """doc_path, status in order of path: current, outdated, incomplete, missing (not stored) or stale (not local)."""
    word = F.create_map(*[F.lit(x) for kv in {"new": "missing", "updated": "outdated", "forced": "outdated", "incomplete": "incomplete", "unchanged": "current", "stale": "stale"}.items() for x in kv])
    return planned.select("doc_path", word[F.col("action")].alias("status")).orderBy("doc_path")


def apply(store, planned: DataFrame, chunks: DataFrame, store_id: str, project_id: str, watch: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
    """Stale documents go, new and changed ones are replaced by their chunks, in one version; watch may observe what is written."""
    changed = planned.where("action IN ('new', 'updated', 'forced', 'incomplete')").select("doc_path")
    store.upsert(watch(chunks.join(changed, "doc_path", "left_semi")), store_id, project_id, planned.where("action = 'stale'").select("doc_path"))


def export(planned: DataFrame, path: str) -> None:
    planned.orderBy("doc_path").write.mode("overwrite").json(path)


def _figures() -> list[Column]:
    f = lambda s: F.count_if(F.col("state") == s)
    return [f("ok").alias("files_ok"), f("failed").alias("files_failed"), f("skipped").alias("files_skipped"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")]


def ingest_summary(files: DataFrame) -> DataFrame:
    """One JSON line of figures from rows (doc_path, state, n_chunks, n_bytes), state ok, failed or skipped."""
    return files.agg(*_figures()).select(F.to_json(F.struct("*")).alias("summary"))


def observed(files: DataFrame) -> tuple[DataFrame, Observation]:
    """The rows of ingest_summary as they are, counted by whatever job reads them: figures need no pass of their own."""
    seen = Observation("ingest")
    return files.observe(seen, *_figures()), seen


def metrics(seen: Observation, seconds: float) -> dict[str, float]:
    """The figures of an observed job that has run, with its rates."""
    found = dict(seen.get)
    done = max(seconds, 1e-9)
    return found | {"seconds": seconds, "chunks_per_second": found["chunks"] / done, "bytes_per_second": found["bytes"] / done}


def resolve_project(path: Column, roots: list[str]) -> Column:
    """The longest root that holds the path, or null."""
    held = F.filter(F.array(*[F.lit(r) for r in roots]), lambda r: paths.within(path, r))
    return F.reduce(held, F.lit(None).cast("string"), lambda acc, r: F.when(acc.isNull() | (F.length(r) > F.length(acc)), r).otherwise(acc))


def registered(registry: DataFrame, projects: DataFrame) -> DataFrame:
    """The registry (id, name, root) with projects put in, in place of those of the same id."""
    return unregistered(registry, projects.select("id")).unionByName(projects.select("id", "name", "root"))


def unregistered(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("id").distinct(), "id", "left_anti").select("id", "name", "root")


def find_projects(asked: DataFrame, registry: DataFrame) -> DataFrame:
    """key, id: by id, then name, both in any case, then by a path's first segment as either, then by root, then the longest root above the key.

    An equality join by all that a key may be; blank keys find nothing."""
    one = lambda order, kind, value: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), value.alias("value"))
    key = F.trim("key")
    low, head = F.lower(key), F.when(F.contains(key, F.lit("/")), F.lower(F.trim(F.substring_index(key, "/", 1))))
    steps = F.split(F.regexp_replace(key, "/+$", ""), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    roots = F.transform(above, lambda a: F.struct(F.when(a == key, 4).otherwise(5).alias("order"), F.lit("root").alias("kind"), a.alias("value")))
    every = F.concat(F.array(one(0, "id", low), one(1, "name", low), one(2, "id", head), one(3, "name", head)), roots)
    sought = asked.select("key", F.explode(every).alias("s")).select("key", "s.*").where("value <> ''")
    plain = F.regexp_replace("root", "/+$", "")
    values = (("id", F.lower("id")), ("name", F.lower("name")), ("root", plain))
    known = registry.select("id", F.length("root").alias("length"), F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values])).alias("r")).select("id", "length", "r.*")
    best = sought.join(known, ["kind", "value"]).groupBy("key").agg(F.min_by("id", F.struct("order", -F.col("length"), "id")).alias("id"))
    return asked.select("key").distinct().join(best, "key", "left")
