"""Metadata filters: a closed list of keys, equality as text."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that may be filtered.
FILTER_KEYS = ("project_id", "repo_root", "content_type", "doc_path", "source", "language", "symbol_name", "chunk_type", "content_hash")


def condition(filters: Mapping[str, str | None]) -> Column:
    """All keys equal their values; None values are skipped; nothing to test is true; unknown keys raise."""
    unknown = sorted(set(filters) - set(FILTER_KEYS))
    if unknown:
        raise ValueError(f"unknown filter key: {', '.join(unknown)}")
    tests = [F.col(k).cast("string") == F.lit(v) for k, v in filters.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def merged(filters: Mapping[str, str | None] | None, content_type: str | None = None) -> dict[str, str | None]:
    """A request's filters, its own content_type winning over the filters'."""
    out = dict(filters or {})
    if content_type:
        out["content_type"] = content_type
    condition(out)
    return out


def content_types(kind: str, docs: tuple[str, ...] = ("markdown",)) -> Column:
    """code, docs (Markdown unless told otherwise) or all."""
    if kind == "all":
        return F.lit(True)
    if kind == "code":
        return F.col("content_type") == "code"
    if kind == "docs":
        return F.col("content_type").isin(*docs)
    raise ValueError(f"unknown content kind {kind!r}")


def scoped(rows: DataFrame, project_id: str | None = None, repo_root: str | None = None, store_id: str | None = None) -> DataFrame:
    """Empty and missing scopes do not restrict."""
    for name, value in (("project_id", project_id), ("repo_root", repo_root), ("store_id", store_id)):
        if value:
            rows = rows.where(F.col(name) == value)
    return rows


def post_filter(hits: DataFrame, filters: Mapping[str, str]) -> DataFrame:
    """The looser test for lexical hits, after their limit: any column, a missing value equals the empty string."""
    for k, v in filters.items():
        value = F.coalesce(F.col(k).cast("string"), F.lit("")) if k in hits.columns else F.lit("")
        hits = hits.where(value == F.lit(v))
    return hits
