"""Fusion of semantic and lexical hits, diversity limits, and the search pipeline over a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions import text as T

from . import filters as flt
from . import lexical, symbols, vector

#: Takes candidates (qid, pos, ..., content, lexical_content) and the number to keep; None keeps their order.
Reranker = Callable[[DataFrame, int], DataFrame] | None


def normalize(score: Column, *partition: str) -> Column:
    """Min-max within a group; one score, or a spread under 1e-9, gives 1."""
    group = Window.partitionBy(*partition)
    low, high = F.min(score).over(group), F.max(score).over(group)
    return F.when(score.isNull(), None).when((F.count(score).over(group) == 1) | (high - low < 1e-9), 1.0).otherwise(F.try_divide(score - low, high - low))


def fuse(semantic: DataFrame, lexical_hits: DataFrame, config: Config) -> DataFrame:
    """(qid, chunk_id, score, sem, lex, pos) from two tables (qid, chunk_id, score, rank); a missing side counts 0."""
    a = semantic.select("qid", "chunk_id", F.col("score").alias("sem"), F.col("rank").alias("sem_rank"), normalize(F.col("score"), "qid").alias("ns"))
    b = lexical_hits.select("qid", "chunk_id", F.col("score").alias("lex"), F.col("rank").alias("lex_rank"), normalize(F.col("score"), "qid").alias("nl"))
    both = a.join(b, ["qid", "chunk_id"], "full_outer")
    # Without any lexical hit a query's semantic scores pass as they are.
    any_lexical = F.count("lex").over(Window.partitionBy("qid")) > 0
    mixed = F.coalesce("ns", F.lit(0.0)) * config.semantic_weight + F.coalesce("nl", F.lit(0.0)) * config.lexical_weight
    scored = both.withColumn("score", F.when(any_lexical, mixed).otherwise(F.col("sem")))
    order = Window.partitionBy("qid").orderBy(T.order_key(F.col("score")).desc(), F.col("sem_rank").asc_nulls_last(), F.col("lex_rank").asc_nulls_last(), "chunk_id")
    return scored.select("qid", "chunk_id", "score", "sem", "lex", F.row_number().over(order).alias("pos"))


def source_key() -> Column:
    return F.coalesce(T.first_filled("doc_path", "source", "filename"), F.lit("__unknown__"))


def cap_per_file(candidates: DataFrame, n: int, free: Column | None = None) -> DataFrame:
    """The first n of each (qid, source) in order of pos; rows that are free all stay."""
    order = Window.partitionBy("qid", "_source").orderBy("pos")
    kept = F.col("_n") <= n if free is None else free | (F.col("_n") <= n)
    return candidates.withColumn("_source", source_key()).withColumn("_n", F.row_number().over(order)).where(kept).drop("_n", "_source")


def dedup_by_source(candidates: DataFrame) -> DataFrame:
    return cap_per_file(candidates, 1)


def renumber(candidates: DataFrame, *by: str) -> DataFrame:
    return candidates.withColumn("pos", F.row_number().over(Window.partitionBy("qid").orderBy(*(by or ("pos",)))))


def code_warning(content: Column, content_type: Column, config: Config) -> Column:
    """Code gets the warning line on top, once."""
    warning = config.code_warning.strip()
    if not config.code_aware or not warning:
        return content
    wanted = (content_type == "code") & ~F.startswith(content, F.lit(warning))
    return F.when(wanted, F.concat(F.lit(warning + "\n"), content)).otherwise(content)


def shape(candidates: DataFrame, config: Config, raw: bool = False, metadata: bool = True) -> DataFrame:
    """Result rows: qid, rank, id, score, source, content, symbol and lines (null where unknown), and on request raw content and metadata."""
    out = candidates.select(
        "qid", F.col("pos").alias("rank"), F.col("chunk_id").alias("id"), T.round4(F.col("score")).alias("score"),
        F.coalesce(T.first_filled("doc_path", "source"), F.lit("unknown")).alias("source"),
        code_warning(F.col("content"), F.col("content_type"), config).alias("content"),
        (F.col("content") if raw else F.lit(None).cast("string")).alias("raw_content"),
        *[(F.col(c) if c in candidates.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("symbol_name", "string"), ("start_line", "int"), ("end_line", "int"))],
        (F.to_json(F.struct(*[c for c in flt.FILTER_KEYS if c in candidates.columns])) if metadata else F.lit(None).cast("string")).alias("metadata"),
        "mode",
    )
    return out


def render(results: DataFrame) -> DataFrame:
    """One text line a result: source, lines, symbol and score."""
    span = F.when(F.col("start_line").isNotNull(), F.format_string(":%d-%d", "start_line", "end_line")).otherwise("")
    symbol = F.when(F.coalesce("symbol_name", F.lit("")) != "", F.format_string(" (%s)", "symbol_name")).otherwise("")
    return results.withColumn("line", F.concat(F.lit("── "), "source", span, symbol, F.format_string("  [%.4f]", "score")))


def search(
    chunks: DataFrame,
    queries: DataFrame,
    config: Config | None = None,
    filters: Mapping[str, str] | None = None,
    limit: int | None = None,
    index: lexical.Index | None = None,
    rerank: Reranker = None,
    mode: str = "hybrid",
) -> DataFrame:
    """The whole pipeline for queries (qid, query, embedding) over chunks; mode is hybrid, semantic or lexical.

    chunks carries chunk_id, content, lexical_content, embedding and the metadata
    columns.  A query that is an identifier looks up symbols first; with enough of
    them it is answered by them alone."""
    config = config or Config()
    filters = filters or {}
    n = config.limit(limit)
    test = flt.condition(filters)
    k = max([n, *([config.rerank_candidates] if config.rerank_enabled else []), *([config.lexical_candidates] if mode == "hybrid" else [])])
    found_symbols = symbols.search(chunks, queries, n, config, filters) if config.symbol_enabled else None
    hybrid = mode == "hybrid" and config.hybrid_enabled
    hits = None
    if mode != "lexical":
        hits = vector.batch_top_k(chunks.where(test), queries, k, config.distance, config.min_score).select("qid", "chunk_id", "score", "rank")
    if mode == "lexical" or hybrid:
        index = index or lexical.build(lexical.index_text(chunks))
        # Filtered after the limit, as the reference ranking does.
        words = lexical.search(index, queries, max(n, config.lexical_candidates) if hybrid else n, True, config.k1, config.b)
        words = flt.post_filter(words.join(chunks.select("chunk_id", *flt.FILTER_KEYS), "chunk_id"), filters).select("qid", "chunk_id", "score", "rank")
        fused = fuse(hits, words, config) if hits is not None else words.select("qid", "chunk_id", "score", F.lit(None).cast("double").alias("sem"), F.col("score").alias("lex"), F.col("rank").alias("pos"))
    else:
        fused = hits.select("qid", "chunk_id", "score", F.col("score").alias("sem"), F.lit(None).cast("double").alias("lex"), F.col("rank").alias("pos"))
    label = "lexical" if mode == "lexical" else "hybrid" if hybrid else "semantic"
    pool = fused.withColumns({"first": F.lit(1), "symbol_rank": F.lit(None).cast("int")})
    if found_symbols is not None:
        rest = pool.join(found_symbols.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
        enough = found_symbols.groupBy("qid").agg((F.count("*") >= n).alias("enough"))
        rest = rest.join(enough, "qid", "left").where(~F.coalesce("enough", F.lit(False))).drop("enough")
        own = found_symbols.select("qid", "chunk_id", "score", F.lit(None).cast("double").alias("sem"), F.lit(None).cast("double").alias("lex"), F.col("rank").alias("pos"), F.lit(0).alias("first"), F.col("rank").alias("symbol_rank"))
        pool = rest.unionByName(own)
    of_query = Window.partitionBy("qid")
    n_symbols = F.count(F.when(F.col("first") == 0, 1)).over(of_query)
    mixed = "symbol+lexical" if mode == "lexical" else "symbol+hybrid"
    pool = pool.withColumn("mode", F.when(n_symbols == 0, label).when(n_symbols >= n, "symbol").otherwise(mixed))
    pool = renumber(pool, "first", "pos").join(chunks.drop("embedding"), "chunk_id")
    if mode != "lexical":
        # Queries that symbols alone answer skip the limits per file.
        alone = F.col("mode") == "symbol"
        if config.rerank_enabled and rerank is not None:
            rest = renumber(cap_per_file(pool.where(~alone), config.max_per_file))
            rest = rerank(rest.where(F.col("pos") <= config.rerank_candidates), config.rerank_top)
            pool = pool.where(alone).unionByName(dedup_by_source(rest))
        else:
            pool = renumber(cap_per_file(pool, config.max_per_file, alone)).where(alone | (F.col("pos") <= n))
            pool = cap_per_file(pool, 1, alone)
    return renumber(pool).where(F.col("pos") <= n)
