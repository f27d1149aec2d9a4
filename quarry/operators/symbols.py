"""Symbol lookup in three tiers, and analytics over symbol rows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quarry.config import Config
from quarry.functions import paths
from quarry.functions import text as T

from . import filters as flt

# Scores of exact, case-insensitive and substring matches.
TIER_SCORES = (1.0, 0.95, 0.8)


class NameIndex(NamedTuple):
    """Posting lists of the different symbol names: postings (gram, symbol_name) and sizes (gram, n)."""

    postings: DataFrame
    sizes: DataFrame

    def write(self, path: str) -> NameIndex:
        """As Parquet in order of gram, so that a query's grams prune the scan."""
        spark = self.postings.sparkSession
        self.postings.repartitionByRange("gram").sortWithinPartitions("gram", "symbol_name").write.mode("overwrite").parquet(f"{path}/postings")
        postings = spark.read.schema(self.postings.schema).parquet(f"{path}/postings")
        postings.groupBy("gram").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/sizes")
        return NameIndex.read(spark, path)

    @staticmethod
    def read(spark: SparkSession, path: str) -> NameIndex:
        return NameIndex(spark.read.schema("gram string, symbol_name string").parquet(f"{path}/postings"), spark.read.schema("gram string, n long").parquet(f"{path}/sizes"))


def name_index(chunks: DataFrame) -> NameIndex:
    """Grams of one to three characters of every name in lower case, and a gram for each length that it reaches."""
    names = chunks.where("symbol_name IS NOT NULL").select("symbol_name").distinct()
    low = F.lower("symbol_name")
    reach = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), _length_gram)
    postings = names.select(F.explode(F.concat(F.array_distinct(F.concat(*[grams(low, n) for n in (1, 2, 3)])), reach)).alias("gram"), "symbol_name")
    return NameIndex(postings, postings.groupBy("gram").agg(F.count("*").alias("n")))


def _length_gram(n: Column) -> Column:
    return F.concat(F.lit("#"), n.cast("string"), F.lit("#"))


def matching(index: NameIndex, asked: DataFrame) -> DataFrame:
    """(qid, q, symbol_name) of the names that hold q in any case, `_` standing for any character, for asked (qid, q).

    A query meets the names of its rarest gram: three characters without a wildcard where it has them, else fewer; one of
    wildcards alone meets the names that are long enough."""
    low = F.lower("q")
    pieces = F.filter(F.split(low, "_"), lambda p: p != "")
    longest = F.least(F.array_max(F.transform(pieces, F.length)), F.lit(3))
    of_n = lambda n: F.flatten(F.transform(pieces, lambda p: grams(p, n)))
    own = F.when(F.size(pieces) == 0, F.array(_length_gram(F.length(low)))).when(longest == 3, of_n(3)).when(longest == 2, of_n(2)).otherwise(of_n(1))
    wanted = asked.select("qid", "q", F.explode(F.array_distinct(own)).alias("gram"))
    # A gram that no name has leaves the query without names.
    sized = wanted.join(index.sizes, "gram", "left").groupBy("qid", "q").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return index.postings.join(sized, "gram").select("qid", "q", "symbol_name").where(F.expr("symbol_name ILIKE concat('%', q, '%')"))


def search(chunks: DataFrame, queries: DataFrame, limit: int, config: Config | None = None, filters: Mapping[str, str] | None = None, index: NameIndex | None = None) -> DataFrame:
    """(qid, chunk_id, score, tier, rank) for the queries that are identifiers.

    Exact and case-insensitive matches share one cap; substring matches have their own, which rows of better tiers use up
    too.  All of them hold the query, so one look into the names' grams (index, or made here) finds them; index may cover
    more names than chunks has."""
    config = config or Config()
    asked = queries.where(T.is_symbol_query(F.col("query"))).select("qid", F.trim("query").alias("q"))
    rows = chunks.where(flt.condition(filters or {})).where("symbol_name IS NOT NULL").select("chunk_id", "symbol_name")
    name, q = F.col("symbol_name"), F.col("q")
    held = matching(index or name_index(rows), asked).select("qid", "symbol_name", F.when(name == q, 1).when(F.lower(name) == F.lower(q), 2).otherwise(3).alias("tier"))
    hits = rows.join(held, "symbol_name").select("qid", "chunk_id", "tier")
    exact = hits.where("tier < 3").withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "chunk_id"))).where(F.col("n") <= min(limit, config.symbol_exact_limit))
    near = hits.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("chunk_id"))).where(F.col("n") <= min(limit, config.symbol_fuzzy_limit))
    # Of a row that both have the better tier stays.
    both = exact.select("qid", "chunk_id", "tier").unionByName(near.select("qid", "chunk_id", F.lit(3).alias("tier")))
    found = both.groupBy("qid", "chunk_id").agg(F.min("tier").alias("tier"))
    scored = found.withColumn("score", F.element_at(F.array(*[F.lit(s) for s in TIER_SCORES]), F.col("tier")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "chunk_id"))).where(F.col("rank") <= limit)


def grams(text: Column, n: int) -> Column:
    """Every n characters of the text, in order; none for shorter ones."""
    return F.when(F.length(text) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))


# ---- symbol rows: file_id, name, kind (def or ref), type, line, end_line, column


def listed(rows: DataFrame, kind: str | None = None, type_: str | None = None, name: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Symbols without repeats (name, kind, line; the least column stays), by kind, type and part of the name."""
    order = Window.partitionBy("file_id", "name", "kind", "line").orderBy("column", "type")
    out = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    if kind:
        out = out.where(F.col("kind") == kind)
    if type_:
        out = out.where(F.col("type") == type_)
    if name:
        out = out.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return out.where(~F.col("name").isin(*exclude)) if exclude else out


# The order in which a summary lists types.
SUMMARY_ORDER = ["class", "interface", "type", "enum", "function", "method", "module", "key", "section", "selector", "keyframes", "media", "variable", "constant", "property", "object", "mixin", "extension", "macro", "resource", "output", "provider", "local"]


def counts(rows: DataFrame) -> DataFrame:
    """file_id, kind, type, n."""
    return rows.groupBy("file_id", "kind", "type").agg(F.count("*").alias("n"))


def summary(rows: DataFrame) -> DataFrame:
    """file_id and its definitions in words, as in "3 functions, 1 class"; files without definitions give no row."""
    per = counts(rows).where("kind = 'def'")
    place = F.array_position(F.array(*[F.lit(t) for t in SUMMARY_ORDER]), F.col("type"))
    place = F.when(place > 0, place).otherwise(len(SUMMARY_ORDER) + 1)
    label = F.concat(F.col("n").cast("string"), F.lit(" "), F.when(F.col("n") == 1, F.col("type")).otherwise(paths.pluralize(F.col("type"))))
    parts = per.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col("type").alias("type"), label.alias("label")))).alias("parts"))
    return parts.select("file_id", F.array_join(F.transform("parts", lambda p: p["label"]), ", ").alias("summary"))


def find(rows: DataFrame, dotted: str, near_line: int | None = None) -> DataFrame:
    """Definitions of the last name that lie inside definitions of the names before it; the first enclosing one counts.

    One sort and one sweep a file for each qualifier: of spans in order of start, the first that reaches the end is where
    the running maximum of ends does."""
    *parents, target = dotted.split(".")
    named = rows.where(F.col("kind") == "def").where(F.col("name").isin([target, *parents]))

    def enclosed(table: pa.Table) -> pa.Table:
        (file,) = codes(table["file_id"])
        name = np.asarray(table["name"].combine_chunks().to_numpy(zero_copy_only=False), dtype=object)
        line, end = (np.asarray(table[c], dtype=np.int64) for c in ("line", "end_line"))
        # Files lie one after another on one line, so that no span encloses another file's.
        far = int(max(line.max(initial=0), end.max(initial=0))) + 2
        line, end = line + file * far, end + file * far
        at = np.flatnonzero(name == target)
        span = np.stack([line[at], end[at]])
        inner = target
        for parent in reversed(parents):
            mine = np.unique(np.stack([line[name == parent], end[name == parent]]), axis=1)  # in order of start, then end
            place, ok = first_enclosing(mine, span, parent == inner)
            at, span, inner = at[ok], mine[:, place[ok]], parent
        return table.take(pa.array(at)).drop_columns(["_deal"])

    found = named if not parents else named.withColumn("_deal", dealt(rows.sparkSession)).groupBy("_deal").applyInArrow(enclosed, named.schema)
    by = [F.abs(F.col("line") - near_line)] if near_line is not None else []
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("file_id").orderBy(*by, "line", "column")))


def dealt(spark: SparkSession) -> Column:
    """Many files to a group, whole; groups shrink as the session's shuffle partitions grow in number."""
    return F.pmod(F.xxhash64("file_id"), F.lit(4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))


def codes(*columns: pa.ChunkedArray) -> list[np.ndarray]:
    """The same number for the same value in all columns."""
    encoded = pc.dictionary_encode(pa.chunked_array([c for column in columns for c in column.chunks], columns[0].type)).combine_chunks()
    flat = np.asarray(pc.fill_null(encoded.indices, len(encoded.dictionary)), dtype=np.int64)
    ends = np.cumsum([len(c) for c in columns])
    return [flat[e - len(c) : e] for e, c in zip(ends, columns, strict=True)]


def first_enclosing(outer: np.ndarray, inner: np.ndarray, other: bool) -> tuple[np.ndarray, np.ndarray]:
    """The first of the outer spans (sorted starts and ends) that encloses each inner one, and whether there is one; other leaves equal spans out."""
    if not outer.shape[1]:
        return np.zeros(inner.shape[1], dtype=np.int64), np.zeros(inner.shape[1], dtype=bool)
    last = outer.shape[1] - 1
    place = np.searchsorted(np.maximum.accumulate(outer[1]), inner[1])
    if other:  # equal to the span itself: the next in order is longer or starts later
        same = (outer[:, np.minimum(place, last)] == inner).all(axis=0) & (place <= last)
        place = place + same
    here = outer[:, np.minimum(place, last)]
    return np.minimum(place, last), (place <= last) & (here[0] <= inner[0]) & (here[1] >= inner[1])


def innermost(blocks: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """The place of the shortest of blocks (start, end, rank of ties) that encloses each of spans (start, end), -1 for none.

    Blocks enter in order of start; a tree over their ends keeps the shortest of those that reach an end, so a file costs
    its blocks and spans times a logarithm, nested or not."""
    ends = np.unique(blocks[1])
    n = len(ends)
    out = np.full(spans.shape[1], -1, dtype=np.int64)
    if not n:
        return out
    order = np.lexsort((blocks[2], blocks[1] - blocks[0]))
    short = np.empty(len(order), dtype=np.int64)
    short[order] = np.arange(len(order))  # by length, then rank
    tree = [len(order)] * (n + 1)
    enter = np.argsort(blocks[0], kind="stable").tolist()
    slot = (n - np.searchsorted(ends, blocks[1])).tolist()  # the farthest end first
    reach = (n - np.searchsorted(ends, spans[1])).tolist()
    starts, place, k = blocks[0].tolist(), short.tolist(), 0
    for q in np.argsort(spans[0], kind="stable").tolist():
        while k < len(enter) and starts[enter[k]] <= spans[0, q]:
            i, rank = slot[enter[k]], place[enter[k]]
            while i <= n:
                tree[i] = min(tree[i], rank)
                i += i & -i
            k += 1
        best, i = len(order), reach[q]
        while i > 0:
            best = min(best, tree[i])
            i -= i & -i
        if best < len(order):
            out[q] = order[best]
    return out


def assign_anchors(blocks: DataFrame, anchors: DataFrame, keep: int = 16) -> DataFrame:
    """file_id, block, start, end, kind, priority, rank: each anchor in its innermost block, the best `keep` of a block.

    blocks: file_id, block, start, end; anchors: file_id, start, end, kind, priority.
    An anchor must begin after its block does; of anchors with one span the highest priority stays."""
    spans = anchors.groupBy("file_id", "start", "end").agg(F.max_by("kind", "priority").alias("kind"), F.max("priority").alias("priority"))
    out = StructType([*spans.schema.fields, blocks.schema["block"]])
    none = to_arrow_schema(out).empty_table()

    def held(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return none
        of_span, of_block = codes(left["file_id"], right["of"])
        b = np.stack([np.asarray(right[c], dtype=np.int64) for c in ("first", "last")])
        s = np.stack([np.asarray(left[c], dtype=np.int64) for c in ("start", "end")])
        far = int(max(b.max(initial=0), s.max(initial=0))) + 2
        b, s = b + of_block * far, s + of_span * far
        rank = np.asarray(pc.rank(right["block"].combine_chunks(), tiebreaker="first"), dtype=np.int64)
        at = innermost(np.vstack([b, rank]), s)
        good = np.flatnonzero((at >= 0) & (s[0] > b[0][at]))
        return left.take(pa.array(good)).drop_columns(["_deal"]).append_column("block", right["block"].take(pa.array(at[good])))

    deal = dealt(blocks.sparkSession)
    # Named apart, since both tables may come from one.
    lines = blocks.select(F.col("file_id").alias("of"), F.col("block").alias("block"), F.col("start").alias("first"), F.col("end").alias("last"), deal.alias("_deal"))
    both = spans.withColumn("_deal", deal).groupBy("_deal").cogroup(lines.groupBy("_deal"))
    inner = both.applyInArrow(held, out)
    ranked = inner.withColumn("rank", F.row_number().over(Window.partitionBy("file_id", "block").orderBy(F.col("priority").desc(), "start", "end")))
    return ranked.where(F.col("rank") <= keep).select("file_id", "block", "start", "end", "kind", "priority", "rank")


def gram_set(nodes: Column, n: int = 3) -> Column:
    """The different n-grams of a node sequence, as 64-bit hashes."""
    hashed = F.transform(nodes, lambda x: F.xxhash64(x))
    grams = F.element_at(F.transform(F.array(hashed), lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))), 1)
    return F.when(F.size(nodes) < n, F.array().cast("array<bigint>")).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; both empty 1, one empty 0."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard of the sets of n-grams of two node sequences; both without n-grams 1, one 0."""
    return jaccard(gram_set(a, n), gram_set(b, n))
