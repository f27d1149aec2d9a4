"""Chunking: by size with line overlap, by symbol, and the gaps between symbols."""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quarry.functions import batches, paths
from quarry.functions import text as T

PIECES = ArrayType(StructType([StructField("part_text", StringType()), StructField("first_line", IntegerType()), StructField("last_line", IntegerType())]))
#: Characters of parts that a task holds as Python strings at once; a single row may have more.
MOST_CHARS = 4_000_000
#: White space that is trimmed off the ends of module-level chunks.
BLANK = " \t\n\x0b\f\r"


def line_sizes(text: str, lines: list[str]) -> list[int]:
    """UTF-16 units of each line and its end."""
    plain = text.isascii() or max(text) <= "\uffff"
    return [len(x) + 1 for x in lines] if plain else [len(x.encode("utf-16-le", "surrogatepass")) // 2 + 1 for x in lines]


def cut(text: str, most: int, overlap: int) -> list[tuple[str, int, int]]:
    """(text, first line, last line) of each part, from 0.

    A part closes when the next line would exceed `most`; the next one takes over
    whole last lines until they hold `overlap` characters.  Each part is found by
    bisection in the running sizes, so a text costs its length and its parts."""
    lines = text.split("\n")
    sizes = line_sizes(text, lines)
    if sum(sizes) - 1 <= most:
        return [(text, 0, len(lines) - 1)]
    upto = [0, *accumulate(sizes)]
    out, start, least = [], 0, 0
    while True:
        # Lines that were taken over stay, and one more comes, whatever their size.
        end = max(bisect_right(upto, upto[start] + most) - 1, least + 1)
        out.append(("\n".join(lines[start:end]), start, end - 1))
        if end >= len(lines):
            return out
        start, least = max(bisect_right(upto, upto[end] - overlap) - 1, start), end


def listed(rows: Iterable[list[tuple[str, int, int]]]) -> pa.Array:
    """Rows of (text, first line, last line) as one column; Python holds the texts of MOST_CHARS at once, Arrow the others."""
    texts, done, held = [], [], 0
    first, last, ends = array("i"), array("i"), array("i", [0])
    for parts in rows:
        for text, a, b in parts:
            texts.append(text)
            held += len(text)
            first.append(a)
            last.append(b)
        ends.append(len(first))
        if held > MOST_CHARS:
            done.append(pa.array(texts, pa.string()))
            texts, held = [], 0
    done.append(pa.array(texts, pa.string()))
    columns = [pa.concat_arrays(done), *(pa.array(np.frombuffer(x, np.int32) if x else [], pa.int32()) for x in (first, last))]
    return pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), pa.StructArray.from_arrays(columns, ["part_text", "first_line", "last_line"]))


@cache
def cutter(most: int, overlap: int) -> Callable:
    @F.arrow_udf(PIECES)
    def parts(text: pa.Array) -> pa.Array:
        return listed([] if t is None else cut(t, most, overlap) for t in (x.as_py() for x in text))

    return parts


def by_size(rows: DataFrame, text: str, most: int = 750, overlap: int = 200) -> DataFrame:
    """The rows with part (from 1), parts, part_text, first_line and last_line (from 0) for each part; null texts have none."""
    batches.small(rows.sparkSession)
    parts = rows.withColumn("_parts", cutter(most, overlap)(F.col(text).cast("string")))
    out = parts.select(*rows.columns, F.size("_parts").alias("parts"), F.posexplode("_parts").alias("_i", "_p"))
    return out.select(*rows.columns, (F.col("_i") + 1).alias("part"), "parts", "_p.part_text", "_p.first_line", "_p.last_line")


def lexical_text(rel_path: Column, symbol: Column, language: Column, content: Column) -> Column:
    """The content under a header line of its file, symbol and language; absent pieces are left out."""
    piece = lambda name, x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(f"{name}: "), x))
    head = F.concat_ws(" | ", piece("File", rel_path), piece("Symbol", symbol), piece("Language", language))
    return F.when(head == "", content).otherwise(F.concat(F.lit("# "), head, F.lit("\n"), content))


def gaps(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """file_id, first_line, last_line (from 0), content: runs of lines outside all definitions, of over 20 characters when trimmed.

    files: file_id, content; symbols: file_id, line, end_line (from 1)."""
    batches.small(files.sparkSession)
    spans = symbols.select("file_id", F.struct(F.greatest(F.col("line") - 1, F.lit(0)).cast("int").alias("a"), F.greatest(F.col("line") - 1, F.col("end_line") - 1, F.lit(0)).cast("int").alias("b")).alias("s"))
    held = spans.groupBy("file_id").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    free = files.select("file_id", "content").join(held, "file_id", "left").select("file_id", F.explode(_free(F.col("content"), F.col("spans"))).alias("g"))
    return free.select("file_id", "g.first_line", "g.last_line", F.col("g.part_text").alias("content"))


@F.arrow_udf(PIECES)
def _free(content: pa.Array, spans: pa.Array) -> pa.Array:
    return listed(_between(t.as_py(), s.as_py()) for t, s in zip(content, spans, strict=True))


def _between(text: str | None, held: list[dict] | None) -> list[tuple[str, int, int]]:
    lines, out, at = [] if text is None else text.split("\n"), [], 0
    for a, b in [*((s["a"], s["b"]) for s in held or ()), (len(lines), len(lines))]:
        a = min(a, len(lines))
        trimmed = "\n".join(lines[at:a]).strip(BLANK)
        if len(trimmed) > 20:
            out.append((trimmed, at, a - 1))
        at = max(at, b + 1)
    return out


def chunk(files: DataFrame, symbols: DataFrame | None = None, most: int = 750, overlap: int = 200, module_level: bool = True) -> DataFrame:
    """Chunks of files (file_id, path, content, repo_root, project_id).

    symbols: file_id, name, type, line, end_line of definitions, which may nest.
    Files without any are cut by size alone."""
    if symbols is None:
        symbols = files.sparkSession.createDataFrame([], "file_id string, name string, type string, line int, end_line int")
    base = files.withColumns({"filename": paths.basename(F.col("path")), "language": paths.chunk_language(F.col("path")), "content_hash": F.sha2(F.encode("content", "UTF-8"), 256), "doc_path": paths.relative(F.col("path"), F.col("repo_root"))})
    with_symbols = symbols.select("file_id").distinct()
    plain = base.join(with_symbols, "file_id", "left_anti").select("*", F.col("filename").alias("symbol_name"), F.lit("module").alias("chunk_type"), F.col("content").alias("body"), F.lit(0).alias("offset"))
    first = F.greatest(F.col("line") - 1, F.lit(0))
    size = F.greatest(F.col("end_line") - 1, first) - first + 1
    named = base.join(symbols.select("file_id", "name", "type", "line", "end_line"), "file_id")
    body = F.array_join(F.slice(F.split("content", "\n", -1), first + 1, size), "\n")
    named = named.select(*base.columns, F.when(F.coalesce("name", F.lit("")) == "", "anonymous").otherwise(F.col("name")).alias("symbol_name"), F.when(F.coalesce("type", F.lit("")) == "", "symbol").otherwise(F.col("type")).alias("chunk_type"), body.alias("body"), first.alias("offset"))
    cut = by_size(plain.withColumn("numbered", F.lit(False)).unionByName(named.withColumn("numbered", F.lit(True))), "body", most, overlap)
    label = F.when(F.col("numbered") & (F.col("parts") > 1), F.format_string("%s[%d/%d]", "symbol_name", "part", "parts")).otherwise(F.col("symbol_name"))
    out = cut.select(*[c for c in base.columns if c != "content"], label.alias("symbol_name"), "chunk_type", (F.col("offset") + F.col("first_line")).alias("first"), (F.col("offset") + F.col("last_line")).alias("last"), F.col("part_text").alias("content"))
    if module_level:
        between = gaps(files.join(with_symbols, "file_id", "left_semi").select("file_id", "content"), symbols)
        rest = base.drop("content").join(between, "file_id")
        out = out.unionByName(rest.select(*[c for c in base.columns if c != "content"], F.lit("module_level").alias("symbol_name"), F.lit("module").alias("chunk_type"), F.col("first_line").alias("first"), F.col("last_line").alias("last"), "content"))
    return out.select(
        "file_id", "content", F.col("content").alias("semantic_content"), lexical_text(F.col("doc_path"), F.col("symbol_name"), F.col("language"), F.col("content")).alias("lexical_content"),
        "doc_path", "filename", "language", paths.content_type(F.col("language")).alias("content_type"), "symbol_name", "chunk_type",
        (F.col("first") + 1).alias("start_line"), (F.col("last") + 1).alias("end_line"), T.utf16_length(F.col("content")).alias("chunk_chars"), "content_hash", "project_id", "repo_root",
    )
