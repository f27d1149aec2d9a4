"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, in an order shuffled by hash, lie on one line of words
that is cut into blocks of equal size.  Slot j of the schedule maps the golden
ratio point frac((j + 1/2) * phi) through the sources' cumulative targets; slots
are ranked within their source, and the slot of rank r takes block r modulo the
source's blocks.  A source's schedule ends when its target is reached, the last
block cut short; slots that the sequence leaves short are appended.

Defined results: null texts have size 0 and are taken 0 times; a null source is
a source of its own, the last; an empty table gives no rows; repeated rows take
separate places on the line; null ids are allowed and spread by their texts; other columns are not read.  Rows
that are equal in id, source and text lie next to each other, in one chunk.  Sources
are ranked and their targets filled in one task: a row a source, some thousands.
Texts are read once, into a written table of sizes; only these small rows are
shuffled (the plan reuses the exchanges that its branches share).  Running sums are made inside chunks of bounded size with a prefix
over chunk totals, so a source with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import work
from .quality import words_of

SHARE, WEIGHTS, CAP = 1.5, (5, 2, 1), 2.0
SLOTS = 1 << 16
CHUNK_DOCS = 8_000
CHUNK_SLOTS = 4096
BINS = 4096
PHI = 0.6180339887498949


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 11) -> DataFrame:
    """doc_id, source, size, h: the place in the shuffled order."""
    of = F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), of.alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(source), F.col(text)).alias("h"))


def targets(measured: DataFrame, share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """A row a source: sid, source, n_docs, source_size, target.  Water filling over the sorted ratios of cap to weight."""
    per = measured.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    everything = Window.partitionBy()
    ranked = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    filled = (
        ranked.withColumns({"w": w, "cap": F.col("source_size") * F.lit(float(cap)), "total": F.sum("source_size").over(everything) * F.lit(float(share))})
        .withColumn("ratio", F.col("cap") / F.col("w"))
        .withColumn("k", F.row_number().over(Window.orderBy("ratio", "sid")))
    )
    upto = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    filled = filled.withColumns({"used": F.sum("cap").over(upto) - F.col("cap"), "rest": F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")})
    filled = filled.withColumn("level", (F.col("total") - F.col("used")) / F.col("rest"))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("k"))).over(everything)
    target = F.least(F.col("cap"), F.coalesce(level, F.col("ratio")) * F.col("w"))
    return filled.select("sid", "source", "n_docs", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """slot, sid, rank, block, words: what each slot of the mixture takes."""
    spark = sources.sparkSession
    total = Window.partitionBy()
    line = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    shares = sources.where("target > 0").select(
        "sid", "source_size", F.floor("target").cast("long").alias("words_due"),
        (F.sum("target").over(line) / F.sum("target").over(total)).alias("high"),
        ((F.sum("target").over(line) - F.col("target")) / F.sum("target").over(total)).alias("low"),
    )
    size = F.col("source_size")
    n_blocks = F.ceil(size / F.lit(block)).cast("long")
    rest = F.col("words_due") % size
    due = shares.withColumns({"n_blocks": n_blocks, "need": F.expr("words_due div source_size") * n_blocks + F.ceil(rest / F.lit(block)).cast("long")})
    # Points meet the sources by bins of the unit interval, an equality join.
    binned = due.select("sid", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * BINS), F.least(F.floor(F.col("high") * BINS), F.lit(BINS - 1).cast("long")))).alias("bin"))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.expr(f"(id + 0.5D) * {PHI!r}D - floor((id + 0.5D) * {PHI!r}D)").alias("point"))
    points = points.withColumn("bin", F.floor(F.col("point") * BINS))
    last = F.col("high") >= 1 - 1e-12
    drawn = points.join(binned, "bin").where((F.col("point") >= F.col("low")) & ((F.col("point") < F.col("high")) | last)).select("slot", "sid", F.expr(f"slot div {CHUNK_SLOTS}").alias("chunk"))
    per = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    before = per.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    ranked = drawn.join(before, ["sid", "chunk"]).select("slot", "sid", (F.col("before") + F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).alias("rank"))
    have = drawn.groupBy("sid").agg(F.count("*").alias("have"))
    short = due.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    tail = short.select((F.lit(slots) + F.col("sid")).alias("slot"), "sid", F.explode(F.sequence(F.col("have").cast("long"), F.col("need") - 1)).alias("rank"))
    b = F.col("rank") % F.col("n_blocks")
    before_words = F.expr("rank div n_blocks") * size + b * F.lit(block)
    full = F.least(F.lit(block).cast("long"), size - b * F.lit(block))
    return (
        ranked.unionByName(tail)
        .join(due, "sid")
        .where("rank < need")
        .select("slot", "sid", "rank", b.alias("block"), full.alias("full"), F.least(full, F.col("words_due") - before_words).alias("words"))
    )


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", share: float = SHARE, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row."""
    measured = work.save(sizes(docs, text, doc_id, source), "mix-sizes")
    sources = work.save(targets(measured, share, weights, cap), "mix-sources")
    whole = sources.agg(F.sum("target").alias("t"), F.sum("n_docs").alias("n")).first()
    block = max(1, math.ceil((whole["t"] or 0) / slots))
    n_slots = math.ceil((whole["t"] or 0) / block)
    bits = max(1, math.ceil(math.log2(max(2, (whole["n"] or 0) / CHUNK_DOCS))))
    placed = measured.alias("m").join(sources.alias("s"), F.expr("m.source <=> s.source")).select("m.doc_id", "m.source", "m.size", "m.h", "s.sid", "s.source_size", "s.target")
    placed = placed.withColumn("chunk", F.shiftright("h", 64 - bits))
    per = placed.groupBy("sid", "chunk").agg(F.sum("size").alias("n"))
    before = per.select("sid", "chunk", (F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = Window.partitionBy("sid", "chunk").orderBy("h", "doc_id", "size")
    laid = placed.join(before, ["sid", "chunk"]).select(
        "doc_id", "source", "size", "source_size", "target", "sid", "chunk",
        F.row_number().over(inside).alias("rn"),
        (F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("start"),
    )
    takes = schedule(sources, block, n_slots).groupBy("sid", "block").agg(F.count_if(F.col("words") == F.col("full")).alias("times"), F.max(F.when(F.col("words") < F.col("full"), F.col("words"))).alias("part"))
    last = F.expr(f"(start + size - 1) div {block}")
    pieces = laid.where("size > 0").select("sid", "chunk", "rn", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * F.lit(block)) - F.col("block") * F.lit(block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.lit(block)) - F.col("block") * F.lit(block)
    got = (high - low) * F.col("times") + F.greatest(F.lit(0).cast("long"), F.least(high, F.coalesce("part", F.lit(0)).cast("long")) - low)
    taken = pieces.join(takes, ["sid", "block"]).groupBy("sid", "chunk", "rn").agg(F.sum(got).alias("taken"))
    return laid.join(taken, ["sid", "chunk", "rn"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
