"""Merkle dataset manifest: a hash tree over the rows of each source, and one over the sources.

H is the lowercase hex SHA-256 of its inputs, concatenated.  A row's leaf is H of
its fields, each `-` if null, else its length in UTF-8 bytes, a colon and the
value.  Nodes of one key are put in order, numbered and cut into blocks of
FANOUT ** DEPTH; a block is an ordered array that sequence, transform, slice and
aggregate collapse by DEPTH levels inside one expression.  The blocks' roots are
the nodes of the next pass, until each key has one.  Siblings then come down the
same passes: an element's path is that of its block's root, with the levels
inside the block before it.

Defined results: nulls in any field are hashed as `-`; a null source is a source
of its own, the first; a null id comes first in its source and is never tampered
with; repeated rows are leaves of their own; rows of one id follow each other by
their leaves (equal leaves by those of the changed rows), so results do not
depend on the files; a source of one row has its leaf as subroot, one source has
the root as subroot, and no siblings at all hash as the empty string; an empty
table gives no rows; other columns are not read.  Texts are hashed once, into a
written table of small rows; ranges of (key, order) are sorted, so a source with
a third of all rows is many tasks' work, and a group is one block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import work

FANOUT, DEPTH = 16, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def tampered(doc_id: Column) -> Column:
    """Rows whose text an attacker changes: 5 divides the CRC-32 of the decimal id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: Column | None = None) -> DataFrame:
    """doc_id, source, leaf, now (the leaf of the row as it is after tampering); the text is the last field."""
    *rest, text = [F.col(f) for f in fields]
    hit = tampered(rest[0]) & text.isNotNull()
    now = F.when(hit, leaf(*rest, F.translate(text, UPPER, LOWER) if changed is None else changed))
    made = docs.select(rest[0].alias("doc_id"), rest[1].cast("string").alias("source"), leaf(*rest, text).alias("leaf"), now.alias("now"))
    return made.withColumn("now", F.coalesce("now", "leaf"))


def numbered(nodes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """nodes, written in the order of (key, order), with pos: the place within the key, from 0."""
    laid = nodes.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("place", F.monotonically_increasing_id())
    laid = work.save(laid.withColumn("part", F.shiftright("place", 33)), "merkle-order")
    parts = laid.groupBy(key, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    parts = work.save(parts.select(F.col(key).alias("k"), F.col("part").alias("p"), (before - F.col("first")).alias("shift")), "merkle-parts")
    joined = laid.join(parts, (F.col("part") == F.col("p")) & F.col(key).eqNullSafe(F.col("k")))
    return joined.withColumn("pos", F.col("place") + F.col("shift")).drop("place", "part", "k", "p", "shift")


def collapse(nodes: Column, fanout: int = FANOUT) -> Column:
    """One level up: every fanout nodes of the array become their H."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / F.lit(fanout)).cast("int"))
    return F.transform(runs, lambda r: digest(F.array_join(F.slice(nodes, r * fanout + 1, F.lit(fanout)), "")))


def blocks(nodes: DataFrame, key: str, payload: list[str], fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """key, block, items (ordered by pos), levels (arrays of nodes, the block's root last), whole: the block is all of its key.

    A block that is all of its key climbs only until one node is left; others climb depth levels."""
    size = fanout**depth
    of = nodes.groupBy(key, F.expr(f"pos div {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", *payload))).alias("items"), F.count("*").alias("n"))
    counts = work.save(nodes.groupBy(F.col(key).alias("k")).agg((F.max("pos") < size).alias("whole")), "merkle-counts")
    of = of.join(counts, F.col(key).eqNullSafe(F.col("k")))
    start = F.array(F.transform("items", lambda x: x["node"]))
    steps = F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda k: ~F.col("whole") | (F.pow(F.lit(float(fanout)), k - 1) < F.col("n")))
    levels = F.aggregate(steps, start, lambda done, k: F.concat(done, F.array(collapse(F.element_at(done, -1), fanout))))
    return of.select(key, "block", "items", levels.alias("levels"), "whole")


def inside(levels: Column, at: Column, fanout: int = FANOUT) -> Column:
    """The path of element at within its block: what stands left and right of its node at each level."""

    def step(level: Column, k: Column) -> Column:
        here = F.floor(at / F.pow(F.lit(float(fanout)), k)).cast("int")
        mine = here % fanout
        run = F.slice(level, here - mine + 1, F.lit(fanout))
        return F.struct(F.array_join(F.slice(run, F.lit(1), mine), "").alias("left"), F.array_join(F.slice(run, mine + 2, F.lit(fanout)), "").alias("right"))

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)


class Tree:
    """The passes over nodes (key, pos, node, payload); `roots` holds key and root."""

    def __init__(self, nodes: DataFrame, key: str, payload: list[str], fanout: int = FANOUT, depth: int = DEPTH):
        self.key, self.fanout, self.passes = key, fanout, []
        done = []
        while not done or not nodes.isEmpty():
            made = work.save(blocks(nodes, key, [] if self.passes else payload, fanout, depth), "merkle-blocks")
            self.passes.append(made)
            tops = made.select(key, F.col("block").alias("pos"), F.element_at(F.element_at("levels", -1), 1).alias("node"), "whole")
            done.append(tops.where("whole").select(key, F.col("node").alias("root")))
            nodes = tops.where("NOT whole").select(key, "pos", "node")
        self.roots = reduce(DataFrame.unionByName, done)

    def paths(self, above: DataFrame) -> DataFrame:
        """key, pos, node, payload, path and what else above holds for every first node; above has k, the key, and the path of its root."""
        more = [c for c in above.columns if c not in ("k", "path")]
        of_keys = above.select("k", F.col("path").alias("upper"), *more)
        of_blocks = None
        for n, made in reversed(list(enumerate(self.passes))):
            found = made.where("whole").join(of_keys, F.col(self.key).eqNullSafe(F.col("k")))
            if of_blocks is not None:
                same = F.col(self.key).eqNullSafe(F.col("k")) & (F.col("block") == F.col("b"))
                found = found.unionByName(made.where("NOT whole").join(of_blocks, same).drop("b"))
            levels, upper = F.col("levels"), F.col("upper")
            each = F.transform("items", lambda x, i: F.struct(x.alias("item"), F.concat(inside(levels, i, self.fanout), upper).alias("path")))  # noqa: B023
            out = found.select(self.key, *more, F.explode(each).alias("e")).select(self.key, "e.item.*", "e.path", *more)
            if n:
                of_blocks = work.save(out.select(F.col(self.key).alias("k"), F.col("pos").alias("b"), F.col("path").alias("upper"), *more), "merkle-paths")
        return out


def fold(start: Column, path: Column) -> Column:
    """The root that start and its siblings give."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof(path: Column) -> Column:
    """H of all siblings, from the lowest level to the highest, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, source for every row."""
    made = work.save(leaves(docs, fields), "merkle-leaves").withColumnRenamed("leaf", "node")
    tree = Tree(numbered(made, "source", ["doc_id", "node", "now"]), "source", ["doc_id", "now"], fanout, depth)
    subroots = work.save(tree.roots.select(F.lit(0).alias("all"), "source", F.col("root").alias("node")), "merkle-subroots")
    top = Tree(numbered(subroots, "all", ["source"]), "all", ["source"], fanout, depth)
    none = F.array().cast("array<struct<left:string,right:string>>")
    whole = top.paths(work.save(docs.sparkSession.range(1).select(F.lit(0).alias("k"), none.alias("path")), "merkle-top"))
    # A subroot and its siblings give the root, in every row of this small table.
    above = work.save(whole.select(F.col("source").alias("k"), "path", F.col("node").alias("subroot"), fold(F.col("node"), F.col("path")).alias("root")), "merkle-above")
    path = F.col("path")
    out = tree.paths(above).select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof(path).alias("proof_sha256"), fold(F.col("now"), path).alias("folded_root"), "source")
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source")
