"""A lexical index that follows changes: runs of postings, tombstones and additive term statistics.

A run is what one change wrote: `postings` (term and lists of chunk_id, tf, dl) in order of term,
`forward` (chunk_id, dl, terms) in order of chunk, `gone` (chunk_id: rows of earlier
runs are dead), `terms` (what the change adds to each term's df, ttf, sum of squares
and damped sums) and `dfs` (what it adds to the number of terms of each df).  All but
postings are sums, so a change reads the forward rows of its own chunks and the sums
of their terms, never a posting; a search reads postings and sums of its own terms.
Runs are merged two by two as they grow, so their number is a logarithm; each change
publishes one version of the index, and readers keep the one they began with.

Results equal those of an index built anew from the same texts (statistics of all
terms follow every change)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.sources.commits import Conflict, Files, Versions

from . import lexical

#: Terms or chunks named in a filter that reaches the files; more of them are joined.
NAMED = 1000
#: Bytes of forward rows (files) for each part of the tables made of them.
PART_BYTES = 8_000_000
#: Bytes of texts that a task sorts by chunk and counts.
TEXT_BYTES = 32_000_000
SUMS = ("df", "ttf", "sq", "s", "sl")


class View(NamedTuple):
    """One version: its runs [id, postings], from the oldest, documents and tokens; note is the caller's."""

    version: int
    runs: list[list]
    n: int
    total: int
    note: Any
    kind: str


def _named(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose key is among wanted (a column key): a filter that prunes the files if these are few."""
    few = wanted.select(key).distinct().limit(NAMED + 1).collect()
    if len(few) <= NAMED:
        return rows.where(F.col(key).isin([r[0] for r in few]))
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def _sums(sign: int) -> list[Column]:
    m = T.fast_sigmoid(F.col("tf").cast("double"))
    return [F.lit(sign).cast("long").alias("df"), (sign * F.col("tf")).alias("ttf"), (sign * F.col("tf") * F.col("tf")).alias("sq"), (sign * m).alias("s"), (sign * m * F.log(m)).alias("sl")]


class DeltaIndex:
    """The index in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions, self.files = Versions(spark, self.path), Files(spark)

    @staticmethod
    def build(chunks: DataFrame, path: str, note: Any = None) -> DeltaIndex:
        """A new index of rows (chunk_id, text)."""
        made = DeltaIndex(chunks.sparkSession, path)
        made.rebuild(chunks, note)
        return made

    def rebuild(self, chunks: DataFrame, note: Any = None, kind: str | None = None) -> None:
        """One run of rows (chunk_id, text) in place of all runs; kind: the type of chunk ids."""
        latest = self.versions.latest()
        self._apply(View(latest, [], 0, 0, None, kind or dict(chunks.dtypes)["chunk_id"]), chunks, None, note)

    def annotate(self, note: Any) -> None:
        """A version with another note and the same content."""
        base = self.view()
        if not self.versions.publish(base.version + 1, base._replace(version=base.version + 1, note=note)._asdict()):
            raise Conflict(f"another writer changed {self.path}")

    def view(self, version: int | None = None) -> View:
        return View(**self.versions.read(self.versions.latest() if version is None else version))

    # ---- reading

    def _table(self, at: View, name: str) -> DataFrame:
        """All runs' rows of a table with `run`, the place of their run."""
        kinds = {
            "postings": lexical.INVERTED.format(at.kind), "forward": f"chunk_id {at.kind}, dl int, terms array<struct<term:string,tf:long>>", "gone": f"chunk_id {at.kind}",
            "terms": "term string, df long, ttf long, sq long, s double, sl double", "dfs": "df long, n long",
        }
        if not at.runs:
            return self.spark.createDataFrame([], f"{kinds[name]}, run int")
        parts = [self.spark.read.schema(kinds[name]).parquet(f"{self.path}/runs/{run}/{name}").withColumn("run", F.lit(k)) for k, (run, _) in enumerate(at.runs)]
        return reduce(DataFrame.unionByName, parts)

    def _live(self, at: View, rows: DataFrame) -> DataFrame:
        """Of rows (chunk_id, run) those that no later run replaced."""
        if len(at.runs) < 2:
            return rows
        last = self._table(at, "gone").groupBy("chunk_id").agg(F.max("run").alias("last"))
        return rows.join(last, "chunk_id", "left").where("last IS NULL OR last <= run").drop("last")

    def _corpus(self, at: View) -> DataFrame:
        dfs = self._table(at, "dfs").groupBy("df").agg(F.sum("n").alias("n_terms")).where("n_terms > 0")
        per = dfs.agg(F.coalesce(F.sum("n_terms"), F.lit(0)).alias("n_terms"), F.min("df").alias("least"))
        n = F.lit(at.n).cast("long")
        avgdl = F.lit(at.total / at.n if at.n else 0.0)
        # The rarest term has the highest idf.
        return lexical.parameters(per.select(n.alias("n"), avgdl.alias("avgdl"), F.coalesce(lexical.idf(n, F.col("least")), F.lit(1.0)).alias("idf_max"), "n_terms"))

    def _terms(self, at: View, rows: DataFrame) -> DataFrame:
        """The terms table of some of the sums."""
        per = rows.groupBy("term").agg(*[F.sum(c).alias(c) for c in SUMS]).where("df > 0")
        df = F.col("df").cast("double")
        var = (F.col("sq") * F.col("df") - F.col("ttf") * F.col("ttf")) / (df * df)
        return lexical.weighed(per.withColumns({"var": var, "n": F.lit(at.n).cast("long")}))

    def index(self, at: View | None = None) -> lexical.Index:
        """The whole index of a version, as the lexical operators take it."""
        at = at or self.view()
        postings = self._live(at, lexical.outspread(self._table(at, "postings"))).drop("run")
        docs = self._live(at, self._table(at, "forward")).select("chunk_id", "dl")
        return lexical.Index(postings, docs, self._terms(at, self._table(at, "terms")), self._corpus(at))

    def part(self, queries: DataFrame, at: View | None = None) -> lexical.Index:
        """What a search of queries (qid, query) needs of it: postings and sums of their terms alone, or for many queries the chunks' rows."""
        at = at or self.view()
        asked = lexical.query_terms(queries)
        rows = self._live(at, self._table(at, "forward")).drop("run")
        many = lexical.many(queries)
        postings = lexical.flat(rows) if many else self._live(at, lexical.outspread(_named(self._table(at, "postings"), "term", asked))).drop("run")
        return lexical.Index(postings, rows.select("chunk_id", "dl"), self._terms(at, _named(self._table(at, "terms"), "term", asked)), self._corpus(at), chunks=rows if many else None)

    def search(self, queries: DataFrame, top: int, normalized: bool = True, at: View | None = None) -> DataFrame:
        return lexical.search(self.part(queries, at), queries, top, normalized)

    # ---- changing

    def _publish(self, base: View, run: str, made: Callable[[], View]) -> None:
        if not self.versions.publish(base.version + 1, made()._asdict()):
            self.files.remove(f"{self.path}/runs/{run}")
            raise Conflict(f"another writer changed {self.path}")

    def apply(self, changed: DataFrame | None, removed: DataFrame | None = None, note: Any = None) -> None:
        """One change: rows (chunk_id, text) take the place of those of the same id or are added, those in removed (chunk_id) go."""
        self._apply(self.view(), changed, removed, note)
        now = self.view()
        while len(now.runs) > 1 and now.runs[-1][1] * 2 >= now.runs[-2][1]:
            self.merge(2)
            now = self.view()

    def _apply(self, base: View, changed: DataFrame | None, removed: DataFrame | None, note: Any) -> None:
        run = uuid.uuid4().hex
        folder = f"{self.path}/runs/{run}"
        empty = self.spark.createDataFrame([], f"chunk_id {base.kind}, text string")
        fresh = empty if changed is None else changed.select(F.col("chunk_id").cast(base.kind), "text")
        # One forward row for each chunk, written first and in order: all else is made from it.
        none = F.array().cast(lexical.TERMS)
        size = fresh.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        whole = lexical.forward(fresh, max(1, -(-size // TEXT_BYTES))).drop("copies")
        whole.write.parquet(f"{folder}/forward")
        added = self.spark.read.schema(whole.schema).parquet(f"{folder}/forward")
        ids = added.select("chunk_id")
        if removed is not None:
            ids = ids.unionByName(removed.select(F.col("chunk_id").cast(base.kind)))
        old = self._live(base, _named(self._table(base, "forward"), "chunk_id", ids)) if base.runs else empty.select("chunk_id", F.lit(0).alias("dl"), none.alias("terms"))
        old.select("chunk_id", "dl", "terms").write.parquet(f"{folder}/old")
        old = self.spark.read.schema(whole.schema).parquet(f"{folder}/old")
        old.select("chunk_id").write.parquet(f"{folder}/gone")
        n = self._parts(f"{folder}/forward", f"{folder}/old")
        self._in_order(lexical.inverted(added), n, "term", "first").write.parquet(f"{folder}/postings")
        both = lexical.flat(added).select("term", *_sums(1)).unionByName(lexical.flat(old).select("term", *_sums(-1)))
        change = both.groupBy("term").agg(*[F.sum(c).alias(c) for c in SUMS])
        self._in_order(change, n, "term").write.parquet(f"{folder}/terms")
        change = self.spark.read.schema(change.schema).parquet(f"{folder}/terms").select("term", "df")
        before = _named(self._table(base, "terms"), "term", change).groupBy("term").agg(F.sum("df").alias("before")) if base.runs else change.select("term", F.lit(0).alias("before"))
        steps = change.join(before, "term", "left").select(F.coalesce("before", F.lit(0)).cast("long").alias("b"), (F.coalesce("before", F.lit(0)) + F.col("df")).cast("long").alias("a"))
        moved = steps.select(F.explode(F.array(F.struct(F.col("b").alias("df"), F.lit(-1).alias("n")), F.struct(F.col("a").alias("df"), F.lit(1).alias("n")))).alias("x")).select("x.*")
        moved.where("df > 0").groupBy("df").agg(F.sum("n").alias("n")).where("n <> 0").coalesce(1).write.parquet(f"{folder}/dfs")
        figures = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        plus, minus = figures(added), figures(old)
        self.files.remove(f"{folder}/old")
        self._publish(base, run, lambda: base._replace(version=base.version + 1, runs=[*base.runs, [run, plus[2]]], n=base.n + plus[0] - minus[0], total=base.total + plus[1] - minus[1], note=note))

    def _parts(self, *folders: str) -> int:
        """Into how many parts what is made of these forward rows is dealt, so that a part's size does not follow the table."""
        return max(1, -(-sum(self.files.size(f) for f in folders) // PART_BYTES))

    @staticmethod
    def _in_order(rows: DataFrame, n: int, *keys: str) -> DataFrame:
        """Rows in n ranges of the keys; `first` is the first chunk of a list, which deals a frequent term's lists to several ranges."""
        by = [F.get("chunk_ids", F.lit(0)) if k == "first" else F.col(k) for k in keys]
        return rows.repartitionByRange(n, *by).sortWithinPartitions(*by)

    def merge(self, last: int | None = None) -> None:
        """The last runs (all if None) become one; tombstones stay for the runs before them."""
        base = self.view()
        first = 0 if last is None else max(0, len(base.runs) - last)
        merged = base._replace(runs=base.runs[first:])
        run = uuid.uuid4().hex
        folder = f"{self.path}/runs/{run}"
        parts = self._parts(*[f"{self.path}/runs/{r}/forward" for r, _ in merged.runs])
        self._in_order(self._live(merged, self._table(merged, "forward")).drop("run"), parts, "chunk_id").write.parquet(f"{folder}/forward")
        # Lists are made anew of the live rows: no posting is joined or sorted by itself.
        live = self.spark.read.schema(f"chunk_id {base.kind}, dl int, terms {lexical.TERMS}").parquet(f"{folder}/forward")
        self._in_order(lexical.inverted(live), parts, "term", "first").write.parquet(f"{folder}/postings")
        gone = self._table(merged, "gone").select("chunk_id").distinct()
        (gone if first else gone.limit(0)).write.parquet(f"{folder}/gone")
        sums = self._table(merged, "terms").groupBy("term").agg(*[F.sum(c).alias(c) for c in SUMS])
        self._in_order(sums.where("df > 0") if not first else sums, parts, "term").write.parquet(f"{folder}/terms")
        self._table(merged, "dfs").groupBy("df").agg(F.sum("n").alias("n")).where("n <> 0").coalesce(1).write.parquet(f"{folder}/dfs")
        n = live.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
        self._publish(base, run, lambda: base._replace(version=base.version + 1, runs=[*base.runs[:first], [run, n]]))

    def vacuum(self, keep: int = 2) -> None:
        """Forgets all but the last versions and removes runs that none of these names."""
        numbers = sorted(self.versions.numbers())
        for n in numbers[:-keep]:
            self.versions.forget(n)
        named = {run for n in numbers[-keep:] for run, _ in self.view(n).runs}
        for name, _ in self.files.listed(f"{self.path}/runs"):
            if name not in named:
                self.files.remove(f"{self.path}/runs/{name}")
