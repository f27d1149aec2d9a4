"""The index that follows changes, against an index built anew."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import delta, lexical
from quarry.sources import commits, staging

WORDS = ["user", "getUser", "rate_limit", "http", "XMLParser", "alpha", "beta", "gamma", "delta", "id"]


def rows(spark, texts):
    return spark.createDataFrame(list(texts.items()), "chunk_id long, text string")


def text(r):
    return " ".join(r.choice(WORDS) + (f" own{r.randrange(40)}" if r.random() < 0.3 else "") for _ in range(r.randrange(0, 14)))


def same(spark, index, texts):
    """Searches, statistics and terms equal those of an index of the texts."""
    whole = lexical.build(rows(spark, texts))
    asked = spark.createDataFrame([(k, q) for k, q in enumerate(["user alpha", "XMLParser rate_limit zzz", "own3 own4 getUser", "the"])], "qid long, query string")
    show = lambda df: sorted((r.qid, r.rank, r.chunk_id, round(r.score, 7)) for r in df.collect())
    assert show(index.search(asked, 7)) == show(lexical.search(whole, asked, 7))
    assert lexical.statistics(index.index()).collect() == lexical.statistics(whole).collect()
    terms = lambda ix: sorted((r.term, r.df, r.ttf, round(r.idf, 9), round(r.info, 7)) for r in ix.terms.collect())
    assert terms(index.index()) == terms(whole)
    lists = lambda ix: sorted(map(tuple, ix.postings.select("chunk_id", "term", "tf", "dl").collect()))
    assert lists(index.index()) == lists(whole)
    assert sorted(map(tuple, index.index().docs.collect())) == sorted(map(tuple, whole.docs.collect()))
    whole.release()


def test_changes_equal_a_rebuild(spark):
    r = random.Random(3)
    texts = {k: text(r) for k in range(60)}
    index = delta.DeltaIndex.build(rows(spark, texts), staging.folder(spark, "delta"), note="first")
    assert index.view().note == "first"
    same(spark, index, texts)
    for _ in range(3):
        changed = {r.randrange(70): text(r) for _ in range(5)}
        gone = r.sample(sorted(set(texts) - set(changed)), 3)
        index.apply(rows(spark, changed), spark.createDataFrame([(g,) for g in [*gone, 999]], "chunk_id long"))
        texts = {k: v for k, v in (texts | changed).items() if k not in gone}
    assert len(index.view().runs) > 1
    same(spark, index, texts)
    before = index.view()
    index.merge()
    same(spark, index, texts)
    assert len(index.view().runs) == 1 and index.index(before).docs.count() == len(texts)
    index.vacuum(keep=1)
    assert len(index.files.listed(f"{index.path}/runs")) == 1
    index.apply(None, rows(spark, texts).select("chunk_id"))
    same(spark, index, {})
    index.apply(rows(spark, {1: "alpha"}))
    same(spark, index, {1: "alpha"})


def test_a_change_reads_no_posting(spark):
    """With the base's postings out of the way a change still works: only forward rows and sums are read."""
    r = random.Random(4)
    texts = {k: text(r) for k in range(80)}
    index = delta.DeltaIndex.build(rows(spark, texts), staging.folder(spark, "delta"))
    run = index.view().runs[0][0]
    files, at = index.files, f"{index.path}/runs/{run}/postings"
    assert files.of(at).rename(files.path(at), files.path(at + ".away"))
    index.apply(rows(spark, {3: "alpha own1"}), spark.createDataFrame([(4,)], "chunk_id long"))
    assert files.of(at).rename(files.path(at + ".away"), files.path(at))
    same(spark, index, {k: v for k, v in (texts | {3: "alpha own1"}).items() if k != 4})


def test_a_search_reads_its_own_terms(spark):
    index = delta.DeltaIndex.build(rows(spark, {1: "alpha beta", 2: "gamma"}), staging.folder(spark, "delta"))
    asked = spark.createDataFrame([(0, "alpha zzz")], "qid long, query string")
    part = index.part(asked)
    for table in (part.postings, part.terms):
        assert "PushedFilters: [In(term, [alpha,zzz])" in table._jdf.queryExecution().toString().replace("[zzz,alpha]", "[alpha,zzz]")


def test_written_bytes_follow_the_change(spark):
    base = spark.range(3000).select(F.col("id").alias("chunk_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * k % 977) for k in range(1, 30)]).alias("text"))
    index = delta.DeltaIndex.build(base, staging.folder(spark, "delta"))
    whole = index.files.size(index.path)
    index.apply(rows(spark, {5: "alpha", 6: "beta"}))
    assert len(index.view().runs) == 2 and index.files.size(index.path) - whole < whole / 5


def test_writers_of_one_index(spark, monkeypatch):
    index = delta.DeltaIndex.build(rows(spark, {1: "alpha"}), staging.folder(spark, "delta"))
    old = index.view()
    index.apply(rows(spark, {2: "beta"}))
    monkeypatch.setattr(index, "view", lambda version=None: old)
    n = len(index.files.listed(f"{index.path}/runs"))
    with pytest.raises(commits.Conflict):
        index.apply(rows(spark, {3: "gamma"}))
    assert len(index.files.listed(f"{index.path}/runs")) == n


def test_postings_are_written_as_lists(spark, monkeypatch):
    """A row holds a term's postings of many chunks, so that what is shuffled and sorted is no row a posting; parts follow the size."""
    monkeypatch.setattr(lexical, "MOST_POSTINGS", 500)
    monkeypatch.setattr(delta, "PART_BYTES", 2000)
    r = random.Random(9)
    texts = {k: text(r) for k in range(300)} | {300: "", 301: "the"}
    index = delta.DeltaIndex.build(rows(spark, texts), staging.folder(spark, "delta"))
    run = index.view().runs[0][0]
    lists = spark.read.parquet(f"{index.path}/runs/{run}/postings")
    assert lists.count() < index.index().postings.count() / 3
    assert lists.rdd.getNumPartitions() > 0 and len([n for n, _ in index.files.listed(f"{index.path}/runs/{run}/postings") if n.startswith("part-")]) > 1
    same(spark, index, texts)
