"""Versions, delete vectors and concurrent writers of the chunk store."""

import threading

import pytest
from pyspark.sql import functions as F

from quarry.sources import commits, staging, store


@pytest.fixture
def made(spark):
    return store.Store(spark, staging.folder(spark, "versions")).ensure()


def rows(spark, *docs, text="text", chunks=2):
    return spark.createDataFrame([(f"{d}-{k}-{text}", d, f"{text} of {d}", f"hash {text}") for d in docs for k in range(chunks)], "id string, doc_path string, content string, content_hash string")


def held(df):
    return sorted((r.project_id, r.doc_path, r.content) for r in df.select("project_id", "doc_path", "content").collect())


def test_readers_keep_their_version(spark, made):
    made.append(rows(spark, "a", "b"), "s", "p")
    before = made.read()
    first = made.snapshot().version
    made.upsert(rows(spark, "a", text="new", chunks=1), "s", "p")
    made.delete_docs("s", spark.createDataFrame([("b",)], "doc_path string"))
    assert held(before) == held(made.read(first)) == [("p", "a", "text of a")] * 2 + [("p", "b", "text of b")] * 2
    assert held(made.read()) == [("p", "a", "new of a")]
    assert made.snapshot().version == first + 2


def test_a_crash_before_publishing_changes_nothing(spark, made, monkeypatch):
    made.append(rows(spark, "a", "b"), "s", "p")
    before = held(made.read())

    def crash(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(commits.Versions, "publish", crash)
        for change in (lambda: made.upsert(rows(spark, "a", text="new"), "s", "p"), lambda: made.delete_docs("s", spark.createDataFrame([("a",)], "doc_path string")), made.compact):
            with pytest.raises(OSError, match="lost"):
                change()
    assert held(made.read()) == before
    # What the crashes left is no version's and goes.
    assert len(made.vacuum(older_s=-1)) == 4
    assert held(made.read()) == before
    made.upsert(rows(spark, "a", text="new"), "s", "p")
    assert held(made.read()) == [("p", "a", "new of a")] * 2 + [("p", "b", "text of b")] * 2


def test_written_bytes_follow_the_change(spark, made):
    big = spark.range(20_000).select(F.concat(F.lit("d"), (F.col("id") % 2000)).alias("doc_path"), F.sha2(F.col("id").cast("string"), 512).alias("content"))
    made.append(big, "s", "p")
    whole = made.files.size(made.path)
    made.upsert(rows(spark, "d7"), "s", "p")
    made.delete_docs("s", spark.createDataFrame([("d9",)], "doc_path string"), "p")
    assert whole > 1_000_000 and made.files.size(made.path) - whole < 60_000
    assert made.read().count() == 20_000 - 20 + 2
    # A whole project goes without any file but the version's.
    before = made.files.size(f"{made.path}/data") + made.files.size(f"{made.path}/deletes")
    assert made.delete_project("s", "p") == 19_982
    assert made.files.size(f"{made.path}/data") + made.files.size(f"{made.path}/deletes") == before and made.read().count() == 0
    made.append(rows(spark, "z"), "s", "p")
    assert held(made.read()) == [("p", "z", "text of z")] * 2


def test_compaction_keeps_the_rows(spark, made):
    for k in range(4):
        made.upsert(rows(spark, "a", f"b{k}", text=f"t{k}"), "s", "p")
    made.append(rows(spark, "c"), "s", "q")
    made.delete_project("s", "q")
    made.append(rows(spark, "c", text="again"), "s", "q")
    before, old = held(made.read()), made.snapshot()
    made.compact()
    now = made.snapshot()
    assert held(made.read()) == before and len(now.data) == 1 and now.deletes == now.drops == []
    assert held(made.read(old.version)) == before
    assert made.changes(old, now) is None
    gone = made.vacuum(keep=1, older_s=-1)
    assert len(gone) == len(old.data) + len(old.deletes) and held(made.read()) == before


def test_many_names_are_joined(spark, made, monkeypatch):
    monkeypatch.setattr(store, "NAMED_DOCS", 1)
    made.append(rows(spark, "a", "b", "c"), "s", "p")
    assert made.delete_docs("s", spark.createDataFrame([("a",), ("c",), ("a",)], "doc_path string")) == 4
    assert held(made.read()) == [("p", "b", "text of b")] * 2


def test_writers_at_the_same_time(spark, made):
    """Appends all stay; of writers of one scope each sees what came before it."""
    made.append(rows(spark, "a"), "s", "p")
    errors = []

    def run(f):
        try:
            f()
        except Exception as e:
            errors.append(e)

    work = [lambda k=k: made.append(rows(spark, f"n{k}"), "s", "p") for k in range(3)] + [lambda k=k: made.upsert(rows(spark, "a", text=f"u{k}"), "s", "p") for k in range(3)]
    threads = [threading.Thread(target=run, args=(f,)) for f in work]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert errors == []
    got = held(made.read())
    assert len(got) == 8 and len({c for _, d, c in got if d == "a"}) == 1
    assert made.snapshot().version == 8


def test_a_later_writer_of_a_scope_starts_again(spark, made, monkeypatch):
    made.append(rows(spark, "a"), "s", "p")
    plain, seen = made._write_places, []

    def slow(places):
        out = plain(places)
        if not seen:  # another writer comes between
            seen.append(1)
            store.Store(spark, made.path).upsert(rows(spark, "a", text="other"), "s", "p")
        return out

    monkeypatch.setattr(made, "_write_places", slow)
    made.upsert(rows(spark, "a", text="mine"), "s", "p")
    assert held(made.read()) == [("p", "a", "mine of a")] * 2
    made.append(rows(spark, "b"), "s", "q")
    with pytest.raises(commits.Conflict):
        made._publish(made.snapshot(2), {"data": ["x"]}, ["upsert", "s", "p"])


def test_changes_between_versions(spark, made):
    made.append(rows(spark, "a", "b"), "s", "p")
    before = made.snapshot()
    made.upsert(rows(spark, "a", text="new"), "s", "p")
    made.upsert(rows(spark, "a", text="newer"), "s", "p")
    added, gone = made.changes(before, made.snapshot())
    assert held(added) == [("p", "a", "newer of a")] * 2 and held(gone) == [("p", "a", "text of a")] * 2


def test_a_named_document_reaches_the_scan(spark, made):
    made.append(rows(spark, "a", "b"), "s", "p")
    plan = made._held(made.snapshot(), F.col("project_id") == "p", spark.createDataFrame([("a",)], "doc_path string"))._jdf.queryExecution().toString()
    assert "EqualTo(doc_path,a)" in plan and "PartitionFilters: [isnotnull(project_id" in plan


def test_texts_that_equal_the_content_are_written_once(spark, tmp_path):
    made = store.Store(spark, str(tmp_path / "s")).ensure()
    rows = [("1", "a", None, None), ("2", "b", "other", "b"), ("3", None, "x", None), ("4", "", None, "y"), ("5", "c", "", "c")]
    made.append(spark.createDataFrame(rows, "id string, content string, semantic_content string, lexical_content string"), "s", "p")
    got = {r.id: (r.content, r.semantic_content, r.lexical_content) for r in made.read().collect()}
    assert got == {"1": ("a", "a", "a"), "2": ("b", "other", "b"), "3": (None, "x", None), "4": ("", "", "y"), "5": ("c", "", "c")}
    files = spark.read.parquet(f"{made.path}/data")
    assert files.where("semantic_content = content OR lexical_content = content").isEmpty()
    made.compact()
    assert {r.id: (r.content, r.semantic_content, r.lexical_content) for r in made.read().collect()} == got
    assert spark.read.parquet(f"{made.path}/data/commit={made.snapshot().data[0]}").where("semantic_content = content").isEmpty()
