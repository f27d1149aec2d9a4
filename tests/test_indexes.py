"""The catalogue of indexes: found by other processes, built once, brought up to date."""

import json
import os
import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import delta, lexical
from quarry.sources import indexes, staging, store


@pytest.fixture
def made(spark):
    kept = store.Store(spark, staging.folder(spark, "indexed")).ensure()
    kept.append(rows(spark, a="user alpha", b="user beta rate_limit", c="gamma"), "s", "p")
    kept.append(rows(spark, z="user other project"), "s", "q")
    return kept


def rows(spark, **texts):
    return spark.createDataFrame([(f"id-{d}", d, t) for d, t in texts.items()], "id string, doc_path string, content string")


def hits(spark, got, query="user beta"):
    index, view = got
    asked = spark.createDataFrame([(0, query)], "qid long, query string")
    return [(r.chunk_id, round(r.score, 9)) for r in index.search(asked, 10, at=view).orderBy("rank").collect()]


def rebuilt(spark, kept, query="user beta"):
    chunks = kept.read().where("store_id = 's' AND project_id = 'p'").withColumn("chunk_id", F.col("id"))
    asked = spark.createDataFrame([(0, query)], "qid long, query string")
    return [(r.chunk_id, round(r.score, 9)) for r in lexical.search(lexical.build(lexical.index_text(chunks)), asked, 10).orderBy("rank").collect()]


@pytest.fixture
def counted(monkeypatch):
    calls = []
    for name in ("rebuild", "apply", "annotate"):
        plain = getattr(delta.DeltaIndex, name)
        monkeypatch.setattr(delta.DeltaIndex, name, lambda self, *a, _p=plain, _n=name, **k: (calls.append(_n), _p(self, *a, **k))[1])
    return calls


def test_an_index_follows_its_store(spark, made, counted):
    catalogue = indexes.Catalogue(made)
    first = catalogue.get("s", "p")
    assert hits(spark, first) == rebuilt(spark, made) and counted == ["rebuild"]
    before, old = hits(spark, first), made.snapshot()
    made.upsert(rows(spark, a="user user new", d="beta beta"), "s", "p", spark.createDataFrame([("c",)], "doc_path string"))
    second = catalogue.get("s", "p")
    assert hits(spark, second) == rebuilt(spark, made) != before and counted == ["rebuild", "apply"]
    # Readers of the version before go on with it.
    assert hits(spark, first) == before == hits(spark, catalogue.get("s", "p", at=old))
    made.append(rows(spark, y="another project"), "s", "q")
    assert hits(spark, catalogue.get("s", "p")) == rebuilt(spark, made) and counted == ["rebuild", "apply", "annotate"]
    made.compact()
    assert hits(spark, catalogue.get("s", "p")) == rebuilt(spark, made) and counted[-1] == "rebuild"
    made.delete_project("s", "p")
    assert hits(spark, catalogue.get("s", "p")) == []
    assert len(made.files.listed(catalogue.folder)) == 1


def test_callers_at_the_same_time_build_once(spark, made, counted):
    catalogue, got = indexes.Catalogue(made, pause=0.05), []
    threads = [threading.Thread(target=lambda: got.append(hits(spark, catalogue.get("s", "p")))) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert counted == ["rebuild"] and len(got) == 4 and all(g == got[0] for g in got)
    assert "lease" not in [n for n, _ in made.files.listed(catalogue.path("s", "p"))]


def test_a_lapsed_lease_is_taken_over(spark, made, counted):
    catalogue = indexes.Catalogue(made, lease=0.5, pause=0.05)
    index = delta.DeltaIndex(spark, catalogue.path("s", "p"))
    assert catalogue._acquire(index) and catalogue._acquire(index) is None
    start = time.time()
    assert hits(spark, catalogue.get("s", "p")) == rebuilt(spark, made)
    assert time.time() - start > 0.3 and counted == ["rebuild"]


def test_another_process_finds_the_index(spark, made):
    catalogue = indexes.Catalogue(made)
    catalogue.get("s", "p")
    code = f"""
import json
from pyspark.sql import SparkSession
from quarry.operators import delta
from quarry.sources import indexes, store
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def fail(*a, **k): raise AssertionError("built again")
delta.DeltaIndex.rebuild = delta.DeltaIndex.apply = fail
index, view = indexes.Catalogue(store.Store(spark, {made.path!r})).get("s", "p")
asked = spark.createDataFrame([(0, "user beta")], "qid long, query string")
print(json.dumps([[r.chunk_id, round(r.score, 9)] for r in index.search(asked, 10, at=view).orderBy("rank").collect()]))
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, env=os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))})
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.splitlines()[-1]) == [list(h) for h in rebuilt(spark, made)]


def test_expiry(spark, made):
    catalogue = indexes.Catalogue(made)
    catalogue.get("s", "p")
    catalogue.get("s")
    assert catalogue.expire(3600) == [] and len(catalogue.expire(-1)) == 2
    assert made.files.listed(catalogue.folder) == []
    assert hits(spark, catalogue.get("s", "p")) == rebuilt(spark, made)
