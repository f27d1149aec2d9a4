"""Bucketed lookups, discovery by metadata, shared budgets, observed figures, ordered streams."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from quarry.sources import files, layout, services, staging, store, sync
from quarry.sources.http import HttpEmbedder
from quarry.streaming import ingest


def test_lookups_move_no_stored_row(spark):
    made = store.Store(spark, staging.folder(spark, "laid")).ensure()
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("d"), F.col("id") % 30).alias("doc_path"), F.concat(F.when(F.col("id") % 2 == 0, "Sym").otherwise("sym"), F.col("id") % 20).alias("symbol_name"), F.lit("x").alias("content"))
    made.append(rows, "s", "p")
    noted = layout.Layout(made, 8).publish()
    assert layout.Layout(made, 8).publish() == noted
    # Another session learns of the files from the version file.
    for name in layout.KEYS:
        spark.sql(f"DROP TABLE {layout.Layout._name(noted['run'], name)}")
    laid = layout.Layout(made)
    asked = spark.createDataFrame([(0, "SYM4"), (1, "Sym6"), (2, "none")], "qid int, q string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for found, n in ((laid.by_symbol(asked), 40), (laid.by_path(spark.createDataFrame([("d3",), ("d9",), ("d9",)], "doc_path string")), 28)):
            plan = found._jdf.queryExecution().executedPlan().toString()
            # The stored rows are the join's left branch: filters and sorts, no exchange.
            stored = [line for line in plan.splitlines() if line.lstrip().startswith(":")]
            assert "Bucketed: true" in "".join(stored) and not any("Exchange" in line for line in stored) and "Exchange" in plan
            assert found.count() == n
        assert {r.tier for r in laid.by_symbol(asked).where("qid = 1").collect()} == {1} and {r.tier for r in laid.by_symbol(asked).where("qid = 0").collect()} == {2}
        one = laid.table("symbols").where("lower_name = 'sym4'")
        assert "EqualTo(lower_name,sym4)" in one._jdf.queryExecution().executedPlan().toString() and one.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    made.append(rows.limit(1), "s", "p")
    assert layout.Layout(made, 8).publish()["store_version"] == noted["store_version"] + 1


def test_skipped_folders_are_not_read(spark, tmp_path):
    root = tmp_path / "build" / "a b"  # a root whose own parents have a skipped name
    for name, text in {"x.py": "one", "deep/er/y.py": "two", "odd [x] {y}/o.py": "odd", "z.PY": "three", "w.md": "four", "node_modules/n.py": "no", "p/.git/q.py": "no", "lib.egg-info/e.py": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    with open(root / "node_modules" / "huge.py", "wb") as f:
        f.truncate(3 << 30)  # reading it fails: it is more than a row can hold
    (root / "bad.py").write_bytes(b"a\xffb")
    got = {r.file_id: r for r in files.collect(spark, str(root), ["py"], None).collect()}
    assert set(got) == {"x.py", "deep/er/y.py", "z.PY", "bad.py", "odd [x] {y}/o.py"}
    assert got["x.py"].content_hash == got["x.py"].raw_hash and got["bad.py"].content_hash != got["bad.py"].raw_hash
    assert all(r.modified is not None for r in got.values())


class Busy(http.server.BaseHTTPRequestHandler):
    most, window, calls, refused, lock = 24, 2.0, [], 0, threading.Lock()

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with self.lock:
            now = time.monotonic()
            Busy.calls = [t for t in Busy.calls if now - t < self.window * 0.9]
            over = len(Busy.calls) >= self.most
            Busy.refused += over
            Busy.calls.append(now)
        answer = json.dumps({"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])]}).encode()
        self.send_response(429 if over else 200)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


def test_tasks_share_a_budget(spark):
    """All tasks together keep to the calls that the service allows; without the share they would not."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Busy)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        embedder = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/", "k", "m", 2, delays=(0.1,) * 8, per_minute=Busy.most, window=Busy.window)
        rows = spark.range(60, numPartitions=8).select(F.concat(F.lit("t"), "id").alias("content"), F.lit(None).cast("string").alias("semantic_content"), F.lit(None).cast("array<double>").alias("embedding"))
        lanes, own = services.shared_out(rows, embedder)
        assert lanes.rdd.getNumPartitions() * own.per_minute <= Busy.most and embedder.per_minute == Busy.most
        assert services.embed_missing(rows, embedder, 1).where("embedding[1] = 1").count() == 60
        assert Busy.refused == 0
        # Refusals slow the task down and are then accepted.
        Busy.calls = [time.monotonic()] * Busy.most
        assert embedder.embed(["abc"]) == [[3.0, 1.0]] and Busy.refused >= 1
    finally:
        server.shutdown()


def test_figures_need_no_pass_of_their_own(spark, tmp_path):
    rows = spark.createDataFrame([("a", "ok", 2, 10), ("b", "ok", 1, 5), ("c", "failed", 0, 0), ("d", "skipped", 0, 7)], "doc_path string, state string, n_chunks long, n_bytes long")
    seen_rows = spark.sparkContext.accumulator(0)

    def tally(parts):
        for part in parts:
            seen_rows.add(len(part))
            yield part

    watched, seen = sync.observed(rows.mapInPandas(tally, rows.schema))
    watched.write.parquet(str(tmp_path / "out"))
    figures = sync.metrics(seen, 2.0)
    assert seen_rows.value == 4
    assert figures == {"files_ok": 2, "files_failed": 1, "files_skipped": 1, "chunks": 3, "bytes": 22, "seconds": 2.0, "chunks_per_second": 1.5, "bytes_per_second": 11.0}
    assert json.loads(sync.ingest_summary(rows).first().summary) == {k: figures[k] for k in ("files_ok", "files_failed", "files_skipped", "chunks", "bytes")}


def version(spark, *versions):
    return spark.createDataFrame([(p, f"/r/{p}", t, "/r", "p", m) for p, t, m in versions], "file_id string, path string, content string, repo_root string, project_id string, modified string").withColumn("modified", F.to_timestamp("modified"))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 2, 0)])
def test_versions_in_any_order(spark, order):
    made = store.Store(spark, staging.folder(spark, "streamed")).ensure()
    batches = [
        version(spark, ("a.txt", "one", "2024-01-01"), ("b.txt", "b first", "2024-01-01")),
        version(spark, ("a.txt", "three", "2024-01-03"), ("a.txt", "two", "2024-01-02")),
        version(spark, ("a.txt", "two and a half", "2024-01-02 12:00:00"), ("c.txt", "c", None)),
    ]
    for k in order:
        ingest.put(batches[k], made, "s", "p")
    held = lambda: sorted((r.doc_path, r.content) for r in made.read().collect())
    assert held() == [("a.txt", "three"), ("b.txt", "b first"), ("c.txt", "c")]
    # A batch that comes again makes no version.
    before = made.snapshot().version
    for b in batches:
        ingest.put(b, made, "s", "p")
    assert made.snapshot().version == before and held() == [("a.txt", "three"), ("b.txt", "b first"), ("c.txt", "c")]
