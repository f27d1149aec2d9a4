import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from quarry.api import Service
from quarry.functions import paths
from quarry.operators import chunks as chunking
from quarry.operators import code, hybrid, symbols
from quarry.sources import files, services, store, sync
from quarry.sources.http import HttpEmbedder, HttpReranker, authorised
from quarry.streaming import ingest


def split(text, most=750, overlap=200):
    """The rule of splitting, line by line, for comparison."""
    lines = text.split("\n")
    if len(text) <= most:
        return [(0, len(lines))]
    parts, cur, chars = [], [], 0
    for i, line in enumerate(lines):
        if chars + len(line) + 1 > most and cur:
            parts.append((cur[0], len(cur)))
            back, size = 0, 0
            while back < len(cur) and size < overlap:
                back += 1
                size += len(lines[cur[-back]]) + 1
            cur = cur[len(cur) - back :]
            chars = sum(len(lines[k]) + 1 for k in cur)
        cur.append(i)
        chars += len(line) + 1
    return [*parts, (cur[0], len(cur))]


TEXTS = ["", "x" * 2000, "a\n" * 400, "b" * 750, "c" * 751, "\n".join("line %d " % i * (i % 9) for i in range(200)), "short\n" + "y" * 900 + "\nend\n", "z\n\n\n" * 300]


def test_split_by_size(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {}
    for r in chunking.by_size(rows, "text").orderBy("id", "part").collect():
        got.setdefault(r.id, []).append((r.first_line, r.last_line - r.first_line + 1))
        assert r.part_text == "\n".join(r.text.split("\n")[r.first_line : r.last_line + 1])
    assert got == {i: split(t) for i, t in enumerate(TEXTS)}


SOURCE = "import { db } from './database-client';\n\nexport function getUser(id) {\n  return db.find(id);\n}\n\nexport class UserService {\n  run(x) {\n    return x;\n  }\n}\n"


def test_chunks_of_a_file(spark):
    given = spark.createDataFrame([("f", "/r/src/user.ts", SOURCE, "/r", "p"), ("g", "/r/x.unknownext", "one line", "/r", "p")], "file_id string, path string, content string, repo_root string, project_id string")
    out = {(r.file_id, r.symbol_name): r for r in chunking.chunk(given, code.definitions(given)).collect()}
    assert set(out) == {("f", "getUser"), ("f", "UserService"), ("f", "run"), ("f", "module_level"), ("g", "x.unknownext")}
    one = out["f", "getUser"]
    assert one.content == one.semantic_content and one.lexical_content == "# File: src/user.ts | Symbol: getUser | Language: typescript\n" + one.content
    assert (one.start_line, one.end_line, one.content_type, one.chunk_type) == (3, 5, "code", "function") and len(one.content_hash) == 64
    assert out["f", "module_level"].content.startswith("import") and out["g", "x.unknownext"].language == "unknown"


def test_python_symbols(spark):
    source = "import os\n\n@wrap\ndef outer(a, *, b):\n    if a:\n        return call(a.b)\n\nclass Box:\n    async def open(self) -> int:\n        await go()\n"
    given = spark.createDataFrame([("f", "m.py", source), ("bad", "b.py", "def f(:\n"), ("no", "n.xyz", "x"), ("null", "n.py", None)], "file_id string, path string, content string")
    defs = {(r.name, r.type, r.line, r.end_line) for r in code.definitions(given).collect()}
    assert defs == {("outer", "function", 3, 6), ("Box", "class", 8, 10), ("open", "function", 9, 10)}
    assert {r.file_id for r in code.syntax_errors(given).collect()} == {"bad"}
    s = code.structure(given, "open").first()
    assert (s.params, s.return_kind, s.parent_kind, s.modifiers) == (["self"], "int", "class", ["async"])
    found = symbols.find(code.symbols(given), "Box.open").collect()
    assert [(r.name, r.line) for r in found] == [("open", 9)]
    anchors = {(r.block, r.kind) for r in symbols.assign_anchors(*code.blocks(given)).collect()}
    assert ("outer:3", "if") in anchors and ("outer:3", "return") in anchors and ("open:9", "await") in anchors
    prints = given.where("file_id = 'f'").select(code.fingerprint("content", F.lit(3), F.lit(6)).alias("p")).first().p
    assert prints[0] in ("Name", "FunctionDef", "arguments") and "If" in prints


def test_similarity(spark):
    rows = [(["a", "b"], ["c"]), (["a", "b", "c"], ["x"]), (list("abcd"), list("abcd")), (list("abcd"), list("abce"))]
    got = [r.s for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(symbols.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert [round(x, 4) for x in got] == [1.0, 0.0, 1.0, round(1 / 3, 4)]


def test_symbol_lists(spark):
    rows = spark.createDataFrame([("f", "aB", "def", "function", 1, 2, 0), ("f", "aB", "def", "function", 1, 2, 4), ("f", "c", "ref", "call", 3, 3, 0)], "file_id string, name string, kind string, type string, line int, end_line int, column int")
    assert symbols.listed(rows).count() == 2 and symbols.listed(rows, name="AB").first().column == 0
    assert symbols.listed(rows, kind="ref", exclude=("c",)).count() == 0


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store")).ensure().ensure()
    rows = spark.createDataFrame([("a", "d1", "h1"), ("b", "d1", "h1"), ("c", "d2", None)], "content string, doc_path string, content_hash string")
    s.append(rows, "s", "p")
    s.append(rows.where("doc_path = 'd1'"), "s", "q/1")
    assert s.read().count() == 5
    assert {(r.doc_path, r.chunk_count) for r in store.sources(s.read().where("project_id = 'p'")).collect()} == {("d1", 2)}
    assert {(r.content_type, r.n) for r in store.stats(s.read()).collect()} == {("unknown", 5)}
    one = spark.createDataFrame([("d1",)], "doc_path string")
    assert s.delete_docs("s", one, "p") == 2 and s.read().where("project_id = 'q/1'").count() == 2
    s.upsert(spark.createDataFrame([("new", "d2", "h3")], "content string, doc_path string, content_hash string"), "s", "p")
    assert [(r.content, r.lexical_content) for r in s.read().where("project_id = 'p'").collect()] == [("new", "new")]
    assert s.delete("s", {"project_id": "q/1"}) == 2 and s.read().count() == 1
    assert s.delete("s", {"doc_path": "d2"}, {"doc_path": "ignored"}) == 1 and s.read().count() == 0
    with pytest.raises(ValueError):
        s.delete("s")


def test_sync_plan(spark):
    local = spark.createDataFrame([("new", "a", 1), ("changed", "b", 1), ("same", "c", 2), ("few", "d", 3)], "doc_path string, content_hash string, expected_chunks long")
    stored = spark.createDataFrame([("changed", "x", 1), ("same", "c", 2), ("few", "d", 2), ("old", "e", 1)], "doc_path string, content_hash string, chunk_count long")
    act = lambda **k: {r.doc_path: r.action for r in sync.plan(local, stored, **k).collect()}
    assert act() == {"new": "new", "changed": "updated", "same": "unchanged", "few": "incomplete", "old": "stale"}
    assert act(force=True, stale=False) == {"new": "new", "changed": "updated", "same": "forced", "few": "forced"}
    assert sync.counters(sync.plan(local, stored)).first().asDict() == {"n_new": 1, "n_updated": 2, "n_incomplete": 1, "n_unchanged": 1, "n_stale": 1}
    assert [r.status for r in sync.status(sync.plan(local, stored)).collect()] == ["outdated", "incomplete", "missing", "stale", "current"]


def test_projects(spark):
    asked = spark.createDataFrame([("i1",), ("web",), ("web/src",), ("/r/api",), ("/r/api/x/y",), ("none",)], "key string")
    registry = spark.createDataFrame([("i1", "core", "/r"), ("i2", "web", "/w"), ("i3", "api", "/r/api")], "id string, name string, root string")
    assert {r.key: r.id for r in sync.find_projects(asked, registry).collect()} == {"i1": "i1", "web": "i2", "web/src": "i2", "/r/api": "i3", "/r/api/x/y": "i3", "none": None}
    got = spark.createDataFrame([("/r/api/x",), ("/z",)], "p string").select(sync.resolve_project(F.col("p"), ["/r", "/r/api"]).alias("r")).collect()
    assert [r.r for r in got] == ["/r/api", None]


def test_files_and_service(spark, tmp_path):
    root = tmp_path / "repo"
    for name, text in {"src/a.py": "def alpha():\n    return 1\n", "README.md": "# Title\n\nwords about alpha and beta\n", "node_modules/x.js": "no", "Makefile": "no", "big.py": "x" * 300_000, "go.sum": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert [r.file_id for r in files.collect(spark, str(root), ["py", "md", "js", "sum"]).collect()] == ["README.md", "src/a.py"]
    service = Service(spark, str(tmp_path / "store"), embedder=services.HashEmbedder(16))
    assert service.index(str(root), "s", "p", ["py", "md"]).first().n_new == 2
    assert service.index(str(root), "s", "p", ["py", "md"]).first().n_unchanged == 2
    out = service.search("s", "alpha", project_id="p").collect()
    assert out and out[0]["mode"] == "symbol+hybrid" and out[0].source == "src/a.py"
    (root / "README.md").unlink()
    (root / "src/a.py").write_text("def gamma():\n    return 2\n")
    assert service.index(str(root), "s", "p", ["py", "md"]).first().asDict() == {"n_new": 0, "n_updated": 1, "n_incomplete": 0, "n_unchanged": 0, "n_stale": 1}
    assert {r.doc_path for r in service.sources("s").collect()} == {"src/a.py"} and service.health()
    with pytest.raises(ValueError):
        service.search("s", "x", filters_={"nope": "1"})


def test_streaming(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    row = {"file_id": "f", "path": "/r/a.txt", "content": "first words of a file", "repo_root": "/r", "project_id": "p"}
    (inbox / "1.json").write_text(json.dumps(row))
    s = store.Store(spark, str(tmp_path / "store")).ensure()
    for text in ("first words of a file", "second words"):
        (inbox / f"{len(text)}.json").write_text(json.dumps(row | {"content": text}))
        ingest.start(ingest.read(spark, str(inbox)), s, "s", "p", str(tmp_path / "cp")).awaitTermination()
    assert [r.content for r in s.read().collect()] == ["second words"]


def test_services():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("429")
        return "ok"

    assert services.retry(flaky, (1, 3, 8), lambda e: isinstance(e, OSError), waits.append) == "ok" and waits == [1, 3]
    with pytest.raises(KeyError):
        services.retry(lambda: {}["x"], (1,), lambda e: False, waits.append)
    now = [0.0]
    limiter = services.RateLimiter(2, 5, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limiter.wait()
    assert now[0] == 65.0
    for _ in range(9):
        limiter.refused()
    with pytest.raises(RuntimeError):
        limiter.refused()


def test_embedding_of_missing_rows(spark):
    rows = spark.createDataFrame([("a b", None, None), ("c", "d", None), ("e", None, [1.0] * 4)], "content string, semantic_content string, embedding array<float>")
    out = services.embed_missing(rows, services.HashEmbedder(4)).collect()
    assert all(len(r.embedding) == 4 for r in out) and len(out) == 3


def test_paths():
    assert paths.normalize(" '/a//b/../c' ") == "/a/c" and paths.normalize("~/x", "/home/u") == "/home/u/x"
    assert paths.is_supported("x.PY") and not paths.is_supported("Makefile") and ".mdx" in paths.supported_extensions()
    assert paths.size_text(10) == "10 B" and paths.size_text(2048) == "2.0 KB"


class Stub(http.server.BaseHTTPRequestHandler):
    """An embedding service: busy at first, answers out of order."""

    refuse = 0

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if not authorised(self.headers["Authorization"], "k") or Stub.refuse > 0:
            Stub.refuse -= 1
            self.send_response(401 if not authorised(self.headers["Authorization"], "k") else 503)
            self.end_headers()
            return
        if self.path == "/v1/embeddings":
            out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]}
        else:
            out = {"results": [{"index": i, "relevance_score": len(t) / 100} for i, t in enumerate(body["documents"])][-body["top_n"] :]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *a):
        pass


def test_http_services(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/"
    try:
        embedder = HttpEmbedder(base, "k", "m", 2, delays=(0.01, 0.01))
        Stub.refuse = 2
        assert embedder.embed(["a", "bbb"]) == [[1.0, 1.0], [3.0, 1.0]] and embedder.embed([]) == []
        rows = spark.createDataFrame([("x", None, None), ("yy", "zzzz", [0.0, 0.0])], "content string, semantic_content string, embedding array<double>")
        assert sorted(r.embedding[0] for r in services.embed_missing(rows, embedder).collect()) == [0.0, 1.0]
        for wrong in (HttpEmbedder(base, "other", "m", 2, delays=()), HttpEmbedder(base, "k", "m", 3, delays=())):
            with pytest.raises((OSError, ValueError)):
                wrong.embed(["a"])
        rank = HttpReranker(base, "k", top=2, delays=(0.01,))
        assert [x if x == x else None for x in rank("q", ["a", "bb", "ccc"])] == [None, 0.02, 0.03]
        assert HttpReranker(base, "other", delays=())("q", ["a"]) is None
        pool = spark.createDataFrame([(0, i, t, t, 0.5) for i, t in enumerate(("aaaa", "bb", "ccc"), 1)], "qid long, pos int, content string, lexical_content string, score double")
        step = services.reranker(rank, spark.createDataFrame([(0, "q")], "qid long, query string"))
        assert [(r.pos, r.content) for r in step(pool, 5).orderBy("pos").collect()] == [(1, "ccc"), (2, "bb")]
    finally:
        server.shutdown()


def test_search_returns_stored_ids(spark, tmp_path):
    service = Service(spark, str(tmp_path / "s"), embedder=services.HashEmbedder(8))
    rows = spark.createDataFrame([(f"my-id-{i}", f"def rate_limiter_{i}(): pass # words {i}", f"f{i}.py", f"rate_limiter_{i}", i, i + 3) for i in range(4)], "id string, content string, doc_path string, symbol_name string, start_line int, end_line int")
    service.insert("s", rows, "p")
    found = service.search("s", "words 2", project_id="p")
    assert {r.id for r in found.collect()} <= {f"my-id-{i}" for i in range(4)}
    lines = [r.line for r in hybrid.render(found).collect()]
    assert lines and all(x.startswith("── f") and "(rate_limiter_" in x for x in lines)
    index, view = service.indexes.get("s", "p")
    assert index.index(view).postings.count() > 0
    service.insert("s", rows.limit(1).withColumn("id", F.lit("again")), "p")
    assert "again" in {r.id for r in service.search("s", "rate limiter words", project_id="p", limit=50, mode="lexical").collect()}


def test_files_are_hashed_in_pieces_as_whole_ones_are(spark, tmp_path):
    kept = {"a.txt": b"one\ntwo\n", "b.txt": b"no end", "c.txt": b"", "d.txt": b"\n\n", "e +%41.txt": "ä\r\nb".encode(), "mark.txt": b"\xef\xbb\xbfa\nb", "marked.txt": b"\xef\xbb\xbfa\nb\n", "bad.txt": b"x\xe4\nq\xff\xf0\x9f\n", "long.txt": b"line of a file\n" * 40_000}
    (tmp_path / "sub").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name, data in kept.items():
        (tmp_path / "sub" / name).write_bytes(data)
    (tmp_path / "node_modules" / "a.txt").write_bytes(b"x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = files.hashed(spark, str(tmp_path), ["txt"]).drop("modified").collect()
        plan = files.hashed(spark, str(tmp_path), ["txt"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    want = files.collect(spark, str(tmp_path), ["txt"], None).select("file_id", "path", "content_hash", "raw_hash", "length").collect()
    assert got == want and {r.file_id for r in got} == {f"sub/{n}" for n, data in kept.items() if data} and "content#" not in plan.split("Relation")[0]
