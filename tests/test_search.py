import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.config import Config, load, read_env_file
from quarry.operators import filters, hybrid, symbols, vector
from quarry.sources import services

COLUMNS = "chunk_id long, content string, lexical_content string, embedding array<float>, project_id string, repo_root string, content_type string, doc_path string, source string, filename string, language string, symbol_name string, chunk_type string, content_hash string"


def chunks(spark, rows):
    full = [(i, c, c, v, "p", "/r", t, d, None, None, "x", s, "function", "h") for i, c, v, t, d, s in rows]
    return spark.createDataFrame(full, COLUMNS)


ROWS = [
    (1, "alpha service", [1.0, 0.0], "code", "a.ts", "UserService"),
    (2, "alpha beta", [0.9, 0.1], "code", "a.ts", "userService"),
    (3, "gamma", [0.0, 1.0], "markdown", "b.md", "MyUserServiceImpl"),
    (4, "alpha delta", [0.5, 0.5], "code", "", None),
    (5, "nothing", None, "code", "c.ts", "other"),
    (6, "zero", [0.0, 0.0], "code", "c.ts", "Other2"),
]


def asked(spark, *queries):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(queries)], "qid long, query string, embedding array<float>")


def test_symbol_tiers(spark):
    rows = chunks(spark, ROWS)
    out = symbols.search(rows, asked(spark, ("UserService", None), ("USERSERVICE", None), (" UserServiceImpl ", None), ("two words", None)), 10)
    got = {}
    for r in out.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.chunk_id, r.score))
    assert got == {0: [(1, 1.0), (2, 0.95), (3, 0.8)], 1: [(1, 0.95), (2, 0.95), (3, 0.8)], 2: [(3, 0.8)]}


def test_substring_budget_is_used_by_better_tiers(spark):
    rows = chunks(spark, [(i, "x", [1.0, 0.0], "code", f"{i}", "abc" if i < 3 else f"abc{i}") for i in range(8)])
    out = symbols.search(rows, asked(spark, ("abc", None)), 10, Config(symbol_fuzzy_limit=4))
    assert [r.chunk_id for r in out.orderBy("rank").collect()] == [0, 1, 2, 3]


def test_nearest_neighbours(spark):
    rows = chunks(spark, ROWS)
    got = vector.top_k(rows, [1.0, 0.0], 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [1, 2, 4] and got[0].score == 1.0
    for op in ("<=>", "<#>", "<->"):
        one = [(r.chunk_id, round(r.score, 6)) for r in vector.top_k(rows, [0.6, 0.2], 4, op, 0.0).orderBy("rank").collect()]
        many = [(r.chunk_id, round(r.score, 6)) for r in vector.batch_top_k(rows, asked(spark, ("q", [0.6, 0.2])).select("qid", "embedding"), 4, op, 0.0).orderBy("rank").collect()]
        assert one == many
    with pytest.raises(ValueError):
        vector.distance(F.col("embedding"), F.col("embedding"), "<%>")


def test_batch_against_numpy(spark):
    r = np.random.default_rng(0)
    v, q = r.standard_normal((300, 8)), r.standard_normal((5, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(v)], "chunk_id long, embedding array<double>").repartition(7)
    out = vector.batch_top_k(rows, spark.createDataFrame([(i, [float(x) for x in y]) for i, y in enumerate(q)], "qid long, embedding array<double>"), 6, min_score=0.0)
    d = 1 - (v @ q.T) / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(q, axis=1)
    want = {i: np.argsort(d[:, i], kind="stable")[:6].tolist() for i in range(5)}
    got = {}
    for x in out.orderBy("qid", "rank").collect():
        got.setdefault(x.qid, []).append(x.chunk_id)
    assert got == want


def test_normalisation(spark):
    rows = [("one", 0.3), *(("equal", 0.5) for _ in range(3)), ("neg", -2.0), ("neg", 0.0), ("neg", 2.0), ("tiny", 1.0), ("tiny", 1.0 + 1e-10)]
    out = spark.createDataFrame(rows, "g string, x double").select("g", hybrid.normalize(F.col("x"), "g").alias("y")).collect()
    got = {}
    for r in out:
        got.setdefault(r.g, []).append(r.y)
    assert {k: sorted(v) for k, v in got.items()} == {"one": [1.0], "equal": [1.0] * 3, "neg": [0.0, 0.5, 1.0], "tiny": [1.0, 1.0]}


def test_fusion_of_one_sided_hits(spark):
    a = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.5, 2), (1, 1, 0.7, 1)], "qid long, chunk_id long, score double, rank int")
    b = spark.createDataFrame([(0, 2, 1.0, 1), (0, 3, 0.2, 2)], "qid long, chunk_id long, score double, rank int")
    got = [(r.qid, r.chunk_id, round(r.score, 4)) for r in hybrid.fuse(a, b, Config()).orderBy("qid", "pos").collect()]
    assert got == [(0, 1, 0.6), (0, 2, 0.4), (0, 3, 0.0), (1, 1, 0.7)]


def test_source_limits_share_the_unknown_bucket(spark):
    rows = spark.createDataFrame([(0, 1, "", None, None, 1), (0, 2, None, None, "", 2), (0, 3, "a", None, None, 3), (0, 4, "", "a", None, 4)], "qid int, chunk_id int, doc_path string, source string, filename string, pos int")
    assert [r.chunk_id for r in hybrid.dedup_by_source(rows).orderBy("pos").collect()] == [1, 3]


def test_pipeline_modes(spark):
    rows = chunks(spark, ROWS)
    q = asked(spark, ("alpha", [1.0, 0.0]), ("gamma words", [0.0, 1.0]))
    out = hybrid.shape(hybrid.search(rows, q, Config(), limit=2), Config()).orderBy("qid", "rank").collect()
    assert {r["mode"] for r in out if r.qid == 1} == {"hybrid"}
    assert out[0].content.startswith(Config().code_warning.strip())
    one = hybrid.search(rows, asked(spark, ("UserService", [1.0, 0.0])), Config(), limit=2).orderBy("pos").collect()
    assert [(r.chunk_id, r["mode"]) for r in one] == [(1, "symbol"), (2, "symbol")]
    more = hybrid.search(rows, asked(spark, ("MyUserServiceImpl", [1.0, 0.0])), Config(), limit=3).orderBy("pos").collect()
    assert more[0].chunk_id == 3 and {r["mode"] for r in more} == {"symbol+hybrid"}
    lex = hybrid.search(rows, asked(spark, ("alpha beta", None)), Config(), {"content_type": "code"}, 3, mode="lexical").orderBy("pos").collect()
    assert [r.chunk_id for r in lex][0] == 2 and {r["mode"] for r in lex} == {"lexical"}


def test_reranker(spark):
    rows = chunks(spark, ROWS)
    queries = asked(spark, ("alpha words", [1.0, 0.0]))
    step = services.reranker(lambda q, texts: [len(t) for t in texts], queries)
    out = hybrid.search(rows, queries, Config(), limit=3, rerank=step).orderBy("pos").collect()
    assert out[0].content == max((r.content for r in out), key=len)
    none = services.reranker(lambda q, texts: None, queries)
    kept = hybrid.search(rows, queries, Config(), limit=3, rerank=none).orderBy("pos").collect()
    assert kept[0].chunk_id == 1


def test_filters(spark):
    rows = chunks(spark, ROWS)
    assert rows.where(filters.condition({})).count() == len(ROWS)
    assert rows.where(filters.condition({"content_type": "code", "doc_path": "a.ts", "language": None})).count() == 2
    for bad in ({"nope": "x"}, {"doc_path; DROP": "x"}):
        with pytest.raises(ValueError):
            filters.condition(bad)
    assert filters.merged({"content_type": "code"}, "markdown") == {"content_type": "markdown"}
    assert filters.post_filter(rows, {"source": "", "absent": ""}).count() == len(ROWS)
    assert rows.where(filters.content_types("docs")).count() == 1 and rows.where(filters.content_types("all")).count() == len(ROWS)


def test_config():
    assert Config().limit(0) == 10 and Config().limit(99) == 50 and Config().limit(3) == 3
    with pytest.raises(ValueError):
        Config().limit(-1)
    with pytest.raises(ValueError):
        Config(semantic_weight=0.7)
    assert read_env_file("# c\nA=1\nB = 'x y'\nbad\n") == {"A": "1", "B": "x y"}
    assert load({"k1": 2.0}, {"DEFAULT_LIMIT": "7"}, "DEFAULT_LIMIT=9\nHYBRID_ENABLED=false") == Config(k1=2.0, default_limit=7, hybrid_enabled=False)


def test_render(spark):
    rows = spark.createDataFrame([("a.ts", 3, 9, "run", 0.51239), ("b.md", None, None, "", 1.0)], "source string, start_line int, end_line int, symbol_name string, score double")
    assert [r.line for r in hybrid.render(rows).collect()] == ["── a.ts:3-9 (run)  [0.5124]", "── b.md  [1.0000]"]


def test_parts_are_held_a_few_at_a_time():
    from quarry.operators import chunks

    before = pa.total_allocated_bytes()
    text, seen = "x" * 99 + "\n", []

    def rows():
        for i in range(400):
            seen.append(pa.total_allocated_bytes() - before)
            yield [] if i % 7 == 3 else chunks.cut(text * 500, 750, 200)

    out = chunks.listed(rows())
    # What was cut is in Arrow long before the last row comes.
    assert seen[200] > 5_000_000
    one = chunks.cut(text * 500, 750, 200)
    assert len(out) == 400 and out[3].as_py() == [] and [tuple(x.values()) for x in out[399].as_py()] == one


def test_near_rows_of_small_blocks_are_those_of_all():
    r = np.random.default_rng(3)
    v, q = np.round(r.standard_normal((700, 4)), 1), np.round(r.standard_normal((60, 4)), 1)
    d = 1 - v @ q.T  # with ties
    kept, least = None, np.full(60, np.inf)
    for a in [0, 5, *range(10, 700, 10)]:
        kept = vector._taken(kept, least, d[a : a + (5 if a < 10 else 10)], np.arange(a, a + (5 if a < 10 else 10)), 7)
    want = [i for j in range(60) for i in np.lexsort((np.arange(700), np.floor(d[:, j] * 1e9 + 0.5)))[:7]]
    assert kept[1].tolist() == want and np.isfinite(least).all()


def test_a_task_holds_a_bounded_number_of_distances():
    assert vector.CELLS * 8 <= 16_000_000 and vector.CELLS >= vector.BLOCK_QUERIES
