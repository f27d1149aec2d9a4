"""Symbol names by grams and containment by sweeps, against plain loops."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import symbols
from quarry.plans import catalog

NAMES = ["getUser", "getuser", "GETUSER", "get_user", "getXuser", "a", "ab", "A_b", "aXb", "x.y", "_", "__", "user.getUser", "éa", "$id", "B", None, "ab", "abc"]


def like(q, name):
    return re.search("".join("." if c == "_" else re.escape(c) for c in q.lower()), name.lower(), re.S) is not None


def brute(names, queries, limit, exact_cap, fuzzy_cap):
    out = set()
    for qid, q in queries:
        q = q.strip()
        if not re.fullmatch(r"[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*", q):
            continue
        exact = sorted((1 if n == q else 2, i) for i, n in enumerate(names) if n is not None and n.lower() == q.lower())[: min(limit, exact_cap)]
        near = [i for i, n in enumerate(names) if n is not None and like(q, n)][: min(limit, fuzzy_cap)]
        tiers = {i: t for t, i in exact}
        found = sorted([(t, i) for i, t in tiers.items()] + [(3, i) for i in near if i not in tiers])[:limit]
        out |= {(qid, i, t, r) for r, (t, i) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("limit", "exact", "fuzzy"), [(10, 20, 10), (3, 2, 4), (50, 1, 50)])
def test_tiers_against_a_loop(spark, limit, exact, fuzzy, tmp_path):
    r = random.Random(5)
    names = NAMES * 2 + ["".join(r.choice("abAB_xg.$") for _ in range(r.randrange(1, 7))) for _ in range(60)]
    queries = list(enumerate(["getuser", "get_user", "a", "ab", "A_", "_", "__", "___b", " B ", "no such", "$", "x.y", "zzz", "a_b_c", "éa", "user.get_ser"]))
    chunks = spark.createDataFrame(list(enumerate(names)), "chunk_id long, symbol_name string")
    asked = spark.createDataFrame(queries, "qid int, query string")
    config = Config(symbol_exact_limit=exact, symbol_fuzzy_limit=fuzzy)
    want = brute(names, queries, limit, exact, fuzzy)
    got = symbols.search(chunks, asked, limit, config)
    assert {(x.qid, x.chunk_id, x.tier, x.rank) for x in got.collect()} == want
    written = symbols.name_index(chunks).write(str(tmp_path / "names"))
    assert {(x.qid, x.chunk_id, x.tier, x.rank) for x in symbols.search(chunks, asked, limit, config, index=written).collect()} == want


def test_no_query_meets_all_names(spark):
    plan = catalog.QUERIES["symbol_tiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "embedding" not in plan.split("Physical Plan")[1]


def definitions(r, n, names="ABC"):
    return [(1 + k % 3, r.choice(names), "def" if r.random() < 0.9 else "ref", a := r.randrange(1, 40), a + r.randrange(0, 25), k) for k in range(n)]


def enclosing(rows, dotted):
    *parents, target = dotted.split(".")
    out = []
    for row in rows:
        f, name, kind, line, end, _ = row
        if name != target or kind != "def":
            continue
        cur = (line, end, name)
        for parent in reversed(parents):
            held = sorted((b, e) for g, m, k, b, e, _ in rows if g == f and m == parent and k == "def" and b <= cur[0] and e >= cur[1] and (b, e, m) != cur)
            if not held:
                break
            cur = (*held[0], parent)
        else:
            out.append(row)
    return sorted(out)


@pytest.mark.parametrize("dotted", ["A", "B.A", "A.A", "A.B.C", "C.C.C", "zz.A"])
def test_containment_against_a_loop(spark, dotted):
    rows = definitions(random.Random(7), 160)
    df = spark.createDataFrame(rows, "file_id int, name string, kind string, line int, end_line int, column int")
    got = symbols.find(df, dotted, 20).collect()
    assert sorted(tuple(x)[:6] for x in got) == enclosing(rows, dotted)
    for f in {x.file_id for x in got}:
        order = [(abs(x.line - 20), x.line, x.column) for x in sorted((x for x in got if x.file_id == f), key=lambda x: x.rank)]
        assert order == sorted(order)


def test_innermost_against_a_loop():
    r = np.random.default_rng(3)
    for n, m in ((0, 5), (5, 0), (1, 9), (60, 200), (300, 300)):
        start = r.integers(0, 60, n)
        blocks = np.stack([start, start + r.integers(0, 30, n), r.permutation(n) + 1])
        first = r.integers(0, 60, m)
        spans = np.stack([first, first + r.integers(0, 12, m)])
        got = symbols.innermost(blocks, spans)
        for k in range(m):
            held = [(blocks[1, i] - blocks[0, i], blocks[2, i], i) for i in range(n) if blocks[0, i] <= spans[0, k] and blocks[1, i] >= spans[1, k]]
            assert got[k] == (min(held)[2] if held else -1)


def test_a_file_of_many_definitions(spark):
    """100,000 definitions of one file, nested and not: rows and time grow with them, not with their square."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("file_id"), F.when(F.col("id") % 2 == 0, "Outer").otherwise("run").alias("name"), F.lit("def").alias("kind"), F.col("id").cast("int").alias("line"), F.when(F.col("id") == 0, 2 * n).otherwise(F.col("id") + 3).cast("int").alias("end_line"), F.lit(0).alias("column"))
    start = time.perf_counter()
    assert symbols.find(rows, "Outer.run").count() == n // 2
    blocks = rows.select("file_id", F.col("line").alias("block"), F.col("line").alias("start"), F.col("end_line").alias("end"))
    anchors = rows.select("file_id", (F.col("line") + 1).alias("start"), (F.col("line") + 2).alias("end"), F.lit("k").alias("kind"), F.lit(1).alias("priority"))
    assert symbols.assign_anchors(blocks, anchors).count() == n - 1  # the first begins where its innermost block does
    assert time.perf_counter() - start < 60


def test_anchors_of_files_without_blocks(spark):
    blocks = spark.createDataFrame([(1, 5, 1, 9)], "file_id int, block int, start int, end int")
    anchors = spark.createDataFrame([(1, 1, 2, "a", 1), (1, 2, 3, "b", 1), (1, 2, 3, "c", 5), (2, 1, 2, "d", 1), (1, 8, 12, "e", 1)], "file_id int, start int, end int, kind string, priority int")
    assert [tuple(x) for x in symbols.assign_anchors(blocks, anchors).collect()] == [(1, 5, 2, 3, "c", 5, 1)]
