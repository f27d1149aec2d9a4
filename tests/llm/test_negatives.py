"""Hard negatives against all pairs."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import negatives, queries

SF = "/root/testdata/sf0.001"
KIND = "vec_id long, label int, embedding array<float>, pivot string, score int"


def brute(rows, scale=256, anchor=lambda i: i % 10 == 0, k=5, m=10):
    used = [(i, lab, [math.floor(scale * c) for c in v]) for i, lab, v, *_ in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))  # noqa: E731  short vectors are filled with zeros
    out = []
    for n, (i, lab, v) in enumerate(used):
        if not anchor(i):
            continue
        scored = [(-dot(v, w), j, other) for q, (j, other, w) in enumerate(used) if q != n]
        for ps, pid, _ in sorted(x for x in scored if x[2] == lab)[:k]:
            hard = sorted(x for x in scored if x[2] != lab and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:m]
            out += [(i, pid, rank, nid, -ps, -ns) for rank, (ns, nid, _) in enumerate(hard, 1)]
    return sorted(out)


def vectors(kind, n=300, width=6, seed=1):
    r = np.random.default_rng(seed)
    if kind == "sphere":
        x = r.normal(size=(n, width))
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "clusters":
        x = r.normal(size=(20, 12))
        x = (x / np.linalg.norm(x, axis=1)[:, None])[r.integers(20, size=n)] + 0.02 * r.normal(size=(n, 12))
        x /= np.linalg.norm(x, axis=1)[:, None]
    elif kind == "copies":
        x = np.where(r.random(n)[:, None] < 0.4, np.full(width, 0.25), r.normal(size=(n, width)))
    else:
        x = np.zeros((n, width))
    return [(i * 5, int(r.integers(4)), np.float32(v).tolist(), "clash", 1) for i, v in enumerate(x)]


def mined(spark, rows, **more):
    return sorted(map(tuple, negatives.mine(spark.createDataFrame(rows, KIND), F.col("vec_id") % 10 == 0, **more).collect()))


@pytest.mark.parametrize("kind", ["sphere", "clusters", "copies", "zeros"])
def test_negatives_against_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(negatives, "FIRST", 20)  # several rounds
    rows = vectors(kind)
    assert mined(spark, rows, block=100) == brute(rows)


def test_rounds_leave_keys_out(spark, monkeypatch):
    """In clustered data the first rounds' annuli certify most anchors: the scans see few of the rows."""
    monkeypatch.setattr(negatives, "FIRST", 50)
    rows = vectors("clusters", 2000)
    index = negatives.build(negatives.usable(spark.createDataFrame(rows, KIND), "vec_id", "label", "embedding", F.col("vec_id") % 500 == 0))
    kept = index.rows.orderBy("pivot", "dist").toArrow()
    a = next(i for i, x in enumerate(kept["anchor"].to_pylist()) if x)
    v = np.array([kept["v"][a].as_py()])
    one = negatives.distances(np.hstack([v, [[0.0]]]), index.pivots)
    seen = []
    plain = negatives.scan

    def counted(index, block, *rest):
        gap = np.abs(np.asarray(kept["dist"]) - block.to_pivot[0][np.asarray(kept["pivot"])])
        seen.append(int(((gap > block.after[0]) & (gap <= block.upto[0])).sum()))
        return plain(index, block, *rest)

    monkeypatch.setattr(negatives, "scan", counted)
    wide = np.full((1, 1), 2.0**51)
    block = negatives.Block(np.asarray(kept["rid"])[[a]], np.asarray(kept["label"])[[a]], v, one, -wide, wide, -wide, np.zeros(1), np.zeros(1))
    got = negatives.search(index, block, True, 5).orderBy("rank").collect()
    assert 1 < len(seen) and sum(seen) < 1000
    label, own = kept["label"][a].as_py(), kept["rid"][a].as_py()
    want = sorted((-int(np.dot(v[0], w)), i) for i, r, x, w in zip(kept["id"].to_pylist(), kept["rid"].to_pylist(), kept["label"].to_pylist(), kept["v"].to_pylist(), strict=True) if x == label and r != own)
    assert [(-r.score, r.id) for r in got] == want[:5]


def test_odd_rows(spark):
    r = random.Random(4)
    v = lambda n=4: [r.uniform(-1, 1) for _ in range(n)]
    rows = [(i, i % 3, v(), "", 0) for i in range(60)]
    rows += [(None, 1, v(), "", 0), (100, None, v(), "", 0), (110, 1, None, "", 0), (120, 1, [0.5, None, 0.1, 0.2], "", 0), (130, 1, [math.nan] * 4, "", 0), (140, 1, [math.inf, 0, 0, 0], "", 0)]
    rows += [(150, 2, v(2), "", 0), (160, 0, [], "", 0), (170, 9, v(), "", 0), *rows[:11], (10, 2, v(), "", 0), (200, 1, [300.0, -200.0, 0.0, 4.0], "", 0)]
    rows = [(i, lab, None if x is None else [None if c is None else float(np.float32(c)) for c in x], *rest) for i, lab, x, *rest in rows]
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100
    assert mined(spark, []) == []
    assert mined(spark, [(10, 1, [0.5, 0.5], "", 0)]) == []
    assert mined(spark, [(10, 1, [0.5, 0.5], "", 0), (20, 1, [0.5, 0.5], "", 0)]) == []


def test_query_equals_sql(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
        got = queries.QUERIES["op12_hard_negatives"](spark, sf)
        want = con.execute(queries.ORACLES["op12_hard_negatives"])
        assert [d[0] for d in want.description] == got.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
