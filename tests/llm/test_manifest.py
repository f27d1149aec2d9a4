"""The Merkle manifest against a plain recursive tree."""

import hashlib
import random
import zlib

import duckdb
import pytest

from quarry.llm import merkle, queries

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, source string, lang string, n_chars long, text string, leaf string, path int"


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def climb(nodes, fanout):
    """The root, and for each node its [(left, right)] from below."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, here in enumerate(at):
            run, mine = runs[here // fanout], here % fanout
            paths[k].append(("".join(run[:mine]), "".join(run[mine + 1 :])))
            at[k] = here // fanout
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows, fanout=16):
    by_source = {}
    for r in rows:
        hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        now = leaf((*r[:4], lowered(r[4]))) if hit else leaf(r[:5])
        by_source.setdefault(r[1], []).append(((r[0] is not None, r[0] or 0), leaf(r[:5]), now, r[0]))
    keys = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[1] for x in sorted(by_source[s])], fanout) for s in keys]
    if not keys:
        return []
    root, tops = climb([t[0] for t in trees], fanout)
    out = []
    for s, (subroot, paths), top in zip(keys, trees, tops, strict=True):
        for (_, own, now, doc_id), path in zip(sorted(by_source[s]), paths, strict=True):
            for a, b in path + top:
                now = h(a + now + b)
            out.append((doc_id, own, subroot, root, h("".join(a + b for a, b in path + top)), now, now == root))
    return out


def rows(n, sources, seed=3):
    r = random.Random(seed)
    made = []
    for i in range(n):
        s = sources[min(r.randrange(2 * len(sources)), len(sources) - 1)]
        made.append((i if r.random() > 0.02 else None, s, r.choice(["en", "dé", None]), r.choice([None, -4, 70]), r.choice([None, "", "Äbc Ü", "ABC %d" % i, "lower"]), "clash", 1))
    return made


@pytest.mark.parametrize(("n", "fanout", "depth"), [(0, 16, 2), (1, 16, 2), (700, 16, 2), (150, 2, 2), (90, 3, 1), (64, 4, 3)])
def test_manifest_against_a_plain_tree(spark, n, fanout, depth):
    made = rows(n, [None, "", "a", "B", "é", "zz"])
    made += made[:3]  # repeated rows
    made += [(5, "zz", "en", 1, "another text of this id", "clash", 1)] if n else []
    got = merkle.manifest(spark.createDataFrame(made, KIND), fanout=fanout, depth=depth).drop("source")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute(made, fanout), key=str)


def test_many_sources_and_one_hot_source(spark):
    made = [(i, "hot" if i % 3 == 0 else f"s{i}", "en", 3, "X" * (i % 50), "", 0) for i in range(900)] + [(7000, "one", None, None, "T" * 2_000_000, "", 0)]
    got = sorted(map(tuple, merkle.manifest(spark.createDataFrame(made, KIND)).drop("source").collect()))
    assert got == sorted(brute(made))
    assert 0 < sum(not x[-1] for x in got) < len(got) / 4


def test_any_change_is_seen(spark):
    made = rows(60, ["a", "b"])
    roots = set()
    for k in range(3):
        changed = [(*r[:4], (r[4] or "") + "!" * (k == 1 and i == 40), *r[5:]) if k < 2 else r for i, r in enumerate(made)]
        roots |= {r.root for r in merkle.manifest(spark.createDataFrame(changed if k < 2 else made[:-1], KIND)).select("root").distinct().collect()}
    assert len(roots) == 3


def test_manifest_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES["op11_merkle_manifest"](spark, SF)
    found = con.execute(queries.ORACLES["op11_merkle_manifest"])
    assert [d[0] for d in found.description] == got.columns
    got = sorted(map(tuple, got.collect()))
    assert got == sorted(found.fetchall())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert got == sorted(brute(list(map(tuple, docs))))
