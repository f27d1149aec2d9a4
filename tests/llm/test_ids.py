"""Different texts under one id: every operator that filters judges each by its own text."""

import random

from quarry.llm import decontam, lines, neardup, substrings, work

WORDS = [f"w{i}" for i in range(5000)]


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


A, B, C, D = (words(k, 120) for k in range(4))
KIND = "doc_id long, text string, uid string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], KIND)


def test_near_copies_lose_no_text(spark):
    rows = [(3, A), (5, A), (5, B), (7, C), (7, B + " more"), (9, D), (9, D), (None, A), (None, B), (11, None), (11, "")]
    df = frame(spark, rows)
    kept = neardup.accept(df)
    assert kept.columns == df.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == 7 and {(None, A), (None, B), (7, C), (9, D)} <= set(got)
    assert sum(t == A for i, t in got if i is not None) == 1
    assert sum((t or "x").startswith(B) for i, t in got if i is not None) == 1
    assert sum(not t for _, t in got) == 1
    classes = sorted(((r.doc_id, r.class_id, r.copies) for r in neardup.classify(df).collect()), key=str)
    want = [(3, 3, 3), (5, 3, 3), (5, 5, 2), (7, 5, 1), (7, 7, 1), (9, 9, 2), (9, 9, 2), (11, 11, 2), (11, 11, 2), (None, None, 3), (None, None, 2)]
    assert [c[:2] for c in classes] == sorted([w[:2] for w in want], key=str)


def test_every_class_keeps_one_row(spark):
    """Many texts on few ids: of each group of copies one row stays, none is lost."""
    r = random.Random(8)
    bases = [words(100 + k, 90) for k in range(12)]
    rows = [(r.randrange(9), b if r.random() < 0.5 else b + " " + r.choice(WORDS)) for b in bases for _ in range(4)]
    got = [x.text for x in neardup.accept(frame(spark, rows)).collect()]
    assert sorted(next(k for k, b in enumerate(bases) if t.startswith(b)) for t in got) == list(range(12))


def test_leaks_take_only_their_own_rows(spark):
    leak = words(50, 40)
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(2, A + " " + leak), (2, "a b c d e f"), (4, B), (None, leak), (None, C), (6, None)]
    got = sorted(((x.doc_id, x.text) for x in decontam.accept(frame(spark, rows), bench).collect()), key=str)
    assert got == sorted([(2, "a b c d e f"), (4, B), (None, C), (6, None)], key=str)


def test_spans_belong_to_their_text(spark):
    rows = [(1, A), (2, A + " " + words(60, 30)), (2, "a b c"), (2, words(61, 50)), (3, words(62, 10) + " " + A), (None, A)]
    df = frame(spark, rows)
    removed = substrings.removals(df)
    # Of texts that share an id one may come before id 1 in order; one occurrence of A stays in any case.
    got = {(x.row.doc_id, x.row.text): x.kept for x in substrings.cut(df, removed).collect()}
    assert set(got) == set(rows)
    for key in ((2, "a b c"), (2, words(61, 50)), (None, A)):
        assert got[key] == key[1]
    whole = [(1, A), (2, rows[1][1]), (3, rows[4][1])]
    assert sum(A in got[k] for k in whole) == 1
    for k in whole:
        rest = [w for w in k[1].replace(A, "").split()]
        assert all(w in got[k].split() for w in rest)
    assert {x.doc_id for x in removed.collect()} <= {1, 2, 3} and all(set(x.kept_in) <= {1, 2, 3} for x in removed.collect())


def test_lines_belong_to_their_text(spark):
    rows = [(1, "common\nown"), (1, "other\ncommon\nthird"), *[(k, "common") for k in range(2, 12)]]
    got = {(x.row.doc_id, x.row.text): x.kept for x in lines.dedup(frame(spark, rows)).collect()}
    assert got[1, "common\nown"] == "own" and got[1, "other\ncommon\nthird"] == "other\nthird"


def test_identified(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (2, "a"), (2, "b"), (None, "a"), (None, None)])
    for nulls, n in ((False, 3), (True, 5)):
        known = work.identified(df, "text", "doc_id", nulls)
        uids = {(r.id, r.text): r.uid for r in known.rows.collect()}
        assert len({u for u in uids.values() if u is not None}) == n and uids[1, "a"] == 1
        assert known.names is not None and all(r.uid < -(1 << 61) for r in known.names.where("uid IS NOT NULL").collect())
    assert work.identified(df.where("doc_id = 1"), "text", "doc_id", True).names is None
