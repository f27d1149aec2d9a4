"""Near-dedup, line dedup and substring dedup against brute force."""

import hashlib
import random

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.llm import allpairs, components, lines, neardup, queries, ragged, substrings, weights, work

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, t, n):
    w = t.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
    return " ".join(w)


def corpus():
    """Exact copies, chains of near copies, short, empty and null texts."""
    r = random.Random(4)
    out = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = text(r, r.randrange(60, 400))
        out += [base, base.upper(), base + " tail"]
        now = base
        for _ in range(4):
            now = edited(r, now, max(1, len(now.split()) // 60))
            out.append(now)
        out.append(edited(r, base, len(base.split()) // 8))
    out += [text(r, 120) for _ in range(30)]
    return out


def docs(spark, texts):
    return spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, class_id long")


def classes(texts, idf):
    """Components of all pairs with a weighted similarity of 0.8 or more, of texts with equal words too."""
    h, offsets = ragged.hashed(pa.array(texts, pa.large_string()))
    s, starts, w = neardup.elements(h, offsets, idf)
    sets = [dict(zip(s[a:b].tolist(), w[a:b].tolist(), strict=True)) for a, b in zip(starts[:-1], starts[1:], strict=True)]
    label = list(range(len(texts)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = sum(v for k, v in sets[i].items() if k in sets[j])
            total = sum(sets[i].values()) + sum(sets[j].values()) - both
            if (both / total if total else 1.0) >= neardup.THRESHOLD:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


def test_near_copies_against_all_pairs(spark):
    texts = corpus()
    df = docs(spark, texts)
    idf = np.sqrt(weights.idf(*weights.frequencies(df)))
    got = {r.doc_id: r.class_id for r in neardup.classify(df).collect()}
    want = classes(texts, idf)
    assert got == want
    kept = neardup.accept(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values())


def test_near_copies_odd_inputs(spark):
    assert neardup.classify(docs(spark, [])).count() == 0
    assert neardup.accept(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (5, None), (6, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.class_id) for r in neardup.classify(df).collect()), key=str) == [(3, 3), (3, 3), (5, 5), (6, 5), (None, None), (None, None)]
    assert sorted((r.doc_id for r in neardup.accept(df).collect()), key=str) == [3, 5, None, None]


def test_long_text_and_large_group(spark):
    r = random.Random(9)
    base = text(r, 30_000)
    texts = [base, edited(r, base, 50)] + [edited(r, "x " + " ".join(base.split()[:300]), 2) for _ in range(150)]
    got = {x.doc_id: x.class_id for x in neardup.classify(docs(spark, texts)).collect()}
    assert got[0] == got[1] == 0 and {got[i] for i in range(2, 152)} == {2}


def test_rounds_go_on_behind_many_pairs_that_are_no_links(spark):
    r = random.Random(21)
    base = [f"b{k}" for k in range(300)]
    texts = []
    for i in range(240):
        w = list(base)
        for k in r.sample(range(5, 295), 4 + i % 3):
            w[k] = f"e{i}x{k}"
        texts.append(" ".join(w))
    df = docs(spark, texts)
    idf = np.sqrt(weights.idf(*weights.frequencies(df)))
    assert {x.doc_id: x.class_id for x in neardup.classify(df).collect()} == classes(texts, idf)


def test_blocks_of_a_bucket_against_all_pairs(spark, monkeypatch):
    """Small blocks, by rows and by bytes, find what one block finds."""
    r = random.Random(22)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for i in range(150):
        w = list(base)
        for k in r.sample(range(5, 195), 2 + i % 4):
            w[k] = f"e{i}x{k}"
        texts.append(" ".join(w))
    df = docs(spark, texts)
    want = classes(texts, np.sqrt(weights.idf(*weights.frequencies(df))))
    assert 3 < len(set(want.values())) < 140
    for rows, size in ((16, 8_000_000), (2048, 9_000)):
        monkeypatch.setattr(neardup, "BLOCK_ROWS", rows)
        monkeypatch.setattr(neardup, "BLOCK_BYTES", size)
        assert {x.doc_id: x.class_id for x in neardup.classify(df).collect()} == want


def test_similarities_of_blocks():
    r = np.random.default_rng(3)
    weight = r.random(5000).astype(np.float32) + 0.5
    sets = [np.unique(r.integers(5000, size=n)) for n in (0, 1, 40, 3000, 4500, 40, 0)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    s = np.concatenate(sets)
    for left, right in (([0, 2, 4], [1, 3, 6]), (list(range(7)), list(range(7)))):
        got = allpairs.similarities(s.astype(np.uint64), weight[s], starts, np.array(left), np.array(right))
        for x, i in enumerate(left):
            for y, j in enumerate(right):
                both, either = np.intersect1d(sets[i], sets[j]), np.union1d(sets[i], sets[j])
                # Elements of one row only are left out of the columns, but not of its weight.
                want = 1.0 if not len(either) else float(weight[both].sum() / weight[either].sum())
                assert i == j or abs(got[x, y] - want) < 1e-5


def test_joining_links_make_a_forest():
    hits = np.ones((3, 3), dtype=bool)
    assert len(allpairs.joining(hits, np.array([1, 2, 3]), np.array([1, 2, 3]))) == 2
    assert allpairs.joining(~hits, np.array([1, 2, 3]), np.array([1, 2, 3])) == []


def test_sketch_estimates_similarity():
    r = random.Random(1)
    a = text(r, 3000)
    b = edited(r, a, 60)
    idf = np.ones(weights.BUCKETS, dtype=np.float32)
    s, starts, w = neardup.elements(*ragged.hashed(pa.array([a, b])), idf)
    sets = [set(s[x:y].tolist()) for x, y in zip(starts[:-1], starts[1:], strict=True)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    k = neardup.sketches(s, starts, w)
    assert abs((k[0] == k[1]).mean() - exact) < 0.25


def test_hashes_of_words():
    texts = ["a bb a", "", None, " x\ty\n\x0bx ", "É é", "a bb a"]
    h, o = ragged.hashed(pa.array(texts, pa.large_string()))
    words = [(t or "").lower().split() for t in texts]
    assert np.diff(o).tolist() == [len(w) for w in words]
    flat = [x for w in words for x in w]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))
    codes, o2, distinct = ragged.words(pa.array(texts, pa.large_string()))
    assert o2.tolist() == o.tolist() and [distinct[c] for c in codes] == flat


def test_document_frequencies(spark):
    n, df = weights.frequencies(spark.createDataFrame([(t,) for t in ["a b a", "b", None, ""]], "text string"))
    h, _ = ragged.hashed(pa.array(["a b"]))
    assert n == 4 and df[weights.bucket(h)].tolist() == [1, 2] and df.sum() == 3


def test_components(spark):
    r = random.Random(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(150)] + [(500, 500)]
    label = {x: x for p in pairs for x in p}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        label[max(x, y)] = min(x, y)
    got = {x.node: x.label for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in label if x != 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    r = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in r.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    edges, jobs, found = spark.createDataFrame(pairs, "a long, b long"), [], []
    for few in (components.FEW_EDGES, 0):
        monkeypatch.setattr(components, "FEW_EDGES", few)
        spark.sparkContext.setJobGroup(f"components-{few}", "")
        found.append(sorted((x.node, x.label) for x in components.components(edges).collect()))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{few}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found[0] == found[1] and jobs[0] < 10 < jobs[1]


# ---- lines


def line_key(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\f\r"))


def brute_lines(texts, least, length=1):
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for ls in split for k in {line_key(x) for x in ls} if len(k) >= length)
    return [(len(ls), sum(n[line_key(x)] >= least and len(line_key(x)) >= length for x in ls), "\n".join(x for x in ls if not (n[line_key(x)] >= least and len(line_key(x)) >= length))) for ls in split]


def test_lines_in_batches(spark):
    r = random.Random(5)
    pool = ["Common line", " common LINE ", "É line", "é line", "", " ", "rare one", "x" * 4000]
    texts = [None, ""] + ["\n".join(r.choice(pool + [text(r, 3)]) for _ in range(r.randrange(1, 9))) for _ in range(80)]
    df = spark.createDataFrame([(i if i % 9 else None, t, "clash") for i, t in enumerate(texts)] + [(1, texts[7], "clash")], "doc_id long, text string, kept string")
    want = brute_lines([*texts, texts[7]], 6)
    for n in (1, 7):
        batches = [df.where(F.pmod(F.xxhash64("text", "doc_id"), F.lit(n)) == k) for k in range(n)]
        got = lines.dedup(df, batches, min_docs=6).collect()
        assert sorted((x.n_lines, x.n_dropped, x.kept) for x in got) == sorted(want)
    got = lines.dedup(df, None, min_docs=6, min_length=8).collect()
    assert sorted((x.n_lines, x.n_dropped, x.kept) for x in got) == sorted(brute_lines([*texts, texts[7]], 6, 8))
    assert lines.dedup(df.limit(0)).count() == 0


def test_runs_are_sorted_and_compacted(spark):
    runs = lines.LineRuns(spark, work.new_path(spark, "runs-test"), min_docs=2, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(f"a{k}\nshared\nb{k // 2}",)], "text string"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert runs.frequent().count() == 3
    # A key that is known to be frequent is left out of later runs.
    assert sum(spark.read.parquet(p).count() for p in runs.levels[0]) == 2


def test_batches_of_a_filtered_table(spark, tmp_path):
    """Rows that a filter takes away are not counted: 5 rows share a line of which the files hold 20."""
    spark.createDataFrame([(i, "shared\nown %d" % i) for i in range(20)], "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for some, n in ((df.where("doc_id % 4 = 0"), 0), (df, 1)):
        batches = lines.file_batches(some, 4)
        assert sum(b.count() for b in batches) == some.count()
        assert {x.n_dropped for x in lines.dedup(some, batches).collect()} == {n}
    changed = df.withColumn("text", F.concat("text", F.lit("\nadded")))
    assert {x.n_dropped for x in lines.dedup(changed, lines.file_batches(changed, 4)).collect()} == {2}


def test_line_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = sorted(map(tuple, queries.QUERIES["op4_line_dedup"](spark, SF).collect()))
    assert got == sorted(con.execute(queries.ORACLES["op4_line_dedup"]).fetchall())
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(x[3] for x in got) == sorted(hashlib.sha256(k.encode()).hexdigest() for _, _, k in brute_lines(texts, 10))


# ---- substrings


def test_every_long_passage_is_found(spark):
    r = random.Random(8)
    unique = iter(range(10**7))
    own = lambda n: " ".join(f"u{next(unique)}" for _ in range(n))
    passages = [own(n) for n in (50, 51, 60, 90, 200)]
    texts = [own(r.randrange(0, 80)) + " " + p + "\n" + own(r.randrange(0, 80)) for p in passages for _ in range(3)] + [own(120) for _ in range(10)] + [None, "", "a b", passages[0]]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, passages[0], "x")], "doc_id long, text string, spans string")
    removed = substrings.removals(df)
    got = {x.doc_id: x for x in removed.collect()}
    assert set(got) == {i for i in range(15) if i % 3} | {28}
    for i, x in got.items():
        assert x.kept_in == [i // 3 * 3 if i < 15 else 0]
        words = texts[i].split()
        mine = [w for a, b in x.spans for w in words[a:b]]
        assert len(mine) == x.n_removed >= substrings.LENGTH
        # Paragraphs of 0.8 or more may reach a word or two beyond the passage.
        assert sum(w not in passages[i // 3 if i < 15 else 0].split() for w in mine) <= 4
    kept = {x.doc_id: (x.text, x.kept) for x in substrings.cut(df, removed).select("row.doc_id", "row.text", "kept").collect() if x.doc_id is not None}
    for i, (t, k) in kept.items():
        assert k == t if i not in got else len((t or "").split()) - len(k.split()) == got[i].n_removed


def test_near_paragraphs_are_clustered(spark):
    r = random.Random(2)
    base = [f"p{r.randrange(10**6)}" for _ in range(24)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"q{i}" for i in range(40))]
    got = {x.doc_id: x.kept_in for x in substrings.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got in ({1: [0]}, {1: [0], 0: [0]})


def test_whole_passages_are_removed(spark):
    r = random.Random(18)
    unique = iter(range(10**7))
    own = lambda n: " ".join(f"u{next(unique)}" for _ in range(n))
    sizes = (50, 55, 60, 75, 120, 300)
    passages = [own(n) for n in sizes]
    texts = [own(r.randrange(30, 90)) + " " + p + " " + own(r.randrange(30, 90)) for p in passages for _ in range(2)]
    # The first text holds little of a passage that the two after it share.
    short, long = own(22), [own(50), own(50)]
    texts += [short] + [own(40) + " " + long[0] + " " + short + " " + long[1] + " " + own(40) for _ in range(2)]
    got = {x.doc_id: x.n_removed for x in substrings.removals(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {k: got.get(k) for k in range(12)} == {k: sizes[k // 2] if k % 2 else None for k in range(12)}
    assert got[14] == 122


def test_near_paragraphs_against_all_pairs_of_a_band(spark):
    """In one band A, the least class, is unrelated to B and C, which are near; other bands do not help."""
    n = substrings.LENGTH
    r = random.Random(31)
    base = [f"n{k}" for k in range(n)]
    texts = [" ".join(f"a{k}" for k in range(n))] + [" ".join([*base[: n - 1], f"end{k}"]) for k in range(2)]
    for _ in range(6):  # groups with a changed word near either end, and inside
        g = [f"g{r.randrange(10**6)}" for _ in range(n)]
        for k in (0, 1, n - 1, n - 2, n // 2):
            texts.append(" ".join([*g[:k], f"x{r.randrange(10**6)}", *g[k + 1 :]]))
    h, offsets = ragged.hashed(pa.array(texts))
    ph, _ = substrings.keys(h, offsets[:-1])
    order = np.argsort(ph)  # ids: the text of the least class first
    paras = spark.createDataFrame([(k, 0, int(ph[i]), [7], [k]) for k, i in enumerate(order)], "doc_id long, pos int, ph long, bands array<long>, homes array<int>")
    df = spark.createDataFrame([(k, texts[i]) for k, i in enumerate(order)], "doc_id long, text string")
    seen = paras.select("ph", F.struct("doc_id", "pos").alias("first"))
    got = {x.node: x.label for x in components.components(substrings.near_links(df, paras, seen, "text", "doc_id")).collect()}
    sets = [set(substrings.grams(h)[a : a + n - substrings.WIDTH + 1].tolist()) for a in offsets[:-1]]
    linked = [(x, y) for x in range(len(texts)) for y in range(x) if len(sets[x] & sets[y]) >= substrings.THRESHOLD * len(sets[x] | sets[y])]
    assert len(linked) > 6 and (2, 1) in linked
    assert all(got.get(int(ph[x])) == got.get(int(ph[y])) is not None for x, y in linked)
    assert set(got) == {int(ph[x]) for p in linked for x in p}


def test_anchor_guarantee():
    r = random.Random(6)
    shared = [f"s{r.randrange(10**6)}" for _ in range(substrings.LENGTH + substrings.SPREAD)]
    seen = []
    for _ in range(40):
        head, tail = [f"u{r.random()}" for _ in range(r.randrange(60))], [f"v{r.random()}" for _ in range(r.randrange(60))]
        h, o = ragged.hashed(pa.array([" ".join(head + shared + tail)]))
        at, _ = substrings.anchors(h, o)
        ph, _ = substrings.keys(h, at)
        inside = (at >= len(head)) & (at + substrings.LENGTH <= len(head) + len(shared))
        seen.append(set(ph[inside].tolist()))
    assert set.intersection(*seen)


def test_substrings_of_odd_inputs(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.removals(empty).count() == 0
    t = " ".join(f"a{i}" for i in range(60))
    twice = spark.createDataFrame([(1, t), (1, t), (2, t + "\n" + t)], "doc_id long, text string")
    got = {x.doc_id: x.n_removed for x in substrings.removals(twice).collect()}
    assert set(got) == {2} and got[2] > 60


def test_pieces_cover_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 9_000_000, 3)] + [None]})
    parts = list(ragged.pieces(batch))
    assert sum(p.num_rows for p in parts) == 5 and max(p.num_rows for p in parts) < 5
