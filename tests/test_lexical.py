import math

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import lexical

CORPUS = [
    ("1", "export async function getUserById(id: string) { return db.users.find(id); }"),
    ("2", "class UserService { constructor(private repo: UserRepository) {} }"),
    ("3", "// rate limit the requests per minute"),
    ("4", "export const handleAuth = async (req) => verifyToken(req)"),
]


def index(spark, rows=CORPUS):
    return lexical.build(spark.createDataFrame(rows, "chunk_id string, text string"))


def found(spark, ix, query, top=10, normalized=True):
    queries = spark.createDataFrame([(0, query)], "qid long, query string")
    return [(r.chunk_id, r.score) for r in lexical.search(ix, queries, top, normalized).orderBy("rank").collect()]


def tokens(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(T.tokens(F.col("t")).alias("x")).first().x


def test_tokens(spark):
    assert tokens(spark, "The getUserById is a rate_limiter") == ["getuserbyid", "get", "user", "id", "rate_limiter", "rate", "limiter"]
    assert tokens(spark, "XMLParser HTTP _private get_the") == ["xmlparser", "xml", "parser", "http", "_private", "get_the"]
    assert tokens(spark, "") == [] and tokens(spark, None) == []
    assert tokens(spark, "caché über") == ["cach", "ber"]


def test_expansion(spark):
    out = spark.createDataFrame([("rate_limiter XMLParser getUser plain",)], "q string").select(T.expand_identifiers(F.col("q")).alias("x")).first().x
    assert out == "rate_limiter rate limiter XMLParser xml parser getUser get user plain"


def test_ranking(spark):
    ix = index(spark)
    assert found(spark, ix, "user service")[0][0] == "2"
    hits = found(spark, ix, "export async")
    assert {i for i, _ in hits} == {"1", "4"} and hits[0][1] == 1.0 and hits[0][1] >= hits[1][1]
    assert len(found(spark, ix, "export async", 1)) == 1
    assert found(spark, ix, "the and of") == [] and found(spark, ix, "zzz") == []


def test_score_by_hand(spark):
    rows = [("a", "alpha alpha beta"), ("b", "beta gamma"), ("c", "gamma gamma gamma"), ("d", "delta")]
    n, avgdl = 4, (3 + 2 + 3 + 1) / 4
    idf = lambda df: math.log((n - df + 0.5) / (df + 0.5) + 1)
    top = idf(1)
    # alpha: one document, so its information is 1; beta: uniform frequencies, so 1 - df / n
    parts = []
    for tf, df, info in ((2, 1, 1.0), (1, 2, 0.5)):
        saturated = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 3 / avgdl))
        share = idf(df) / top
        parts.append((idf(df) * (1 + 0.5 * share * info) * saturated, share * info))
    score = sum(x for x, _ in parts) + sum(math.tanh(x) for x, _ in parts) / 3 * sum(y for _, y in parts)
    got = dict(found(spark, index(spark, rows), "alpha beta zzz", normalized=False))
    assert abs(got["a"] - score) < 1e-9


def test_update_and_delete_equal_a_rebuild(spark):
    ix = index(spark)
    fifth = spark.createDataFrame([("5", "telemetry event tracking middleware")], "chunk_id string, text string")
    more = lexical.updated(ix, fifth)
    assert [i for i, _ in found(spark, more, "telemetry")] == ["5"]
    less = lexical.without(more, spark.createDataFrame([("1",)], "chunk_id string"))
    same = index(spark, [*CORPUS[1:], ("5", "telemetry event tracking middleware")])
    for q in ("user", "export telemetry", "rate limit"):
        assert [(i, round(s, 9)) for i, s in found(spark, less, q, normalized=False)] == [(i, round(s, 9)) for i, s in found(spark, same, q, normalized=False)]
    assert lexical.statistics(less).first() == lexical.statistics(same).first()


def test_written_index(spark, tmp_path):
    ix = index(spark)
    assert found(spark, ix.write(str(tmp_path / "ix")), "user export") == found(spark, ix, "user export")


def test_empty_corpus(spark):
    ix = index(spark, [])
    assert found(spark, ix, "user") == []
    row = lexical.statistics(ix).first()
    assert row.n_docs == 0 and row.beta == 0.01 and row.idf_max == 1.0


def test_sigmoid_as_written(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (7.9,), (8.0,), (-8.0,)], "x double").select(T.fast_sigmoid(F.col("x")).alias("y")).collect()
    assert [round(r.y, 4) for r in rows] == [0.25, 0.3115, round((7.9**3 + 6 * 7.9 + 12) / (7.9**3 + 12 * 7.9 + 48), 4), 1.0, 0.0]


def test_counts_inside_tasks_equal_the_native_tokens(spark):
    odd = ["The getUserById is a rate_limiter", "XMLParser HTTP _private get_the a__b ___ _ the_of aB ABc ABCd x1Y IsA isThe THEFoo", "caché über", "", None, "ab " * 5000 + "cd"]
    rows = spark.createDataFrame(list(enumerate(odd)), "chunk_id long, text string")
    want = {r.chunk_id: sorted(r.t) for r in rows.select("chunk_id", T.tokens(F.col("text")).alias("t")).collect()}
    got = {r.chunk_id: r for r in lexical.forward(rows).collect()}
    assert {i: sorted(t.term for t in r.terms for _ in range(t.tf)) for i, r in got.items()} == want
    assert {i: r.dl for i, r in got.items()} == {i: len(t) for i, t in want.items()}


def test_a_build_makes_no_row_a_word(spark):
    ix = index(spark)
    plan = ix.kept._jdf.queryExecution().optimizedPlan().toString() + lexical.forward(spark.createDataFrame(CORPUS, "chunk_id string, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan


def test_rows_of_one_id_are_one_chunk(spark):
    ix = index(spark, [("a", "alpha beta"), ("b", "alpha"), ("a", "alpha")])
    assert sorted(map(tuple, ix.postings.select("chunk_id", "term", "tf", "dl").collect())) == [("a", "alpha", 2, 3), ("a", "beta", 1, 3), ("b", "alpha", 1, 1)]
    assert sorted(map(tuple, ix.docs.collect())) == [("a", 3), ("a", 3), ("b", 1)]


def test_a_batch_scores_chunks_inside_tasks(spark, monkeypatch):
    """No row a query and chunk is made or shuffled; hits, ties at the cut and null ids equal those by postings."""
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(lexical, "CELLS", 20)
    monkeypatch.setattr(lexical, "BY_POSTINGS", 5)
    rows = [(None if i == 50 else i, " ".join(f"w{i * k % 23}" for k in range(1, 9)) if i % 4 else "alpha w1 beta w2") for i in range(120)]
    ix = lexical.build(spark.createDataFrame(rows, "chunk_id long, text string"))
    asked = spark.createDataFrame([(q, f"w{q} w{q + 1} w{q} alpha") for q in range(7)] + [(9, "zzz"), (None, "beta")], "qid long, query string")
    by_postings = lexical.Index(ix.postings, ix.docs, ix.terms, ix.corpus)
    show = lambda ix, top: sorted((str(r.qid), r["rank"], str(r.chunk_id), round(r.score, 9)) for r in lexical.search(ix, asked, top).collect())
    for top in (1, 6, 500):
        assert show(ix, top) == show(by_postings, top)
    assert "Generate" not in lexical.search(ix, asked, 6)._jdf.queryExecution().executedPlan().toString()
    ix.release()


def test_a_search_sums_up_all_terms_once(spark):
    rows = spark.createDataFrame([(k, " ".join(f"word{(k * j) % 37}" for j in range(1, 12))) for k in range(60)], "chunk_id long, text string")
    queries = spark.createDataFrame([(q, f"word{q} word{q + 5} word{q + 9}") for q in range(20)], "qid long, query string")
    index = lexical.build(rows)
    found = lexical.asked_weights(index, queries)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Only the sums of asked terms hold more than a count, and one aggregate meets every posting by term.
    assert plan.count("var_pop") == 1 and "LeftSemi" in plan
    lists = lexical.Index(index.postings, index.docs, index.terms, index.corpus)
    near = lambda df: sorted((r.qid, r.term, r.qtf, r.m, round(r.avgdl, 9), round(r.eidf, 9), round(r.extra, 9)) for r in df.collect())
    assert near(found) == near(lexical.asked_weights(lists, queries))
    index.release()
