"""All named queries of the engine's own operators and their oracle SQL.

The test tables stand for the engine's model: documents are chunks (source is
their path), embeddings belong to documents by id, benchmark texts are queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.functions import paths
from quarry.functions import text as T
from quarry.operators import chunks as chunking
from quarry.operators import delta, filters, hybrid, lexical, symbols, vector
from quarry.sources import indexes, staging, store

from . import catalog_sources, sql  # noqa: F401  the other module fills the same registry
from .registry import ORACLES, QUERIES, query, table

# ---- the model over the test tables


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def symbol_name() -> Column:
    return F.concat(F.when(F.col("doc_id") % 2 == 0, "Sym").otherwise("sym"), F.col("doc_id") % 97)


def chunk_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("doc_id") == F.col("vec_id"), "left")
    return docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("text").alias("lexical_content"), "embedding",
        F.lit("p").alias("project_id"), F.lit("/r").alias("repo_root"), F.when(F.col("lang") == "en", "code").otherwise("markdown").alias("content_type"),
        F.col("source").alias("doc_path"), "source", F.concat("source", F.lit(".md")).alias("filename"), F.col("lang").alias("language"),
        symbol_name().alias("symbol_name"), F.lit("module").alias("chunk_type"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"),
    )


CHUNKS = """SELECT doc_id AS chunk_id, text AS content, text, embedding, 'p' AS project_id, CASE WHEN lang = 'en' THEN 'code' ELSE 'markdown' END AS content_type,
  source AS doc_path, source, lang AS language, (CASE WHEN doc_id % 2 = 0 THEN 'Sym' ELSE 'sym' END) || (doc_id % 97) AS symbol_name, sha256(text) AS content_hash
FROM documents LEFT JOIN embeddings ON doc_id = vec_id"""
ASKED = "SELECT item_id AS qid, text AS query, embedding FROM benchmark JOIN embeddings ON item_id = vec_id"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a query, with the vector of its number."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return items.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid")


# ---- vectors


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _semantic(op: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = vector.top_k(vectors(spark, sf_dir), _first_vector(spark, sf_dir), 10, op)
        return out.select("chunk_id", T.round4(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))

    return run


for _name, _op in (("cosine", "<=>"), ("ip", "<#>"), ("l2", "<->")):
    QUERIES[f"semantic_topk_{_name}"] = _semantic(_op)
    ORACLES[f"semantic_topk_{_name}"] = f"""WITH {sql.nearest("SELECT vec_id AS chunk_id, embedding FROM embeddings", "SELECT 0 AS qid, embedding FROM embeddings WHERE vec_id = 0", 10, _op)}
SELECT chunk_id, {sql.round4("score")} AS score, rank FROM sm"""


@query(f"""WITH {sql.nearest("SELECT chunk_id, embedding FROM (" + CHUNKS + ") WHERE content_type = 'markdown' AND language = 'fr'", "SELECT 0 AS qid, embedding FROM embeddings WHERE vec_id = 0", 40)}
SELECT chunk_id, {sql.round4("score")} AS score, rank FROM sm""")
def semantic_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = store.query(chunk_rows(spark, sf_dir), {"content_type": "markdown", "language": "fr"})
    out = vector.top_k(inside, _first_vector(spark, sf_dir), 40)
    return out.select("chunk_id", T.round4(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {sql.nearest("SELECT vec_id AS chunk_id, embedding FROM embeddings", "SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 50 = 0", 10)}
SELECT qid, chunk_id, {sql.round4("score")} AS score, rank FROM sm""")
def semantic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    out = vector.batch_top_k(vectors(spark, sf_dir), queries, 10)
    return out.select("qid", "chunk_id", T.round4(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


# ---- lexical

DOCS = "SELECT doc_id AS chunk_id, text FROM documents"
INDEX = sql.index(DOCS)


def _index(spark: SparkSession, sf_dir: str) -> lexical.Index:
    return lexical.build(texts(spark, sf_dir).where(F.trim("text") != ""))


@query(f"WITH {INDEX} SELECT chunk_id, dl, (SELECT count(*) FROM p WHERE p.chunk_id = d.chunk_id) AS n_terms FROM d")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = lexical.lengths(_index(spark, sf_dir).kept)
    return per.select("chunk_id", F.col("dl").cast("long").alias("dl"), F.col("n_terms").cast("long").alias("n_terms"))


@query(f"WITH {INDEX} SELECT term, df, ttf, {sql.round4('idf')} AS idf FROM terms")
def doc_freq_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", "df", "ttf", T.round4(F.col("idf")).alias("idf"))


@query(f"WITH {INDEX} SELECT term, {sql.round4('info')} AS info, {sql.round4('1 - info')} AS entropy FROM terms")
def term_informativeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir).terms.select("term", T.round4(F.col("info")).alias("info"), T.round4(F.col("entropy")).alias("entropy"))


@query(f"""WITH {INDEX} SELECT n AS n_docs, n_terms, floor(avgdl * 100 + 0.5) / 100 AS avgdl, {sql.round4('greatest(0.5, least(1.5, avgdl / 100))')} AS alpha,
{sql.round4('CASE WHEN n = 0 THEN 0.01 ELSE 1 / ln(1.0 + n) END')} AS beta, {sql.round4('idf_max')} AS idf_max FROM c""")
def corpus_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.statistics(_index(spark, sf_dir))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "chunk_id", T.round4(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


ONE = "SELECT 0::BIGINT AS qid, 'the reblein thion ofanea LICENSE_version erLythe MIT' AS query"
ITEMS = "SELECT item_id AS qid, text AS query FROM benchmark"


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "the reblein thion ofanea LICENSE_version erLythe MIT")], "qid long, query string")


def _lexical_oracle(queries: str, n: int, normalized: bool, docs: str = DOCS) -> str:
    return f"WITH {sql.index(docs)}, {sql.scored(queries)}, {sql.top_lexical(n, normalized)} SELECT qid, chunk_id, {sql.round4('score')} AS score, rank FROM lt"


@query(_lexical_oracle(ONE, 10, False))
def bmx_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.search(_index(spark, sf_dir), _one(spark), 10, False))


@query(_lexical_oracle(ONE, 10, True))
def bmx_topk_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(lexical.search(_index(spark, sf_dir), _one(spark), 10))


@query(_lexical_oracle(ITEMS, 10, True))
def bmx_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _shown(lexical.search(_index(spark, sf_dir), items, 10))


@query(_lexical_oracle(ONE, 10, True, DOCS + " WHERE lang <> 'de'"))
def bmx_after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "documents").where("lang = 'de'").select(F.col("doc_id").alias("chunk_id"))
    return _shown(lexical.search(lexical.without(_index(spark, sf_dir), gone), _one(spark), 10))


@query(_lexical_oracle(ONE, 10, True, "SELECT doc_id AS chunk_id, CASE WHEN lang = 'fr' THEN 'reblein license ' || text ELSE text END AS text FROM documents"))
def bmx_after_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = table(spark, sf_dir, "documents").where("lang = 'fr'").select(F.col("doc_id").alias("chunk_id"), F.concat(F.lit("reblein license "), "text").alias("text"))
    return _shown(lexical.search(lexical.updated(_index(spark, sf_dir), changed), _one(spark), 10))


CHANGED = """SELECT doc_id AS chunk_id, CASE WHEN doc_id % 7 = 0 THEN 'reblein license ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE trim(text) <> '' AND doc_id % 11 <> 0"""


@query(_lexical_oracle(ITEMS, 10, True, CHANGED))
def bmx_delta_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written index after three changes: documents added, replaced and removed by runs of their own."""
    docs = lexical.index_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.lit(None).cast("string").alias("lexical_content"), F.col("text").alias("content")))
    index = delta.DeltaIndex.build(docs.where("chunk_id % 5 <> 0"), staging.folder(spark, "delta"))
    index.apply(docs.where("chunk_id % 5 = 0"))
    index.apply(docs.where("chunk_id % 7 = 0").withColumn("text", F.concat(F.lit("reblein license "), "text")))
    index.apply(None, docs.where("chunk_id % 11 = 0").select("chunk_id"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return _shown(index.search(items, 10))


@query(f"""WITH {sql.index(CHANGED)} SELECT n AS n_docs, n_terms, floor(avgdl * 100 + 0.5) / 100 AS avgdl, {sql.round4('greatest(0.5, least(1.5, avgdl / 100))')} AS alpha,
{sql.round4('CASE WHEN n = 0 THEN 0.01 ELSE 1 / ln(1.0 + n) END')} AS beta, {sql.round4('idf_max')} AS idf_max FROM c""")
def corpus_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of an index in the store's catalogue that followed two changes of the store."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").cast("string").alias("doc_path"), F.col("text").alias("content"), "doc_id").where("trim(content) <> ''")
    kept = store.Store(spark, staging.folder(spark, "indexed")).ensure()
    kept.append(docs, "s", "p")
    catalogue = indexes.Catalogue(kept)
    catalogue.get("s", "p")
    changed = docs.where("doc_id % 7 = 0 AND doc_id % 11 <> 0").withColumn("content", F.concat(F.lit("reblein license "), "content"))
    kept.upsert(changed, "s", "p", docs.where("doc_id % 11 = 0").select("doc_path"))
    index, view = catalogue.get("s", "p")
    return lexical.statistics(index.index(view))


IDENTIFIERS = ["getXMLParserById", "rate_limiter", "XMLParser", "HTTP", "HTTPSServer", "plain word", "", "_private get_the", "get_userById camelCase  x", "a__b", "fooBar HTTPServer snake_case_name"]


def _identifiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(IDENTIFIERS)), "qid int, query string")


_IDENTIFIER_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(IDENTIFIERS)) + ") AS v(qid, query)"


@query(f"SELECT qid, query, {sql.expanded('query')} AS expanded, array_to_string({sql.tokens(sql.expanded('query'))}, ',') AS tokens FROM ({_IDENTIFIER_ROWS})")
def expand_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = T.expand_identifiers(F.col("query"))
    return _identifiers(spark).select("qid", "query", wide.alias("expanded"), F.array_join(T.tokens(wide), ",").alias("tokens"))


@query(r"SELECT qid, regexp_full_match(trim(query), '[A-Za-z_$][A-Za-z0-9_$]*(\.[A-Za-z_$][A-Za-z0-9_$]*)*') AS is_symbol FROM (" + _IDENTIFIER_ROWS + ")")
def symbol_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identifiers(spark).select("qid", T.is_symbol_query(F.col("query")).alias("is_symbol"))


# ---- fusion


@query(f"SELECT qid, vec_id, {sql.round4(sql.normal('x'))} AS score FROM (SELECT label AS qid, vec_id, embedding[1]::DOUBLE AS x FROM embeddings UNION ALL SELECT 100, 1, 0.5 UNION ALL SELECT 101, 1, 0.25 UNION ALL SELECT 101, 2, 0.25)")
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("qid"), "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    odd = spark.createDataFrame([(100, 1, 0.5), (101, 1, 0.25), (101, 2, 0.25)], "qid int, vec_id long, x double")
    return rows.unionByName(odd).select("qid", "vec_id", T.round4(hybrid.normalize(F.col("x"), "qid")).alias("score"))


def _search_ctes(queries: str, extra: str = "") -> str:
    return (
        f"ch AS MATERIALIZED ({CHUNKS}), qs AS MATERIALIZED ({queries}), "
        + sql.nearest("SELECT chunk_id, embedding FROM ch", "SELECT qid, embedding FROM qs", 40)
        + ", " + sql.index("SELECT chunk_id, text FROM ch") + ", " + sql.scored("SELECT qid, query FROM qs") + ", " + sql.top_lexical(40) + ", " + sql.FUSED + extra
    )


@query(f"WITH {_search_ctes(ASKED)} SELECT qid, chunk_id, {sql.round4('score')} AS score, {sql.round4('sem')} AS sem, {sql.round4('lex')} AS lex, pos FROM fused")
def hybrid_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, queries = chunk_rows(spark, sf_dir), asked(spark, sf_dir)
    a = vector.batch_top_k(rows, queries, 40)
    b = lexical.search(lexical.build(lexical.index_text(rows)), queries, 40)
    out = hybrid.fuse(a, b, Config())
    return out.select("qid", "chunk_id", *[T.round4(F.col(c)).alias(c) for c in ("score", "sem", "lex")], F.col("pos").cast("long").alias("pos"))


SYMBOL_CTES = """,
sh AS (SELECT qid, chunk_id, symbol_name, query AS sq FROM ch, qs WHERE regexp_full_match(trim(query), '[A-Za-z_$][A-Za-z0-9_$]*(\\.[A-Za-z_$][A-Za-z0-9_$]*)*') AND (symbol_name ILIKE '%' || trim(query) || '%')),
se AS (SELECT *, CASE WHEN symbol_name = trim(sq) THEN 1 ELSE 2 END AS tier, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN symbol_name = trim(sq) THEN 1 ELSE 2 END, chunk_id) AS n FROM sh WHERE lower(symbol_name) = lower(trim(sq)) QUALIFY n <= 10),
sf AS (SELECT *, 3 AS tier, row_number() OVER (PARTITION BY qid ORDER BY chunk_id) AS n FROM sh QUALIFY n <= 10),
su AS (SELECT qid, chunk_id, tier FROM se UNION ALL SELECT qid, chunk_id, tier FROM sf WHERE NOT EXISTS (SELECT 1 FROM se WHERE se.qid = sf.qid AND se.chunk_id = sf.chunk_id)),
sy AS (SELECT qid, chunk_id, tier, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.95 ELSE 0.8 END::DOUBLE AS score, row_number() OVER (PARTITION BY qid ORDER BY tier, chunk_id) AS rank FROM su QUALIFY rank <= 10)"""
WARN = Config().code_warning.strip()
RESULT_CTES = f""",
po AS (SELECT qid, chunk_id, score, 1 AS first, pos FROM fused WHERE NOT EXISTS (SELECT 1 FROM sy WHERE sy.qid = fused.qid AND sy.chunk_id = fused.chunk_id) AND (SELECT count(*) FROM sy WHERE sy.qid = fused.qid) < 10
       UNION ALL SELECT qid, chunk_id, score, 0, rank FROM sy),
pn AS (SELECT *, count(*) FILTER (first = 0) OVER (PARTITION BY qid) AS ns, row_number() OVER (PARTITION BY qid ORDER BY first, pos) AS pos1 FROM po),
pm AS (SELECT pn.*, ch.* EXCLUDE (chunk_id), CASE WHEN ns = 0 THEN 'hybrid' WHEN ns >= 10 THEN 'symbol' ELSE 'symbol+hybrid' END AS mode FROM pn JOIN ch USING (chunk_id)),
pc AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_path ORDER BY pos1) AS nth FROM pm),
pl AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos1) AS pos2 FROM pc WHERE nth <= 3 OR mode = 'symbol'),
pd AS (SELECT *, row_number() OVER (PARTITION BY qid, doc_path ORDER BY pos2) AS again FROM pl WHERE pos2 <= 10),
pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pos2) AS rank FROM pd WHERE again = 1 OR mode = 'symbol')
SELECT qid, rank, chunk_id AS id, {sql.round4('score')} AS score, doc_path AS source, CASE WHEN content_type = 'code' AND NOT starts_with(content, '{WARN}') THEN '{WARN}' || chr(10) || content ELSE content END AS content, mode FROM pr WHERE rank <= 10"""
NO_SYMBOLS = ",\nsy AS (SELECT 0 AS qid, 0 AS chunk_id, 0.0 AS score, 0 AS rank WHERE false)"


def _results(out: DataFrame) -> DataFrame:
    return hybrid.shape(out, Config()).select("qid", F.col("rank").cast("long").alias("rank"), "id", "score", "source", "content", "mode")


@query(f"WITH {_search_ctes(ASKED, NO_SYMBOLS + RESULT_CTES)}")
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(hybrid.search(chunk_rows(spark, sf_dir), asked(spark, sf_dir), Config(symbol_enabled=False)))


SYMBOL_QUERIES = [(0, "Sym10"), (1, "SYM3"), (2, "sym"), (3, "ym9"), (4, " sym5 "), (5, "not a symbol"), (6, "none.such")]
SYMBOL_ROWS = "SELECT v.qid::BIGINT AS qid, query, embedding FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in SYMBOL_QUERIES) + ") AS v(qid, query) JOIN embeddings ON v.qid = vec_id"


def _symbol_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SYMBOL_QUERIES, "qid long, query string")
    return rows.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), "embedding"), "qid")


@query(f"WITH {_search_ctes(SYMBOL_ROWS, SYMBOL_CTES + RESULT_CTES)}")
def hybrid_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(hybrid.search(chunk_rows(spark, sf_dir), _symbol_queries(spark, sf_dir)))


@query(f"WITH ch AS MATERIALIZED ({CHUNKS}), qs AS ({SYMBOL_ROWS}) {SYMBOL_CTES} SELECT qid, chunk_id, score, tier, rank FROM sy")
def symbol_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("chunk_id"), symbol_name().alias("symbol_name"))
    out = symbols.search(rows, spark.createDataFrame(SYMBOL_QUERIES, "qid long, query string"), 10)
    return out.select("qid", "chunk_id", "score", "tier", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH ch AS MATERIALIZED ({CHUNKS}), {sql.index('SELECT chunk_id, text FROM ch')}, {sql.scored(ITEMS)}, {sql.top_lexical(10)},
k AS (SELECT lt.*, row_number() OVER (PARTITION BY qid ORDER BY lt.rank) AS r FROM lt JOIN ch USING (chunk_id) WHERE language = 'en')
SELECT qid, chunk_id AS id, {sql.round4('score')} AS score, r AS rank, 'lexical' AS mode FROM k""")
def lexical_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.lit(None).cast("array<float>").alias("embedding"))
    out = hybrid.search(chunk_rows(spark, sf_dir), items, Config(symbol_enabled=False), {"language": "en"}, mode="lexical")
    return out.select("qid", F.col("chunk_id").alias("id"), T.round4(F.col("score")).alias("score"), F.col("pos").cast("long").alias("rank"), "mode")


@query(f"""WITH {sql.nearest("SELECT vec_id AS chunk_id, embedding FROM embeddings", "SELECT 1 AS qid, embedding FROM embeddings WHERE vec_id = 0", 10)}
SELECT qid, chunk_id, {sql.round4("score")} AS score, rank FROM sm""")
def semantic_zero_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query vector of zeros or null matches nothing; the others are answered."""
    first = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.explode(F.array(*[F.struct(F.lit(q).alias("qid"), v.alias("embedding")) for q, v in ((0, F.transform("embedding", lambda x: x * 0)), (1, F.col("embedding")), (2, F.lit(None)))])).alias("q"))
    out = vector.batch_top_k(vectors(spark, sf_dir), first.select("q.*"), 10)
    return out.select("qid", "chunk_id", T.round4(F.col("score")).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"""WITH ch AS MATERIALIZED ({CHUNKS}), {sql.index('SELECT chunk_id, text FROM ch')}, {sql.scored(ITEMS)}, {sql.top_lexical(10)}
SELECT qid, lt.rank, '── ' || doc_path || CASE WHEN chunk_id % 2 = 0 THEN ':' || (1 + chunk_id % 9) || '-' || (10 + chunk_id % 9) ELSE '' END || ' (' || symbol_name || ')  [' || printf('%.4f', {sql.round4('score')}) || ']' AS line
FROM lt JOIN ch USING (chunk_id)""")
def search_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a search as the text lines that a terminal shows."""
    rows = chunk_rows(spark, sf_dir)
    rows = rows.withColumns({"start_line": F.when(rows["chunk_id"] % 2 == 0, 1 + rows["chunk_id"] % 9).cast("int"), "end_line": (10 + rows["chunk_id"] % 9).cast("int")})
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), F.lit(None).cast("array<float>").alias("embedding"))
    out = hybrid.search(rows, items, Config(symbol_enabled=False), mode="lexical")
    return hybrid.render(hybrid.shape(out, Config())).select("qid", F.col("rank").cast("long").alias("rank"), "line")


@query(f"""WITH ch AS MATERIALIZED ({CHUNKS}), qs AS ({SYMBOL_ROWS}), {sql.index('SELECT chunk_id, text FROM ch')}, {sql.scored('SELECT qid, query FROM qs')}, {sql.top_lexical(10)} {SYMBOL_CTES},
po AS (SELECT qid, chunk_id, score, 1 AS first, rank AS pos FROM lt WHERE NOT EXISTS (SELECT 1 FROM sy WHERE sy.qid = lt.qid AND sy.chunk_id = lt.chunk_id) AND (SELECT count(*) FROM sy WHERE sy.qid = lt.qid) < 10
       UNION ALL SELECT qid, chunk_id, score, 0, rank FROM sy),
pn AS (SELECT *, count(*) FILTER (first = 0) OVER (PARTITION BY qid) AS ns, row_number() OVER (PARTITION BY qid ORDER BY first, pos) AS rank FROM po)
SELECT qid, rank, chunk_id AS id, {sql.round4('score')} AS score, CASE WHEN ns = 0 THEN 'lexical' WHEN ns >= 10 THEN 'symbol' ELSE 'symbol+lexical' END AS mode FROM pn WHERE rank <= 10""")
def lexical_with_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hybrid.search(chunk_rows(spark, sf_dir), _symbol_queries(spark, sf_dir), mode="lexical")
    return out.select("qid", F.col("pos").cast("long").alias("rank"), F.col("chunk_id").alias("id"), T.round4(F.col("score")).alias("score"), "mode")


@query("""SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'lexical ' || text ELSE text END AS text FROM documents WHERE trim(text) <> ''""")
def index_text_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical text is indexed where it is not blank, else the content."""
    own = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("lexical "), "text")).when(F.col("doc_id") % 3 == 1, F.lit("  "))
    return lexical.index_text(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), own.alias("lexical_content")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND source <> '' THEN source WHEN doc_id % 3 = 0 AND lang <> '' THEN lang WHEN doc_id % 5 = 0 THEN 'f' || doc_id ELSE '__unknown__' END AS key FROM documents")
def source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of path, source and file name that is neither null nor empty."""
    of = lambda n, x: F.when(F.col("doc_id") % n == 0, x)
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(of(2, F.col("source")), F.lit("")).alias("doc_path"), of(3, F.col("lang")).alias("source"), of(5, F.concat(F.lit("f"), "doc_id")).alias("filename"))
    return rows.select("doc_id", hybrid.source_key().alias("key"))


POOL = "SELECT item_id AS qid, doc_id AS chunk_id, source AS doc_path, row_number() OVER (PARTITION BY item_id ORDER BY (doc_id * 7919 + item_id * 31) % 10007, doc_id) AS pos FROM documents, benchmark WHERE (doc_id + item_id) % 40 = 0"


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("doc_path"), (F.col("doc_id") % 40).alias("k"))
    items = table(spark, sf_dir, "benchmark").select("item_id", F.pmod(-F.col("item_id"), F.lit(40)).alias("k"))
    order = Window.partitionBy("item_id").orderBy((F.col("doc_id") * 7919 + F.col("item_id") * 31) % 10007, "doc_id")
    none = F.lit(None).cast("string")
    return docs.join(items, "k").select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), "doc_path", none.alias("source"), none.alias("filename"), F.row_number().over(order).cast("long").alias("pos"))


def _limited(n: int) -> str:
    return f"SELECT qid, chunk_id, doc_path, pos FROM ({POOL}) QUALIFY row_number() OVER (PARTITION BY qid, doc_path ORDER BY pos) <= {n}"


@query(_limited(3))
def cap_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.cap_per_file(_pool(spark, sf_dir), 3).select("qid", "chunk_id", "doc_path", "pos")


@query(_limited(1))
def dedup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid.dedup_by_source(_pool(spark, sf_dir)).select("qid", "chunk_id", "doc_path", "pos")


@query(f"SELECT doc_id AS chunk_id, CASE WHEN lang = 'en' AND NOT starts_with(text, '{WARN}') THEN '{WARN}' || chr(10) || text ELSE text END AS content FROM documents")
def code_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("lang") == "en", "code").otherwise("markdown")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), hybrid.code_warning(F.col("text"), kind, Config()).alias("content"))


# ---- the store


@query(f"SELECT chunk_id, doc_path FROM ({CHUNKS}) WHERE content_type = 'code' AND doc_path = 'src3'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.query(chunk_rows(spark, sf_dir), {"content_type": "code", "doc_path": "src3", "language": None}).select("chunk_id", "doc_path")


@query("SELECT coalesce(lang, 'unknown') AS content_type, count(*) AS n FROM documents GROUP BY 1")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stats(table(spark, sf_dir, "documents").select(F.col("lang").alias("content_type")))


@query("""WITH g AS (SELECT source AS doc_path, sha256(lang) AS content_hash, count(*) AS chunk_count FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL)
SELECT doc_path, content_hash, chunk_count FROM g QUALIFY row_number() OVER (PARTITION BY doc_path ORDER BY chunk_count DESC, content_hash DESC) = 1""")
def store_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sources(table(spark, sf_dir, "documents").select(F.col("source").alias("doc_path"), F.sha2(F.encode("lang", "UTF-8"), 256).alias("content_hash")))


# ---- chunks, paths and symbols


@query(f"WITH RECURSIVE {sql.by_size('SELECT doc_id AS k, text AS body FROM documents')} SELECT k AS doc_id, part, part_text, first_line, last_line FROM bs")
def chunk_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.by_size(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "part", "part_text", "first_line", "last_line")


@query("SELECT doc_id AS chunk_id, '# File: ' || source || ' | Symbol: s' || doc_id || CASE WHEN lang = 'en' THEN '' ELSE ' | Language: ' || lang END || chr(10) || text AS lexical_content FROM documents")
def lexical_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lang = F.when(F.col("lang") != "en", F.col("lang"))
    return docs.select(F.col("doc_id").alias("chunk_id"), chunking.lexical_text(F.col("source"), F.concat(F.lit("s"), "doc_id"), lang, F.col("text")).alias("lexical_content"))


PATHS = ["src/a.ts", "b.TSX", "c.jsx", "lib/x.h", "Makefile", "dir.d/README", "doc.md", "x.mdx", "s.scss", "conf.yaml", "a.b.py", ".env", "q.sql", "w.zsh", "n.unknownext", "k.kt", "t.txt", "z.toml"]
_PATH_ROWS = "SELECT * FROM (VALUES " + ", ".join(f"('{p}')" for p in PATHS) + ") AS v(path)"


def _case(x: str, table_: dict[str, str], other: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + f" ELSE {other} END"


_DOT = "lower(CASE WHEN contains(path, '.') THEN regexp_extract(path, '\\.[^.]*$') ELSE right(path, 1) END)"
_EXT = "lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\\.[^.]*)$', 1))"


@query(f"SELECT path, {_case(_DOT, paths.CHUNK_LANGUAGES, chr(39) + 'unknown' + chr(39))} AS chunk_language, {_case(_EXT, paths.PARSE_LANGUAGES, 'NULL')} AS parse_language, {_case('substr(' + _EXT + ', 2)', paths.SHOWN_LANGUAGES, chr(39) + 'text' + chr(39))} AS shown_language FROM ({_PATH_ROWS} UNION ALL SELECT url FROM pages)")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    p = F.col("path")
    return rows.select("path", paths.chunk_language(p).alias("chunk_language"), paths.parse_language(p).alias("parse_language"), paths.shown_language(p).alias("shown_language"))


@query(f"SELECT path, CASE WHEN {_case(_DOT, paths.CHUNK_LANGUAGES, chr(39) + 'unknown' + chr(39))} = 'markdown' THEN 'markdown' ELSE 'code' END AS content_type FROM ({_PATH_ROWS} UNION ALL SELECT url FROM pages)")
def content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(p,) for p in PATHS], "path string").unionByName(table(spark, sf_dir, "pages").select(F.col("url").alias("path")))
    return rows.select("path", paths.content_type(paths.chunk_language(F.col("path"))).alias("content_type"))


_GRAMS = "list_distinct(list_transform(range(1, len({0}) - 1), lambda i: array_to_string({0}[i:i+2], '|')))"


@query(f"""WITH a AS (SELECT doc_id, source, regexp_split_to_array(text, ' ') AS x FROM documents),
pr AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY source ORDER BY doc_id) AS y FROM a),
g AS (SELECT doc_id, {_GRAMS.format('x')} AS ga, {_GRAMS.format('y')} AS gb FROM pr WHERE y IS NOT NULL)
SELECT doc_id, {sql.round4('CASE WHEN len(ga) = 0 AND len(gb) = 0 THEN 1.0 WHEN len(ga) = 0 OR len(gb) = 0 THEN 0.0 ELSE len(list_intersect(ga, gb))::DOUBLE / len(list_distinct(list_concat(ga, gb))) END')} AS similarity FROM g""")
def structural_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Ids are paired first; the sets then meet by id, so that no source gathers in one task.
    pairs = docs.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("other")).where("other IS NOT NULL")
    sets = docs.select("doc_id", symbols.gram_set(F.split("text", " ")).alias("x"))
    both = pairs.join(sets, "doc_id").join(sets.select(F.col("doc_id").alias("other"), F.col("x").alias("y")), "other")
    return both.select("doc_id", T.round4(symbols.jaccard(F.col("x"), F.col("y"))).alias("similarity"))


@query(r"""WITH l AS (SELECT doc_id AS file_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
u AS (SELECT *, i - row_number() OVER (PARTITION BY file_id ORDER BY i) AS g FROM l WHERE i % 5 NOT IN (1, 2)),
r AS (SELECT file_id, min(i) AS a, max(i) AS b, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS content FROM u GROUP BY file_id, g)
SELECT file_id, a::INTEGER AS first_line, b::INTEGER AS last_line, content FROM r WHERE length(content) > 20""")
def module_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    lines = files.select("file_id", F.explode(F.sequence(F.lit(0), F.size(F.split("content", "\n", -1)) - 1)).alias("i")).where("i % 5 = 1")
    return chunking.gaps(files, lines.select("file_id", (F.col("i") + 1).alias("line"), (F.col("i") + 2).alias("end_line")))
