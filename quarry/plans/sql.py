"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from quarry.functions.text import STOP_WORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def tokens(text: str) -> str:
    """A list of the index's tokens of a text expression."""
    camel = r"string_split(regexp_replace(regexp_replace(w, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), ' ')"
    snake = f"list_filter(string_split(lower(w), '_'), lambda p: p <> '' AND NOT list_contains({STOP}, p))"
    parts = f"CASE WHEN contains(w, '_') THEN CASE WHEN len({snake}) > 1 THEN {snake} ELSE [] END WHEN len({camel}) > 1 THEN list_filter(list_transform({camel}, lambda q: lower(q)), lambda p: NOT list_contains({STOP}, p)) ELSE [] END"
    return f"flatten(list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9_]+'), lambda w: CASE WHEN list_contains({STOP}, lower(w)) THEN [] ELSE list_concat([lower(w)], {parts}) END))"


def expanded(query: str) -> str:
    """A query with the parts of its identifiers."""
    low = lambda x: f"CASE WHEN len({x}) > 1 THEN list_transform({x}, lambda p: lower(p)) ELSE [] END"
    snake = "list_filter(string_split(t, '_'), lambda p: p <> '')"
    camel, caps = (rf"string_split(regexp_replace(t, '{r}', '\1 \2', 'g'), ' ')" for r in ("([a-z])([A-Z])", "([A-Z]+)([A-Z][a-z])"))
    parts = f"CASE WHEN contains(t, '_') THEN {low(snake)} WHEN regexp_matches(t, '[a-z][A-Z]') THEN {low(camel)} WHEN regexp_matches(t, '[A-Z]{{2,}}[a-z]') THEN {low(caps)} ELSE [] END"
    return rf"array_to_string(flatten(list_transform(list_filter(regexp_split_to_array(coalesce({query}, ''), '\s+'), lambda t: t <> ''), lambda t: list_concat([t], {parts}))), ' ')"


SIGMOID = "CASE WHEN tf >= 8 THEN 1.0::DOUBLE WHEN tf <= -8 THEN 0.0::DOUBLE ELSE (tf::DOUBLE * tf * tf + 6.0::DOUBLE * tf + 12) / (tf::DOUBLE * tf * tf + 12.0::DOUBLE * tf + 48) END"


def index(texts: str) -> str:
    """CTEs d, p, b, terms and c over a query of (chunk_id, text)."""
    return f"""
t AS MATERIALIZED (SELECT chunk_id, {tokens('text')} AS tokens FROM ({texts}) WHERE trim(text) <> ''),
d AS (SELECT chunk_id, len(tokens) AS dl FROM t),
p AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM t) GROUP BY ALL),
b AS (SELECT count(*) AS n, coalesce(avg(dl), 0) AS avgdl FROM d),
s AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf, var_pop(tf) AS v, sum(m) AS s, sum(m * ln(m)) AS sl FROM (SELECT term, tf, {SIGMOID} AS m FROM p) GROUP BY term),
terms AS MATERIALIZED (SELECT term, df, ttf, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) AS idf,
  CASE WHEN df < 2 THEN 1.0::DOUBLE WHEN v / (v + 1) < 0.001 THEN 1 - df::DOUBLE / n
       ELSE v / (v + 1) * greatest(1 - least((ln(s) - sl / s) / ln(df::DOUBLE), 1.0::DOUBLE), 0.0::DOUBLE) + (1 - v / (v + 1)) * (1 - df::DOUBLE / n) END AS info FROM s, b),
c AS (SELECT n, avgdl, (SELECT coalesce(max(idf), 1.0) FROM terms) AS idf_max, (SELECT count(*) FROM terms) AS n_terms FROM b)"""


def scored(queries: str) -> str:
    """CTEs q0, q and lx (qid, chunk_id, score) of queries (qid, query) over an index."""
    return f"""
q0 AS (SELECT qid, unnest({tokens(expanded('query'))}) AS term FROM ({queries})),
q AS (SELECT qid, term, count(*) AS qtf, count(*) OVER (PARTITION BY qid) AS m FROM q0 GROUP BY qid, term),
w AS (SELECT qid, term, qtf, m, avgdl, idf * (1 + 0.5::DOUBLE * (idf / idf_max) * info) AS eidf, idf / idf_max * info * qtf AS extra FROM q JOIN terms USING (term), c WHERE idf > 0),
x AS (SELECT qid, chunk_id, m, extra, eidf * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) * qtf AS ts FROM w JOIN p USING (term) JOIN d USING (chunk_id)),
lx AS MATERIALIZED (SELECT qid, chunk_id, sum(ts) + sum(tanh(ts)) / any_value(m) * sum(extra) AS score FROM x GROUP BY qid, chunk_id)"""


def key(x: str) -> str:
    return f"floor(({x}) * 1e9 + 0.5)"


def round4(x: str) -> str:
    return f"floor(({x}) * 10000 + 0.5) / 10000"


def top_lexical(n: int, normalized: bool = True) -> str:
    """CTE lt (qid, chunk_id, score, rank)."""
    value = "score / max(score) OVER (PARTITION BY qid)" if normalized else "score"
    return f"""
lr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {key('score')} DESC, chunk_id) AS rank FROM lx QUALIFY rank <= {n}),
lt AS (SELECT qid, chunk_id, {value} AS score, rank FROM lr)"""


DISTANCES = {
    "<=>": "1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "<#>": "-list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
    "<->": "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])",
}


def nearest(vectors: str, queries: str, k: int, op: str = "<=>", min_score: float = 0.05) -> str:
    """CTE sm (qid, chunk_id, score, rank, distance) of queries (qid, embedding) over vectors (chunk_id, embedding)."""
    return f"""
sd AS (SELECT b.qid, a.chunk_id, {DISTANCES[op]} AS distance FROM ({vectors}) a, ({queries}) b WHERE a.embedding IS NOT NULL AND len(list_filter(a.embedding, lambda e: e <> 0)) > 0),
sr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY {key('distance')}, chunk_id) AS rank FROM sd QUALIFY rank <= {k}),
sm AS MATERIALIZED (SELECT qid, chunk_id, greatest(0.0, 1 - distance / 2) AS score, rank, distance FROM sr WHERE greatest(0.0, 1 - distance / 2) >= {min_score})"""


def normal(x: str) -> str:
    g = "OVER (PARTITION BY qid)"
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN count({x}) {g} = 1 OR max({x}) {g} - min({x}) {g} < 1e-9 THEN 1.0 ELSE ({x} - min({x}) {g}) / (max({x}) {g} - min({x}) {g}) END"


FUSED = f"""
fa AS (SELECT *, {normal('score')} AS ns FROM sm), fb AS (SELECT *, {normal('score')} AS nl FROM lt),
fj AS (SELECT coalesce(fa.qid, fb.qid) AS qid, coalesce(fa.chunk_id, fb.chunk_id) AS chunk_id, fa.score AS sem, fb.score AS lex, ns, nl, fa.rank AS sem_rank, fb.rank AS lex_rank
       FROM fa FULL JOIN fb ON fa.qid = fb.qid AND fa.chunk_id = fb.chunk_id),
fs AS (SELECT *, CASE WHEN count(lex) OVER (PARTITION BY qid) > 0 THEN coalesce(ns, 0) * 0.6::DOUBLE + coalesce(nl, 0) * 0.4::DOUBLE ELSE sem END AS score FROM fj),
fused AS MATERIALIZED (SELECT qid, chunk_id, score, sem, lex, row_number() OVER (PARTITION BY qid ORDER BY {key('score')} DESC, sem_rank NULLS LAST, lex_rank NULLS LAST, chunk_id) AS pos FROM fs)"""


def by_size(rows: str, most: int = 750, overlap: int = 200) -> str:
    """CTE bs (k, part, parts, part_text, first_line, last_line) of rows (k, body); the statement must begin WITH RECURSIVE."""
    return f"""
bl AS MATERIALIZED (SELECT k, body, string_split(body, chr(10)) AS ls FROM ({rows})),
bn AS MATERIALIZED (SELECT k, list_transform(ls, lambda x: length(x) + 1) AS ns FROM bl WHERE length(body) > {most}),
-- one step closes a part: `s` its first line, `n` how many lines it holds
bf(k, ns, part, s, n) AS (
  SELECT k, ns, 1, 0, (SELECT count(*) FROM range(1, len(ns) + 1) r(i) WHERE list_sum(ns[1:i]) <= {most} OR i = 1) FROM bn
  UNION ALL
  SELECT k, ns, part + 1, s + n - o, (SELECT count(*) FROM range(1, len(ns) - (s + n - o) + 1) r(i) WHERE i <= o + 1 OR list_sum(ns[s + n - o + 1:s + n - o + i]) <= {most})
  FROM (SELECT *, (SELECT count(*) FROM range(1, n + 1) r(j) WHERE j = 1 OR list_sum(ns[s + n - j + 2:s + n]) < {overlap}) AS o FROM bf WHERE s + n < len(ns))),
bs AS (SELECT k, part::INTEGER AS part, count(*) OVER (PARTITION BY k) AS parts, array_to_string(ls[s + 1:s + n], chr(10)) AS part_text, s::INTEGER AS first_line, (s + n - 1)::INTEGER AS last_line FROM bf JOIN bl USING (k)
  UNION ALL SELECT k, 1, 1, body, 0, (len(ls) - 1)::INTEGER FROM bl WHERE length(body) <= {most})"""
