"""The registered queries opN_<name> over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, licenses, lines, merkle, mixing, neardup, negatives, quality, substrings, token_ids, tokens, toxicity, urls, work

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("clean_text", "kept_chars")


ORACLES["op10_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (SELECT rid, unnest(range(1, len(words) - 3)) AS pos, words FROM w WHERE len(words) >= 5),
h AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, words[pos], words[pos+1], words[pos+2], words[pos+3], words[pos+4]) AS n FROM g),
r AS (SELECT rid, pos, lead(pos) OVER (PARTITION BY rid ORDER BY pos) - pos AS gap FROM h WHERE n >= 2),
rep AS (SELECT rid, sum(least(5, coalesce(gap, 5)))::BIGINT AS n_repeat_words FROM r GROUP BY rid),
l AS (SELECT rid, doc_id, len(words) AS n_words, text,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
k AS (SELECT *, list_filter(list_transform(lines, lambda x: lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))), lambda x:
        (length(x) - length(translate(x, '{quality.SYMBOLS}', ''))) * 100 <= length(x) * {quality.MAX_SYMBOL_PERCENT}
        AND (len(regexp_split_to_array(x, '[\x20\x09-\x0D]+')) >= {quality.SHORT_LINE} OR regexp_matches(x, '{quality.ENDS_WELL.replace("'", "''")}'))
        AND NOT regexp_matches(x, '{quality.NAVIGATION}')
        AND NOT (len(regexp_split_to_array(x, '[\x20\x09-\x0D]+')) <= {quality.BOILERPLATE_WORDS} AND regexp_matches(x, '{quality.BOILERPLATE}'))) AS good FROM l),
f AS (SELECT k.rid, doc_id, n_words::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^{quality.SYMBOLS}]', '', 'g'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(array_to_string(good, ''), '[\x20\x09-\x0D]', '', 'g')) AS kept_chars
      FROM k LEFT JOIN rep ON k.rid = rep.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND kept_chars * 100 >= word_chars * {quality.MIN_KEPT_PERCENT} AS kept
FROM f
"""


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


@query
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, urls.built_in_labels(spark))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = lines.dedup(docs, lines.file_batches(docs, 4))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
s AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key),
t AS (SELECT rid, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM s GROUP BY rid)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_dropped::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN t ON d.rid = t.rid
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(*toxicity.training_rows(docs, table(spark, sf_dir, "labels"))))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classify(table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(table(spark, sf_dir, "documents"))


@query
def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("source")


def _merkle_sql(levels: int = 7) -> str:
    """The tree level by level, enough levels for 16 ** levels rows of a source."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {byte}), 4294967295)"
    rest = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"

    def tree(name: str, key: str) -> list[str]:
        """CTEs name0.. of (key, pos, node) by level, and name_path: the siblings of each first node on every level."""
        out = []
        for k in range(1, levels + 1):
            out.append(f"{name}{k} AS (SELECT s, pos // 16 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM {name}{k - 1} WHERE s IN (SELECT s FROM {name}{k - 1} GROUP BY s HAVING count(*) > 1) GROUP BY s, pos // 16)")
        for k in range(levels):
            out.append(f"""{name}_run{k} AS (SELECT a.s, a.pos, a.pos // 16 AS up, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
              FROM {name}{k} a JOIN {name}{k} b ON a.s = b.s AND a.pos // 16 = b.pos // 16 WHERE a.s IN (SELECT s FROM {name}{k + 1}) GROUP BY a.s, a.pos)""")
        joins = " ".join(f"LEFT JOIN {name}_run{k} x{k} ON n.s = x{k}.s AND n.pos // {16**k} = x{k}.pos" for k in range(levels))
        steps = ", ".join(f"x{k}" for k in range(levels))
        out.append(f"{name}_path AS (SELECT n.s, n.pos, n.node, list_filter([{', '.join(f'CASE WHEN x{k}.l IS NULL THEN NULL ELSE {{l: x{k}.l, r: x{k}.r}} END' for k in range(levels))}], lambda z: z IS NOT NULL) AS path FROM {name}0 n {joins})")
        out.append(f"{name}_root AS (SELECT s, node FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k DESC) AS t FROM ({' UNION ALL '.join(f'SELECT s, node, {k} AS k FROM {name}{k}' for k in range(levels + 1))})) WHERE t = 1)")
        return out

    fold = "list_reduce(list_prepend({l: now, r: ''}, path), lambda h, z: {l: sha256(z.l || h.l || z.r), r: ''}).l"
    ctes = [
        f"d AS (SELECT doc_id, source, sha256({rest} || {part('text')}) AS leaf, CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {crc} % 5 = 0 THEN sha256({rest} || {part(lower)}) END AS now FROM documents)",
        "o AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, coalesce(now, leaf)) - 1 AS pos FROM d)",
        "a0 AS (SELECT s, pos, leaf AS node FROM o)", *tree("a", "s"),
        "b0 AS (SELECT 0 AS s, s - 1 AS pos, node FROM a_root)", *tree("b", "s"),
        """p AS (SELECT o.doc_id, o.leaf, coalesce(o.now, o.leaf) AS now, y.node AS subroot, (SELECT node FROM b_root) AS root, list_concat(x.path, y.path) AS path
          FROM o JOIN a_path x ON o.s = x.s AND o.pos = x.pos JOIN b_path y ON y.pos = o.s - 1)""",
        f"f AS (SELECT *, sha256(list_aggregate(list_prepend('', list_transform(path, lambda z: z.l || z.r)), 'string_agg', '')) AS proof_sha256, {fold} AS folded_root FROM p)",
    ]
    return "WITH " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f"


ORACLES["op11_merkle_manifest"] = _merkle_sql()


@query
def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work.new_path(spark, "token-ids")
    token_ids.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_ids.checksums(token_ids.read(spark, path))


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op12_hard_negatives"] = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.rid AS arid, a.v AS av, a.label, a.vec_id AS anchor_id, b.rid AS prid, b.vec_id AS positive_id, list_inner_product(a.v, b.v)::BIGINT AS ps
  FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid WHERE a.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY a.rid ORDER BY ps DESC, b.vec_id, b.rid) <= 5),
s AS (SELECT DISTINCT a.arid, b.rid, b.vec_id AS negative_id, list_inner_product(a.av, b.v)::BIGINT AS ns FROM (SELECT DISTINCT arid, av, label FROM p) a JOIN v b ON a.label <> b.label),
n AS (SELECT anchor_id, positive_id, ps, negative_id, ns, row_number() OVER (PARTITION BY p.arid, prid ORDER BY ns DESC, negative_id, rid) AS rank
  FROM p JOIN s ON p.arid = s.arid AND 30 * ps <= 100 * ns AND 100 * ns <= 90 * ps)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 10
"""
