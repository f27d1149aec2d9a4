"""Queries over the store, synchronisation, projects, chunked files and symbol tables.

Documents stand for files and their chunks, lineitem rows for symbols of files
(an order is a file), nations for registered projects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import paths
from quarry.operators import chunks as chunking
from quarry.operators import filters, symbols
from quarry.sources import files, layout, staging, store, sync
from quarry.streaming import ingest

from . import sql
from .registry import query, table

# ---- the store, written and changed by its own operations

STORED = """SELECT 'c' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'p1' ELSE 'p2' END AS project_id, 'd' || doc_id % 50 AS doc_path, text AS content, sha256(text) AS content_hash,
  CASE WHEN doc_id % 3 = 0 THEN text ELSE 'L ' || text END AS lexical_content, CASE WHEN lang = 'en' THEN 'code' ELSE 'markdown' END AS content_type FROM documents"""


def _store(spark: SparkSession, sf_dir: str) -> store.Store:
    """A new store of two appends: one names the request's project, one leaves it to the rows."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", F.concat(F.lit("c"), "doc_id").alias("id"), F.col("text").alias("content"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("L "), "text")).alias("lexical_content"),
        F.concat(F.lit("d"), F.col("doc_id") % 50).alias("doc_path"), F.when(F.col("lang") == "en", "code").otherwise("markdown").alias("content_type"),
        F.lit("p2").alias("project_id"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"),
    )
    made = store.Store(spark, staging.folder(spark, "store")).ensure()
    made.append(rows.where("doc_id % 2 = 0"), "s", "p1")
    made.append(rows.where("doc_id % 2 <> 0"), "s")
    return made


@query(f"SELECT id, project_id, doc_path, content AS semantic_content, lexical_content FROM ({STORED})")
def store_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).read().select("id", "project_id", "doc_path", "semantic_content", "lexical_content")


@query(f"SELECT id, project_id, doc_path FROM ({STORED}) WHERE NOT (doc_path = 'd8' AND project_id = 'p1') AND doc_path <> 'd7'")
def delete_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One path goes in one project, the request line winning over the body, another in all projects."""
    made = _store(spark, sf_dir)
    made.delete("s", {"doc_path": "d8"}, {"doc_path": "d9", "project_id": "p1"})
    made.delete("s", body={"source": "d7"})
    return made.read().select("id", "project_id", "doc_path")


@query(f"SELECT id, project_id FROM ({STORED}) WHERE project_id <> 'p2'")
def delete_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _store(spark, sf_dir)
    made.delete("s", {"project_id": "p2"})
    return made.read().select("id", "project_id")


@query(f"""SELECT id, doc_path, content FROM ({STORED}) WHERE project_id = 'p2' OR doc_path NOT IN ('d4', 'd6', 'd10')
UNION ALL SELECT 'n' || doc_id, 'd4', 'new ' || text FROM documents WHERE doc_id < 5""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of one path are replaced, two paths are dropped, in one project."""
    made = _store(spark, sf_dir)
    new = table(spark, sf_dir, "documents").where("doc_id < 5").select(F.concat(F.lit("n"), "doc_id").alias("id"), F.lit("d4").alias("doc_path"), F.concat(F.lit("new "), "text").alias("content"))
    made.upsert(new, "s", "p1", spark.createDataFrame([("d6",), ("d10",)], "doc_path string"))
    return made.read().select("id", "doc_path", "content")


@query(f"SELECT id, content FROM ({STORED}) WHERE id IN (SELECT 'c' || doc_id FROM labels)")
def store_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.by_ids(_store(spark, sf_dir).read(), table(spark, sf_dir, "labels").select(F.concat(F.lit("c"), "doc_id").alias("id"))).select("id", "content")


@query(f"SELECT id FROM ({STORED}) WHERE project_id = 'p1' AND content_type = 'code'")
def store_scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty scope does not restrict; the request's content type wins over the filters'."""
    rows = filters.scoped(_store(spark, sf_dir).read(), "p1", "", "s").where(filters.content_types("code"))
    return rows.where(filters.condition(filters.merged({"content_type": "markdown"}, "code"))).select("id")


@query(f"SELECT id FROM ({STORED}) WHERE content_type = 'markdown'")
def store_content_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).read().where(filters.content_types("docs")).where(filters.content_types("all")).select("id")


@query(f"""WITH g AS (SELECT doc_path, content_hash, count(*) AS chunk_count FROM ({STORED}) GROUP BY ALL)
SELECT doc_path, content_hash, chunk_count FROM g QUALIFY row_number() OVER (PARTITION BY doc_path ORDER BY chunk_count DESC, content_hash DESC) = 1""")
def store_sources_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.sources(_store(spark, sf_dir).read())


# ---- synchronisation

LOCAL = "SELECT 'd' || doc_id AS doc_path, sha256(CASE WHEN doc_id % 5 = 1 THEN 'x' || text ELSE text END) AS h, 1 + doc_id % 3 AS e FROM documents WHERE doc_id % 7 <> 3"
KEPT = "SELECT 'd' || doc_id AS doc_path, sha256(text) AS h, 1 + doc_id % 2 AS c FROM documents WHERE doc_id % 11 <> 4"


def _plan_sql(force: bool) -> str:
    forced = "WHEN true THEN 'forced' " if force else ""
    return f"""SELECT coalesce(a.doc_path, b.doc_path) AS doc_path, CASE WHEN a.h IS NULL THEN 'stale' WHEN b.h IS NULL THEN 'new' WHEN a.h <> b.h THEN 'updated' {forced}WHEN c < e THEN 'incomplete' ELSE 'unchanged' END AS action
FROM ({LOCAL}) a FULL JOIN ({KEPT}) b ON a.doc_path = b.doc_path"""


PLAN = _plan_sql(False)


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id")).alias("doc_path")
    changed = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    local = docs.where("doc_id % 7 <> 3").select(path, F.sha2(F.encode(changed, "UTF-8"), 256).alias("content_hash"), (1 + F.col("doc_id") % 3).alias("expected_chunks"), changed.alias("content"))
    kept = docs.where("doc_id % 11 <> 4").select(path, F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), (1 + F.col("doc_id") % 2).alias("chunk_count"), F.col("text").alias("content"))
    return local, kept


def _plan(spark: SparkSession, sf_dir: str, force: bool = False) -> DataFrame:
    return sync.plan(*_sides(spark, sf_dir), force)


@query(PLAN)
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).select("doc_path", "action")


@query(_plan_sql(True))
def sync_forced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, True).select("doc_path", "action")


@query(f"SELECT doc_path, CASE action WHEN 'new' THEN 'missing' WHEN 'updated' THEN 'outdated' WHEN 'incomplete' THEN 'incomplete' WHEN 'unchanged' THEN 'current' ELSE 'stale' END AS status FROM ({PLAN})")
def sync_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.status(_plan(spark, sf_dir))


@query(f"SELECT doc_path FROM ({PLAN}) WHERE action = 'stale'")
def stale_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).where("action = 'stale'").select("doc_path")


@query(f"SELECT count(*) FILTER (action = 'new') AS n_new, count(*) FILTER (action IN ('updated', 'incomplete')) AS n_updated, count(*) FILTER (action = 'incomplete') AS n_incomplete, count(*) FILTER (action = 'unchanged') AS n_unchanged, count(*) FILTER (action = 'stale') AS n_stale FROM ({PLAN})")
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.counters(_plan(spark, sf_dir))


@query(f"SELECT a.doc_path, a.h AS content_hash, CASE WHEN a.h = b.h AND c >= e THEN c ELSE e END AS chunk_count FROM ({LOCAL}) a LEFT JOIN ({KEPT}) b ON a.doc_path = b.doc_path")
def sync_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan applied to a store leaves what the local side has; what is unchanged keeps its chunks."""
    local, kept = _sides(spark, sf_dir)
    times = lambda rows, n: rows.select("doc_path", "content_hash", "content", F.explode(F.sequence(F.lit(1), n)).alias("chunk"))
    made = store.Store(spark, staging.folder(spark, "store")).ensure()
    made.append(times(kept, F.col("chunk_count").cast("int")), "s", "p")
    planned = sync.plan(local, store.sources(made.read()))
    sync.apply(made, planned, times(local, F.col("expected_chunks").cast("int")), "s", "p")
    return store.sources(made.read())


# ---- projects and paths

PROJECTS = "SELECT 'p' || n_nationkey AS id, n_name AS name, '/r/' || n_regionkey || '/' || n_nationkey AS root FROM nation"
KEYS = """SELECT DISTINCT CASE o_orderkey % 6 WHEN 0 THEN 'p' || k WHEN 1 THEN lower(coalesce(n_name, 'no')) WHEN 2 THEN coalesce(n_name, 'no') || '/x/y' WHEN 3 THEN '/r/' || coalesce(n_regionkey, 9) || '/' || k WHEN 4 THEN '/r/' || coalesce(n_regionkey, 9) || '/' || k || '/a/b' ELSE 'none' || k END AS key
FROM (SELECT o_orderkey, o_orderkey // 6 % 30 AS k FROM orders) o LEFT JOIN nation ON k = n_nationkey"""


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.concat(F.lit("p"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("/r/"), "n_regionkey", F.lit("/"), "n_nationkey").alias("root"))


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.expr("(o_orderkey div 6) % 30").alias("k"))
    both = orders.join(table(spark, sf_dir, "nation"), F.col("k") == F.col("n_nationkey"), "left")
    name, root = F.coalesce("n_name", F.lit("no")), F.concat(F.lit("/r/"), F.coalesce("n_regionkey", F.lit(9)), F.lit("/"), "k")
    kind = F.col("o_orderkey") % 6
    key = F.when(kind == 0, F.concat(F.lit("p"), "k")).when(kind == 1, F.lower(name)).when(kind == 2, F.concat(name, F.lit("/x/y"))).when(kind == 3, root).when(kind == 4, F.concat(root, F.lit("/a/b"))).otherwise(F.concat(F.lit("none"), "k"))
    return both.select(key.alias("key")).distinct()


@query(f"""SELECT key, arg_min(id, o) AS id FROM (SELECT key, id, CASE WHEN lower(key) = lower(id) THEN 0 WHEN lower(key) = lower(name) THEN 1 WHEN lower(split_part(key, '/', 1)) = lower(id) THEN 2 WHEN lower(split_part(key, '/', 1)) = lower(name) THEN 3 WHEN key = root THEN 4 ELSE 5 END AS o
FROM ({KEYS}) LEFT JOIN ({PROJECTS}) ON lower(key) IN (lower(id), lower(name)) OR (contains(key, '/') AND lower(split_part(key, '/', 1)) IN (lower(id), lower(name))) OR key = root OR starts_with(key, root || '/')) GROUP BY key""")
def project_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.find_projects(_keys(spark, sf_dir), _projects(spark, sf_dir))


@query(f"SELECT id, name, root FROM ({PROJECTS}) WHERE id NOT IN ('p3', 'p4') UNION ALL SELECT 'p3', 'renamed', '/new'")
def project_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project registered anew, one taken out."""
    known = sync.registered(_projects(spark, sf_dir), spark.createDataFrame([("p3", "renamed", "/new")], "id string, name string, root string"))
    return sync.unregistered(known, spark.createDataFrame([("p4",)], "id string"))


@query(f"SELECT key, (SELECT max(root) FROM ({PROJECTS}) WHERE key = root OR starts_with(key, root || '/')) AS root FROM ({KEYS})")
def project_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = [f"/r/{r['n_regionkey']}/{r['n_nationkey']}" for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect()]  # 25 rows, a literal list
    return _keys(spark, sf_dir).select("key", sync.resolve_project(F.col("key"), roots).alias("root"))


@query("""SELECT url AS path, regexp_extract(url, '[^/]*$') AS basename, CASE WHEN starts_with(url, 'https:/') THEN substr(url, 9) ELSE url END AS relative, url = 'https:/' OR starts_with(url, 'https://') AS inside,
CASE WHEN ext = 'md' THEN 'markdown' WHEN ext IN ('html', 'php') THEN 'code' WHEN ext IN ('yaml', 'json') THEN 'config' ELSE 'text' END AS shown_type
FROM (SELECT url, lower(substr(regexp_extract(regexp_extract(url, '[^/]*$'), '^.+(\\.[^.]*)$', 1), 2)) AS ext FROM pages WHERE url IS NOT NULL)""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    rows = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(F.col("url").alias("path"))
    return rows.select("path", paths.basename(p).alias("basename"), paths.relative(p, F.lit("https:/")).alias("relative"), paths.within(p, F.lit("https:/")).alias("inside"), paths.shown_content_type(p, ("html", "php"), ("yaml", "json")).alias("shown_type"))


# ---- files in chunks

_FILES = """SELECT 'f' || doc_id AS file_id, doc_id || CASE doc_id % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.md' ELSE '.py' END AS filename, text, string_split(text, chr(10)) AS ls, doc_id FROM documents"""


@query(f"""WITH RECURSIVE fl AS MATERIALIZED (SELECT *, CASE WHEN doc_id % 3 = 0 THEN least(3, len(ls)) - 1 ELSE 0 END AS skip FROM ({_FILES})),
{sql.by_size("SELECT file_id AS k, CASE WHEN doc_id % 3 = 0 THEN array_to_string(ls[skip + 1:], chr(10)) ELSE text END AS body FROM fl")},
ck AS (SELECT file_id, CASE WHEN doc_id % 3 <> 0 THEN filename WHEN parts > 1 THEN 'fn' || doc_id || '[' || part || '/' || parts || ']' ELSE 'fn' || doc_id END AS symbol_name,
    CASE WHEN doc_id % 3 = 0 THEN 'function' ELSE 'module' END AS chunk_type, skip + first_line + 1 AS start_line, skip + last_line + 1 AS end_line, part_text AS content FROM fl JOIN bs ON k = file_id
  UNION ALL SELECT file_id, 'module_level', 'module', 1, skip, c FROM (SELECT file_id, skip, regexp_replace(array_to_string(ls[1:skip], chr(10)), '^\\s+|\\s+$', '', 'g') AS c FROM fl WHERE doc_id % 3 = 0 AND skip > 0) WHERE length(c) > 20)
SELECT file_id, symbol_name, chunk_type, start_line::INTEGER AS start_line, end_line::INTEGER AS end_line, content, length(content)::INTEGER AS chunk_chars, 'src/' || filename AS doc_path, sha256(text) AS content_hash,
  CASE doc_id % 3 WHEN 1 THEN 'markdown' ELSE 'code' END AS content_type, '# File: src/' || filename || ' | Symbol: ' || symbol_name || ' | Language: ' || CASE doc_id % 3 WHEN 0 THEN 'typescript' WHEN 1 THEN 'markdown' ELSE 'python' END || chr(10) || content AS lexical_content
FROM ck JOIN fl USING (file_id)""")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file has a definition from its third line on, which is cut and numbered; what is before it is module level."""
    docs = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    name = F.concat("doc_id", F.when(kind == 0, ".ts").when(kind == 1, ".md").otherwise(".py"))
    file_id = F.concat(F.lit("f"), "doc_id").alias("file_id")
    files = docs.select(file_id, F.concat(F.lit("/r/src/"), name).alias("path"), F.col("text").alias("content"), F.lit("/r").alias("repo_root"), F.lit("p").alias("project_id"))
    n = F.size(F.split("text", "\n", -1))
    found = docs.where(kind == 0).select(file_id, F.concat(F.lit("fn"), "doc_id").alias("name"), F.lit("function").alias("type"), F.least(F.lit(3), n).alias("line"), n.alias("end_line"))
    return chunking.chunk(files, found).select("file_id", "symbol_name", "chunk_type", "start_line", "end_line", "content", "chunk_chars", "doc_path", "content_hash", "content_type", "lexical_content")


# ---- symbols

SYMBOLS = """SELECT l_orderkey AS file_id, ['Outer', 'Inner', 'run', 'size'][1 + l_partkey % 4] AS name, CASE WHEN l_suppkey % 4 = 0 THEN 'ref' ELSE 'def' END AS kind,
  ['class', 'function', 'method', 'property', 'query', 'interface', 'box'][1 + l_partkey // 4 % 7] AS type, l_linenumber AS line, (l_linenumber + l_quantity::INTEGER % 9)::INTEGER AS end_line, (l_suppkey % 5)::INTEGER AS "column" FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names)).cast("int") + 1)
    part = F.col("l_partkey")
    one = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(one)).where("n = 1").select(
        F.col("l_orderkey").alias("file_id"), pick(["Outer", "Inner", "run", "size"], part).alias("name"), F.when(F.col("l_suppkey") % 4 == 0, "ref").otherwise("def").alias("kind"),
        pick(["class", "function", "method", "property", "query", "interface", "box"], F.expr("l_partkey div 4")).alias("type"), F.col("l_linenumber").alias("line"),
        (F.col("l_linenumber") + F.col("l_quantity").cast("int") % 9).cast("int").alias("end_line"), (F.col("l_suppkey") % 5).cast("int").alias("column"),
    )


@query(f"""WITH s AS ({SYMBOLS}), d AS (SELECT * FROM s WHERE kind = 'def'),
i AS (SELECT r.file_id, r.line, r.end_line, r.type, r."column", min(i.line * 1000 + i.end_line) AS c FROM d r JOIN d i ON i.file_id = r.file_id AND i.name = 'Inner' AND i.line <= r.line AND i.end_line >= r.end_line WHERE r.name = 'run' GROUP BY ALL)
SELECT i.file_id, i.line, i.end_line, i.type, row_number() OVER (PARTITION BY i.file_id ORDER BY abs(i.line - 4), i.line, "column") AS rank FROM i
WHERE EXISTS (SELECT 1 FROM d o WHERE o.file_id = i.file_id AND o.name = 'Outer' AND o.line <= c // 1000 AND o.end_line >= c % 1000)""")
def find_symbol_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.find(_symbols(spark, sf_dir), "Outer.Inner.run", 4).select("file_id", "line", "end_line", "type", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT file_id, kind, type, count(*) AS n FROM ({SYMBOLS}) GROUP BY ALL")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.counts(_symbols(spark, sf_dir))


_ORDER = "[" + ", ".join(f"'{t}'" for t in symbols.SUMMARY_ORDER) + "]"


@query(f"""WITH n AS (SELECT file_id, type, count(*) AS n, coalesce(list_position({_ORDER}, type), 99) AS o FROM ({SYMBOLS}) WHERE kind = 'def' GROUP BY ALL)
SELECT file_id, string_agg(n || ' ' || CASE WHEN n = 1 THEN type WHEN type LIKE '%s' THEN type || 'es' WHEN type LIKE '%y' THEN left(type, length(type) - 1) || 'ies' ELSE type || 's' END, ', ' ORDER BY o, type) AS summary FROM n GROUP BY file_id""")
def symbol_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return symbols.summary(_symbols(spark, sf_dir))


@query(f"""WITH s AS (SELECT * REPLACE (line // 4 AS line) FROM ({SYMBOLS})),
d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY file_id, name, kind, line ORDER BY "column", type) = 1)
SELECT file_id, name, type, line, "column" FROM d WHERE kind = 'def' AND contains(lower(name), 'n') AND name <> 'Inner'""")
def symbol_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without repeats of a name on a line, by kind and part of the name, some names left out."""
    rows = _symbols(spark, sf_dir).withColumn("line", F.expr("line div 4").cast("int"))
    return symbols.listed(rows, "def", None, "N", ("Inner",)).select("file_id", "name", "type", "line", "column")


BLOCKS = "SELECT DISTINCT l_orderkey AS file_id, l_linenumber AS block, l_linenumber * 10 AS start, l_linenumber * 10 + 5 + l_linenumber * 3 % 50 AS \"end\" FROM lineitem"
ANCHORS = "SELECT l_orderkey AS file_id, l_linenumber * 7 + l_suppkey % 5 AS start, l_linenumber * 7 + l_suppkey % 5 + l_partkey % 20 AS \"end\", 'k' || l_partkey % 4 % 3 AS kind, (l_partkey % 4)::INTEGER AS priority FROM lineitem"


@query(f"""WITH b AS ({BLOCKS}), a AS (SELECT file_id, start, "end", arg_max(kind, priority) AS kind, max(priority) AS priority FROM ({ANCHORS}) GROUP BY ALL),
h AS (SELECT a.*, block, b.start AS bs FROM a JOIN b ON a.file_id = b.file_id AND b.start <= a.start AND b."end" >= a."end" QUALIFY row_number() OVER (PARTITION BY a.file_id, a.start, a."end" ORDER BY b."end" - b.start, block) = 1)
SELECT file_id, block, start, "end", kind, priority, row_number() OVER (PARTITION BY file_id, block ORDER BY priority DESC, start, "end") AS rank FROM h WHERE start > bs QUALIFY rank <= 2""")
def anchors_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each anchor in its innermost block, the two best of a block."""
    items = table(spark, sf_dir, "lineitem")
    blocks = items.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("block"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + 5 + F.col("l_linenumber") * 3 % 50).alias("end")).distinct()
    start = F.col("l_linenumber") * 7 + F.col("l_suppkey") % 5
    marks = items.select(F.col("l_orderkey").alias("file_id"), start.alias("start"), (start + F.col("l_partkey") % 20).alias("end"), F.concat(F.lit("k"), F.col("l_partkey") % 4 % 3).alias("kind"), (F.col("l_partkey") % 4).cast("int").alias("priority"))
    return symbols.assign_anchors(blocks, marks, 2).withColumn("rank", F.col("rank").cast("long"))


# ---- versions of the store, and indexes that follow it


@query(f"SELECT id, project_id, doc_path, content_hash FROM ({STORED}) ")
def store_snapshot_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before three changes, read after them."""
    made = _store(spark, sf_dir)
    before = made.snapshot().version
    rows = made.read()
    made.upsert(rows.where("doc_path IN ('d1', 'd2')").withColumn("content", F.lit("changed")), "s", "p1")
    made.delete_docs("s", spark.createDataFrame([("d3",), ("d4",)], "doc_path string"))
    made.delete_project("s", "p2")
    return made.read(before).select("id", "project_id", "doc_path", "content_hash")


@query(f"""SELECT id, project_id, doc_path, CASE WHEN doc_path = 'd2' AND project_id = 'p1' THEN 'changed' ELSE content END AS content FROM ({STORED})
WHERE doc_path NOT IN ('d3', 'd4')""")
def store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live rows after changes whose deletes were folded in."""
    made = _store(spark, sf_dir)
    made.upsert(made.read().where("doc_path = 'd2' AND project_id = 'p1'").withColumn("content", F.lit("changed")), "s", "p1")
    made.delete_docs("s", spark.createDataFrame([("d3",), ("d4",)], "doc_path string"))
    made.compact()
    made.vacuum(keep=1, older_s=-1)
    return made.read().select("id", "project_id", "doc_path", "content")


# ---- lookups in bucketed tables, discovery, figures, streams


def _laid_out(spark: SparkSession, sf_dir: str) -> layout.Layout:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("d"), F.col("doc_id") % 50).alias("doc_path"), "source", F.concat(F.when(F.col("doc_id") % 2 == 0, "Sym").otherwise("sym"), F.col("doc_id") % 97).alias("symbol_name"), F.col("text").alias("content"))
    made = store.Store(spark, staging.folder(spark, "laid-out")).ensure()
    made.append(rows, "s", "p")
    laid = layout.Layout(made, 16)
    laid.publish()
    return laid


@query("""WITH d AS (SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 'Sym' ELSE 'sym' END) || (doc_id % 97) AS symbol_name FROM documents), q AS (SELECT DISTINCT 'SYM' || (p_size % 100) AS q FROM part UNION SELECT 'sym' || (p_size % 7) FROM part)
SELECT q, doc_id::VARCHAR AS id, CASE WHEN symbol_name = q THEN 1 ELSE 2 END AS tier FROM q JOIN d ON lower(q) = lower(symbol_name)""")
def symbol_lookup_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select(F.concat(F.lit("SYM"), F.col("p_size") % 100).alias("q")).unionByName(part.select(F.concat(F.lit("sym"), F.col("p_size") % 7).alias("q"))).distinct().withColumn("qid", F.lit(0))
    return _laid_out(spark, sf_dir).by_symbol(asked).select("q", "id", "tier")


@query("SELECT 'd' || doc_id % 50 AS doc_path, doc_id::VARCHAR AS id, source FROM documents WHERE doc_id % 50 IN (SELECT n_nationkey FROM nation)")
def by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), "n_nationkey").alias("doc_path"))
    return _laid_out(spark, sf_dir).by_path(docs).select("doc_path", "id", "source")


@query("""SELECT 'src/lang=' || lang AS folder, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS content_hash, sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS raw_hash,
sum(strlen(coalesce(text, '')) + 1)::BIGINT AS length FROM documents GROUP BY lang""")
def discover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written from the documents of each language, found again; copies in skipped folders and other extensions are not."""
    docs = table(spark, sf_dir, "documents")
    root = staging.folder(spark, "tree")
    files_ = docs.select("lang", "doc_id", F.coalesce("text", F.lit("")).alias("value")).repartition("lang").sortWithinPartitions("lang", "doc_id").drop("doc_id")
    for folder in ("src", "node_modules/src", "src/.git"):
        files_.write.partitionBy("lang").text(f"{root}/{folder}")
    files_.limit(1).drop("lang").write.csv(f"{root}/other")
    found = files.hashed(spark, root, ["txt"])
    return found.select(F.regexp_replace("file_id", "/[^/]*$", "").alias("folder"), "content_hash", "raw_hash", "length")


@query("""SELECT count(*) FILTER (s = 'ok') AS files_ok, count(*) FILTER (s = 'failed') AS files_failed, count(*) FILTER (s = 'skipped') AS files_skipped, sum(n)::BIGINT AS chunks, sum(b)::BIGINT AS bytes
FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN 'failed' WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'ok' END AS s, doc_id % 4 AS n, strlen(coalesce(text, '')) AS b FROM documents)""")
def ingest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the pass that writes the rows, seen while they go by."""
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(i.cast("string").alias("doc_path"), F.when(i % 7 == 0, "failed").when(i % 5 == 0, "skipped").otherwise("ok").alias("state"), (i % 4).alias("n_chunks"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"))
    watched, seen = sync.observed(rows)
    watched.write.parquet(staging.folder(spark, "ingested"))
    return spark.createDataFrame([sync.metrics(seen, 1.0)], "files_ok long, files_failed long, files_skipped long, chunks long, bytes long, seconds double, chunks_per_second double, bytes_per_second double").drop("seconds", "chunks_per_second", "bytes_per_second")


@query("SELECT 'd' || doc_id % 40 || '.txt' AS doc_path, sha256(arg_max(text, doc_id)) AS content_hash FROM documents WHERE trim(text) <> '' GROUP BY doc_id % 40")
def stream_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of files that come out of order in micro-batches, one of them twice: the store has the latest of each."""
    docs = table(spark, sf_dir, "documents").where("trim(text) <> ''")
    i = F.col("doc_id")
    name = F.concat(F.lit("/r/d"), i % 40, F.lit(".txt"))
    versions = docs.select("doc_id", name.alias("file_id"), name.alias("path"), F.col("text").alias("content"), F.lit("/r").alias("repo_root"), F.lit("p").alias("project_id"), F.timestamp_seconds(i).alias("modified"))
    made = store.Store(spark, staging.folder(spark, "streamed")).ensure()
    for part in (2, 0, 1, 2):
        ingest.put(versions.where(F.col("doc_id") % 3 == part).drop("doc_id"), made, "s", "p")
    return made.read().select("doc_path", "content_hash").distinct()
