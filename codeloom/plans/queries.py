"""Queries over the given tables, each with the SQL that another engine checks it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import budget, calls, facts, graph, incremental, manifests, names, retrieval, sections, sequence, structure, usage, xref
from codeloom.operators.store import kept
from codeloom.plans import diagrams, rules, tables
from codeloom.plans.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TRADE_SQL = """
WITH e AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
d AS (SELECT node, CAST(count(*) AS BIGINT) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY node)
"""


@query(TRADE_SQL + "SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 10")
def degree_top_k_all(spark, sf):
    return graph.most_connected(tables.trade_edges(spark, sf), 10)


@query(TRADE_SQL + ", top AS (SELECT node FROM d ORDER BY degree DESC, node LIMIT 2000) SELECT src, dst FROM e WHERE src IN (SELECT node FROM top) AND dst IN (SELECT node FROM top)")
def induced_edges_all(spark, sf):
    edges = tables.trade_edges(spark, sf)
    return graph.induced(edges, graph.most_connected(edges, 2000))


@query(TRADE_SQL + "SELECT count(*) AS n_nodes, count(*) > 10 AS truncated, CASE WHEN count(*) > 10 THEN 'the 10 most connected nodes' END AS note FROM d")
def truncation_note_all(spark, sf):
    return graph.truncation(tables.trade_edges(spark, sf), 10)


@query(TRADE_SQL + """, n AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS node, n_name AS nation FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT g.nation, x.target FROM (SELECT DISTINCT nation FROM n) g LEFT JOIN (
  SELECT DISTINCT a.nation, b.nation AS target FROM e JOIN n a ON a.node = src JOIN n b ON b.node = dst WHERE a.nation <> b.nation) x ON x.nation = g.nation""")
def edge_rollup_keep_isolated_all(spark, sf):
    return graph.roll_up(tables.trade_edges(spark, sf), tables.traders(spark, sf), "nation")


HOSTS_SQL = r"""
WITH h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host,
             array_to_string(list_reverse(string_split(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1), '.')), '.') AS name FROM pages)
"""


@query(HOSTS_SQL + """, p AS (SELECT DISTINCT host, string_split(host, '.') AS x FROM h),
s AS (SELECT host, array_to_string(x[k:], '.') AS suffix FROM (SELECT host, x, unnest(range(2, len(x) + 1)) AS k FROM p))
SELECT suffix, min(host) AS owner FROM s GROUP BY suffix HAVING count(*) = 1""")
def dotted_suffix_unique(spark, sf):
    return names.unique_suffixes(tables.hosts(spark, sf), "host")


@query(HOSTS_SQL + """, k AS (SELECT DISTINCT name AS known FROM h WHERE page_id % 3 = 0)
SELECT name, arg_max(known, len(string_split(known, '.'))) AS match
FROM (SELECT DISTINCT name || '.' || CAST(page_id AS VARCHAR) AS name FROM h) q JOIN k ON q.name = k.known OR starts_with(q.name, k.known || '.') GROUP BY name""")
def dotted_longest_prefix(spark, sf):
    h = tables.hosts(spark, sf)
    asked = h.select(F.concat_ws(".", "name", F.col("page_id").cast("string")).alias("name"))
    return names.longest_prefix(asked, h.where("page_id % 3 = 0").select(F.col("name").alias("known")))


STANDARD = ["com", "json", "os"]


@query(HOSTS_SQL + r""", m AS (SELECT DISTINCT name AS known FROM h WHERE page_id % 3 = 0),
i AS (SELECT page_id, name AS module, CASE page_id % 4 WHEN 0 THEN name || '.page' WHEN 1 THEN split_part(name, '.', -1) || '.x' WHEN 2 THEN 'org.unknown' || CAST(page_id AS VARCHAR) ELSE '..' || split_part(name, '.', -1) END AS imported FROM h),
r AS (SELECT *, CASE WHEN starts_with(imported, '..') THEN
         CASE WHEN len(string_split(module, '.')) >= 2 THEN array_to_string(list_concat(string_split(module, '.')[:len(string_split(module, '.')) - 2], [substr(imported, 3)]), '.') END
       ELSE imported END AS name FROM i),
e AS (SELECT r.name, arg_max(known, len(string_split(known, '.'))) AS exact FROM (SELECT DISTINCT name FROM r) r JOIN m ON r.name = known OR starts_with(r.name, known || '.') GROUP BY r.name),
s AS (SELECT suffix, min(known) AS owner FROM (SELECT known, array_to_string(string_split(known, '.')[k:], '.') AS suffix FROM (SELECT known, unnest(range(2, len(string_split(known, '.')) + 1)) AS k FROM m)) GROUP BY suffix HAVING count(*) = 1),
b AS (SELECT r.name, arg_max(owner, len(string_split(suffix, '.'))) AS owner FROM (SELECT DISTINCT name FROM r WHERE NOT starts_with(imported, '.')) r JOIN s ON r.name = suffix OR starts_with(r.name, suffix || '.') GROUP BY r.name)
SELECT page_id, module, imported,
  CASE WHEN exact IS NOT NULL THEN 'internal' WHEN starts_with(imported, '.') THEN NULL WHEN split_part(r.name, '.', 1) IN ('com', 'json', 'os') THEN 'stdlib' WHEN owner IS NOT NULL THEN 'internal' ELSE 'third_party' END AS kind,
  CASE WHEN exact IS NOT NULL THEN exact WHEN starts_with(imported, '.') THEN NULL WHEN split_part(r.name, '.', 1) IN ('com', 'json', 'os') THEN split_part(r.name, '.', 1) WHEN owner IS NOT NULL THEN owner ELSE split_part(r.name, '.', 1) END AS target
FROM r LEFT JOIN e USING (name) LEFT JOIN b USING (name)""")
def placement_cascade(spark, sf):
    h = tables.hosts(spark, sf)
    last = F.element_at(F.split("name", r"\."), -1)
    by = F.col("page_id") % 4
    imported = F.when(by == 0, F.concat("name", F.lit(".page"))).when(by == 1, F.concat(last, F.lit(".x"))).when(by == 2, F.concat(F.lit("org.unknown"), F.col("page_id").cast("string"))).otherwise(F.concat(F.lit(".."), last))
    imports = h.select("page_id", F.col("name").alias("module"), F.lit(False).alias("is_package"), imported.alias("imported"))
    return names.place_imports(imports, h.where("page_id % 3 = 0").select(F.col("name").alias("module")), standard=STANDARD).drop("is_package")


_CLEAN = """(SELECT id, name, CASE WHEN c = '' THEN 'node' ELSE c END AS cleaned FROM (
  SELECT id, name, CASE WHEN lower(c) IN (%s) THEN c || '_node' ELSE c END AS c FROM (
    SELECT id, name, CASE WHEN regexp_matches(c, '^[0-9]') THEN 'n' || c ELSE c END AS c FROM (
      SELECT id, name, regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '(?s)[\\[(].*$', ''), '[^\\p{L}\\p{M}\\p{N}_]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS c FROM (%s)))))"""
_NAMES = "SELECT 'page' || CAST(page_id AS VARCHAR) AS id, url AS name FROM pages UNION ALL SELECT 'part' || CAST(p_partkey AS VARCHAR), p_name || ' [' || p_brand FROM part UNION ALL SELECT 'size' || CAST(p_partkey AS VARCHAR), CAST(p_size AS VARCHAR) || p_type FROM part"


@query("SELECT * FROM " + (_CLEAN % (", ".join(f"'{w}'" for w in text.RESERVED_WORDS), _NAMES)).replace("\\\\", "\\"))
def identifier_clean(spark, sf):
    pages, part = table(spark, sf, "pages"), table(spark, sf, "part")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string")).alias("id")
    rows = pages.select(key("page", "page_id"), F.col("url").alias("name"))
    rows = rows.unionByName(part.select(key("part", "p_partkey"), F.concat("p_name", F.lit(" ["), "p_brand").alias("name"))).unionByName(part.select(key("size", "p_partkey"), F.concat(F.col("p_size").cast("string"), "p_type").alias("name")))
    return rows.withColumn("cleaned", text.clean_identifier("name"))


_COMPONENTS = """
WITH c AS (SELECT source AS name, lang AS type, 'f' || CAST(doc_id % 97 AS VARCHAR) AS defined_in, doc_id AS ord FROM documents),
r AS (SELECT name, arg_min(type, ord) AS type, arg_min(defined_in, ord) AS defined_in, min(ord) AS ord FROM c GROUP BY name),
i AS (SELECT DISTINCT 'f' || CAST(doc_id % 89 AS VARCHAR) AS file, source || '.x.src' || CAST(doc_id % 23 AS VARCHAR) AS imported FROM documents),
k AS (SELECT DISTINCT file, unnest([split_part(imported, '.', 1), split_part(imported, '.', -1), imported]) AS key FROM i),
u AS (SELECT DISTINCT k.file, r.name, r.defined_in FROM k JOIN r ON r.name = k.key WHERE k.file <> r.defined_in),
n AS (SELECT r.*, coalesce(x.n, 0) AS n_importers FROM r LEFT JOIN (SELECT name, count(DISTINCT file) AS n FROM u GROUP BY name) x USING (name))
"""


def _components(spark, sf):
    d = table(spark, sf, "documents")
    named = lambda m: F.concat(F.lit("f"), (F.col("doc_id") % m).cast("string"))
    rows = d.select(F.col("source").alias("name"), F.col("lang").alias("type"), named(97).alias("defined_in"), F.col("doc_id").alias("ord"))
    imports = d.select(named(89).alias("file"), F.concat("source", F.lit(".x.src"), (F.col("doc_id") % 23).cast("string")).alias("imported")).distinct()
    return xref.registry(rows), imports


@query(_COMPONENTS + "SELECT name, type, defined_in, ord FROM r")
def first_wins_registry(spark, sf):
    return _components(spark, sf)[0]


@query(_COMPONENTS + "SELECT name, type, defined_in, ord, n_importers FROM n")
def importer_counts(spark, sf):
    return xref.importers(*_components(spark, sf))


@query(_COMPONENTS + "SELECT name, type, defined_in, ord, n_importers, 2 * n_importers AS importance FROM n ORDER BY importance DESC, ord LIMIT 15")
def top_components(spark, sf):
    return xref.top_components(xref.importers(*_components(spark, sf)))


@query(_COMPONENTS + "SELECT f.file, coalesce(array_to_string(x.t, ','), '') AS targets FROM (SELECT DISTINCT file FROM i) f LEFT JOIN (SELECT file, list_sort(list_distinct(list(defined_in))) AS t FROM u GROUP BY file) x USING (file)")
def file_import_graph(spark, sf):
    return xref.file_imports(*_components(spark, sf)).withColumn("targets", F.array_join("targets", ","))


@query(_COMPONENTS + "SELECT name, file, number, more FROM (SELECT name, file, row_number() OVER (PARTITION BY name ORDER BY file) AS number, greatest(count(*) OVER (PARTITION BY name) - 10, 0) AS more FROM (SELECT DISTINCT name, file FROM u)) WHERE number <= 10")
def report_top_importers(spark, sf):
    rows, imports = _components(spark, sf)
    used = xref.import_keys(imports).join(rows.select(F.col("name").alias("key"), "defined_in"), "key").where("file <> defined_in").select(F.col("key").alias("name"), "file").distinct()
    return xref.first_in_group(used, "name", "file", 10)


@query("SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def ordered_string_agg(spark, sf):
    return xref.ordered_join(table(spark, sf, "conversations"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next(spark, sf):
    return xref.neighbours(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("WITH n AS (SELECT DISTINCT p_type || '.' || p_name AS name FROM part), s AS (SELECT name, split_part(name, '.', -1) AS short, count(*) OVER (PARTITION BY split_part(name, '.', -1)) AS n FROM n) SELECT name, CASE WHEN n = 1 THEN short ELSE name END AS label FROM s")
def label_clashes(spark, sf):
    return graph.clashing_labels(table(spark, sf, "part").select(F.concat_ws(".", "p_type", "p_name").alias("name")))


_USAGE = """
WITH e AS (SELECT CASE conv_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model,
    CASE WHEN role = 'assistant' THEN 0 ELSE length(text) // 4 END AS i, CASE WHEN role = 'assistant' THEN length(text) // 4 ELSE 0 END AS o, turn % 2 = 0 AS cached, role = 'system' AS est FROM conversations),
m AS (SELECT model, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, count(*) AS requests, count(*) FILTER (cached) AS cached_requests, bool_or(est) AS estimated FROM e GROUP BY model),
p AS (SELECT * FROM (VALUES ('small', 0.25, 1.25), ('large', 3.0, 15.0)) v(model, pi, po)),
c AS (SELECT m.*, round(coalesce((input_tokens * CAST(pi AS DOUBLE) + output_tokens * CAST(po AS DOUBLE)) / 1e6, 0), 9) AS cost, pi IS NOT NULL AS priced FROM m LEFT JOIN p USING (model))
"""


def _costs(spark, sf):
    t = table(spark, sf, "conversations")
    model = F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "large").otherwise("unknown")
    tokens, reply = text.token_estimate("text"), F.col("role") == "assistant"
    events = t.select(model.alias("model"), F.when(reply, 0).otherwise(tokens).alias("input_tokens"), F.when(reply, tokens).otherwise(0).alias("output_tokens"), (F.col("turn") % 2 == 0).alias("cached"), (F.col("role") == "system").alias("estimated"))
    prices = spark.createDataFrame([("small", 0.25, 1.25), ("large", 3.0, 15.0)], "model string, input_per_million double, output_per_million double")
    return usage.with_cost(usage.by_model(events), prices).withColumn("cost", F.round("cost", 9))


@query(_USAGE + "SELECT * FROM c")
def usage_cost(spark, sf):
    return _costs(spark, sf)


@query("""SELECT user_id AS run, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 30) AS BIGINT) AS output_tokens, bool_or(event_type = 'purchase' AND event_id % 4 < 2) AS truncated FROM events GROUP BY user_id""")
def usage_by_run(spark, sf):
    """Tokens of each user's events, and whether a model stopped at its limit in one, said in one way or another."""
    hit = F.col("event_type") == "purchase"
    key = F.element_at(F.array(*map(F.lit, ("stop_reason", "finish_reason", "other", "stop_reason"))), (F.col("event_id") % 4 + 1).cast("int"))
    said = F.when(hit, F.create_map(key, F.when(F.col("event_id") % 4 == 1, "length").when(F.col("event_id") % 4 == 3, "end_turn").otherwise("max_tokens")))
    events = table(spark, sf, "events").select(F.col("user_id").alias("run"), (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 30).alias("output_tokens"), said.alias("reported"))
    return usage.by_run(events)


@query(_USAGE + "SELECT round(sum(cost), 6) AS cost, CAST(sum(requests) AS BIGINT) AS requests, round(100.0 * sum(cached_requests) / sum(requests), 6) AS hit_rate FROM c")
def usage_totals(spark, sf):
    return usage.totals(_costs(spark, sf)).withColumns({"cost": F.round("cost", 6), "hit_rate": F.round("hit_rate", 6)})


@query("SELECT conv_id, sha256(string_agg(CAST(turn AS VARCHAR) || chr(0) || coalesce(text, '') || chr(0), '' ORDER BY turn)) AS hash FROM conversations GROUP BY conv_id")
def ordered_content_hash(spark, sf):
    return incremental.ordered_hash(table(spark, sf, "conversations"), "conv_id", "turn", "text")


_CHANGES = """
WITH a AS (SELECT doc_id AS path, md5(text) AS content_hash FROM documents WHERE doc_id % 7 <> 0),
b AS (SELECT doc_id AS path, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS content_hash FROM documents WHERE doc_id % 11 <> 0),
s AS (SELECT path, CASE WHEN b.content_hash IS NULL THEN 'new' WHEN a.content_hash IS NULL THEN 'deleted' WHEN a.content_hash <> b.content_hash THEN 'changed' ELSE 'unchanged' END AS status FROM a FULL OUTER JOIN b USING (path))
"""


def _snapshots(spark, sf):
    """Two snapshots of the documents, the second the older: an eleventh is new, a seventh deleted, a fifth changed."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    now = d.where("path % 7 <> 0").select("path", F.md5("text").alias("content_hash"))
    then = d.where("path % 11 <> 0").select("path", F.md5(F.when(F.col("path") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return now, then


@query(_CHANGES + "SELECT path, status FROM s")
def change_set(spark, sf):
    return incremental.classify(*_snapshots(spark, sf))


@query(_CHANGES + "SELECT path, content_hash FROM b JOIN s USING (path) WHERE status = 'unchanged' UNION ALL SELECT path, content_hash FROM a JOIN s USING (path) WHERE status IN ('new', 'changed')")
def keep_and_append(spark, sf):
    now, then = _snapshots(spark, sf)
    return incremental.keep_and_append(then, now, incremental.classify(now, then))


@query(_CHANGES + "SELECT a.path AS section, a.content_hash AS key_hash, b.path IS NOT NULL AS hit FROM a LEFT JOIN b ON a.path = b.path AND a.content_hash = b.content_hash")
def cache_probe(spark, sf):
    now, then = (x.toDF("section", "key_hash") for x in _snapshots(spark, sf))
    return incremental.reusable(now, then).withColumn("hit", F.lit(True)).unionByName(incremental.missing(now, then).withColumn("hit", F.lit(False)))


@query("""WITH c AS (SELECT conv_id AS section, list(turn) AS d FROM conversations GROUP BY conv_id)
SELECT section FROM c WHERE NOT list_has_any(d, [2, 5])""")
def cache_invalidate(spark, sf):
    t = table(spark, sf, "conversations")
    cache = t.groupBy(F.col("conv_id").alias("section")).agg(F.collect_set("turn").alias("depends_on"))
    return incremental.invalidate(cache, t.where("turn in (2, 5)").select(F.col("turn").alias("path")).distinct()).select("section")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS status, md5(text) AS digest FROM documents
UNION ALL SELECT 'old' || CAST(doc_id AS VARCHAR), 'deleted', NULL FROM documents WHERE doc_id % 7 = 0""")
def index_upkeep(spark, sf):
    """Two runs over an index that is kept: documents as they were before, then as they are; statuses of the second, and what the index holds."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    files = lambda path, content: F.struct(path.alias("path"), content.alias("content"))
    number = F.col("doc_id").cast("string")
    then = docs.select(F.explode(F.filter(F.array(
        F.when(F.col("doc_id") % 5 != 0, files(number, F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("before "), "text")).otherwise(F.col("text")))),
        F.when(F.col("doc_id") % 7 == 0, files(F.concat(F.lit("old"), number), F.lit("gone"))),
    ), lambda f: f.isNotNull())).alias("f")).select("f.*")
    now = docs.select(files(number, F.col("text")).alias("f")).select("f.*")
    base = incremental.work_path(spark, "index")
    states = incremental.Store(spark, f"{base}/states", "path string, content_hash string")
    chunks = incremental.Store(spark, f"{base}/chunks", "path string, digest string")
    for content in (then, now):
        hashed = content.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash"))
        digests = content.select("path", F.md5("content").alias("digest"))
        statuses = incremental.update_index(states, chunks, hashed, lambda due, d=digests: d.join(due.select("path"), "path", "left_semi"))
        statuses = kept(statuses, "statuses") if content is now else statuses
    return statuses.join(chunks.read(), "path", "left")


@query("SELECT DISTINCT source, substr(sha256(source), 1, 16) AS key FROM documents")
def project_keys(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().withColumn("key", incremental.project_key(F.col("source")))


@query("""WITH x AS (SELECT item_id, lang AS source, text AS first FROM benchmark, (SELECT DISTINCT lang FROM documents)),
l AS (SELECT DISTINCT source, split_part(trim(first), chr(10), 1) AS line FROM x WHERE split_part(trim(first), chr(10), 1) <> '')
SELECT doc_id, lang AS source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.source = d.lang AND contains(d.text, l.line))""")
def chunks_without_repeats(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("source"), "text")
    excerpts = table(spark, sf, "benchmark").select("text").crossJoin(F.broadcast(docs.select("source").distinct()))
    return budget.drop_repeats(docs, excerpts).select("doc_id", "source")


@query(r"""WITH l AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS line_no, x[k] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS x FROM documents))),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^[A-Z][^.,| ]*\.$') THEN line END AS head FROM l)
SELECT * FROM (SELECT doc_id, line_no, last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS "table" FROM h) WHERE "table" IS NOT NULL""")
def header_scoped_lines(spark, sf):
    rows = manifests.lines(table(spark, sf, "documents"), ["doc_id"])
    return manifests.scoped_lines(rows, ["doc_id"], r"^([A-Z][^.,| ]*\.)$").select("doc_id", "line_no", "table")


@query("""WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
f AS (SELECT source, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS taken FROM o GROUP BY source
  UNION ALL SELECT f.source, o.k, CASE WHEN o.n_chars > 0 AND used + o.n_chars <= 12000 THEN used + o.n_chars ELSE used END,
    CASE WHEN o.n_chars > 0 AND used + o.n_chars <= 12000 THEN list_append(taken, o.doc_id) ELSE taken END FROM f JOIN o ON o.source = f.source AND o.k = f.k + 1)
SELECT source, array_to_string(arg_max(taken, k), ',') AS taken FROM f GROUP BY source""")
def budget_fill(spark, sf):
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars").withColumn("o", F.col("doc_id"))
    return budget.greedy_fill(docs, "source", "o", "doc_id", "n_chars", 12_000).withColumn("taken", F.array_join(F.col("taken").cast("array<string>"), ","))


@query("SELECT doc_id, source, n_chars, before, greatest(0, least(n_chars, 12000 - before)) AS kept FROM (SELECT doc_id, source, n_chars, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM documents)")
def running_cut(spark, sf):
    return budget.running_cut(table(spark, sf, "documents").select("doc_id", "source", "n_chars"), "source", ["doc_id"], "n_chars", 12_000)


_NEAR_ALL = """
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
"""


def _questions(spark, sf, which):
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return v.where(which).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), v


@query(_NEAR_ALL + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10")
def similarity_top_k_all(spark, sf):
    return retrieval.nearest(*_questions(spark, sf, "vec_id % 100 = 0"), 10).drop("v").withColumn("score", F.round("score", 6))


@query(_NEAR_ALL + "SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10 AND score >= 0.2")
def similarity_threshold_all(spark, sf):
    return retrieval.nearest(*_questions(spark, sf, "vec_id % 100 = 0"), 10, 0.2).drop("v").withColumn("score", F.round("score", 6))


_PICK = """, p{n} AS (SELECT * FROM p{m} UNION ALL SELECT query_id, {n}, vec_id FROM (
  SELECT f.query_id, f.vec_id, row_number() OVER (PARTITION BY f.query_id ORDER BY round(0.5 * f.score - 0.5 * max(alike), 9) DESC, f.rank) AS k
  FROM f JOIN l ON l.query_id = f.query_id AND l.vec_id = f.vec_id JOIN p{m} p ON p.query_id = l.query_id AND p.vec_id = l.other
  WHERE NOT EXISTS (SELECT 1 FROM p{m} o WHERE o.query_id = f.query_id AND o.vec_id = f.vec_id) GROUP BY f.query_id, f.vec_id, f.score, f.rank) WHERE k = 1)"""


@query(_NEAR_ALL + """, f AS MATERIALIZED (SELECT r.query_id, r.vec_id, r.rank, r.score, e.embedding::DOUBLE[] AS v FROM r JOIN embeddings e ON e.vec_id = r.vec_id WHERE rank <= 20),
l AS MATERIALIZED (SELECT a.query_id, a.vec_id, b.vec_id AS other, list_cosine_similarity(a.v, b.v) AS alike FROM f a JOIN f b ON a.query_id = b.query_id),
p1 AS (SELECT query_id, 1 AS pick, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * score, 9) DESC, rank) AS k FROM f) WHERE k = 1)""" + "".join(_PICK.format(n=n, m=n - 1) for n in range(2, 11)) + """
SELECT query_id, CAST(pick AS INTEGER) AS rank, vec_id FROM p10""")
def mmr(spark, sf):
    return retrieval.mmr(retrieval.nearest(*_questions(spark, sf, "vec_id % 100 = 0"), 20), 10)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS project, p_partkey % 200 AS src, (3 * p_partkey + p_size) % 200 AS dst FROM part),
n AS (SELECT project, src AS node FROM e UNION SELECT project, dst FROM e),
r AS (SELECT project, src AS node, dst AS seen FROM e UNION SELECT r.project, r.node, e.dst FROM r JOIN e ON e.project = r.project AND e.src = r.seen)
SELECT n.project, n.node, count(r.seen) FILTER (r.seen <> n.node) AS reach FROM n LEFT JOIN r ON r.project = n.project AND r.node = n.node GROUP BY n.project, n.node""")
def reach_counts(spark, sf):
    return graph.reach(tables.part_graph(spark, sf))


@query("""WITH RECURSIVE m AS (SELECT max(p_partkey) + 1 AS n FROM part),
e AS (SELECT p_partkey AS src, (3 * p_partkey + p_size) % n AS dst FROM part, m UNION SELECT p_partkey, (7 * p_partkey + p_size * p_size) % n FROM part, m),
r AS (SELECT src AS node, dst AS seen FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.seen),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT 'net' AS project, n.node, count(r.seen) FILTER (r.seen <> n.node) AS reach FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node""")
def reach_net(spark, sf):
    """Reach in one project of all parts, most of which reach each other."""
    return graph.reach(tables.part_net(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_partkey AS src, 3 * p_partkey + p_size AS dst FROM part),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT src AS node, dst AS seen FROM e UNION SELECT r.node, e.dst FROM r JOIN e ON e.src = r.seen)
SELECT 'all' AS project, n.node, count(r.seen) FILTER (r.seen <> n.node) AS reach FROM n LEFT JOIN r ON r.node = n.node GROUP BY n.node""")
def reach_counts_all(spark, sf):
    return graph.reach(tables.part_chain(spark, sf))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_brand AS project, p_partkey % 200 AS src, (3 * p_partkey + p_size) % 200 AS dst FROM part),
r AS (SELECT project, src AS node, dst AS seen FROM e UNION SELECT r.project, r.node, e.dst FROM r JOIN e ON e.project = r.project AND e.src = r.seen),
c AS (SELECT project, node, count(*) FILTER (seen <> node) AS reach FROM r GROUP BY project, node),
f AS (SELECT * FROM c WHERE reach > 0 AND NOT EXISTS (SELECT 1 FROM e WHERE e.project = c.project AND e.dst = c.node AND e.src <> e.dst))
SELECT project, node, reach FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY reach DESC, node) AS k FROM f) WHERE k = 1""")
def entry_choice(spark, sf):
    edges = tables.part_graph(spark, sf)
    return graph.entry_points(edges, graph.reach(edges))


@query()
def entry_walk(spark, sf):
    edges = tables.part_graph(spark, sf)
    reached = graph.reach(edges)
    return graph.best_first(edges, reached, graph.entry_points(edges, reached))


@query("""WITH w AS (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 2000) / 1800.0)) AS BIGINT) + 1)) AS chunk FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, md5(substr(text, chunk * 1800 + 1, 2000)) AS digest FROM w""")
def chunk_windows(spark, sf):
    return retrieval.windows(table(spark, sf, "documents")).select("doc_id", "chunk", F.md5("text").alias("digest"))


@query()
def chunk_split(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source"), "text")
    return retrieval.chunks(docs).select("source", "chunk", F.length("text").alias("n_chars"))


@query(r"""WITH m AS (SELECT event_id, event_type || ': ' || CASE event_id % 6 WHEN 0 THEN 'Rate_limit exceeded' WHEN 1 THEN 'billing-quota reached, 429' WHEN 2 THEN 'request timed out' WHEN 3 THEN 'context length 40412' WHEN 4 THEN 'error 404' ELSE 'value ' || CAST(user_id AS VARCHAR) END AS message FROM events),
t AS (SELECT event_id, regexp_replace(lower(message), '[_-]', ' ', 'g') AS x FROM m)
SELECT event_id, CASE WHEN regexp_matches(x, '\b(quota|billing)\b') THEN 'quota' WHEN regexp_matches(x, '\b(rate limit(s|ed)?|too many requests|429)\b') THEN 'rate_limit'
  WHEN regexp_matches(x, '\b(api key|authentication|unauthorized|401)\b') THEN 'auth' WHEN regexp_matches(x, '\b(timeout|timed out)\b') THEN 'timeout' WHEN regexp_matches(x, '\bconnection\b') THEN 'connection'
  WHEN regexp_matches(x, '\b(context length|maximum context|max(imum)? length|too long)\b') THEN 'context_length' WHEN regexp_matches(x, '\b(overloaded|529)\b') THEN 'overloaded' WHEN regexp_matches(x, '\b(not found|404)\b') THEN 'not_found' END AS class FROM t""")
def error_classes(spark, sf):
    by = F.col("event_id") % 6
    said = F.when(by == 0, "Rate_limit exceeded").when(by == 1, "billing-quota reached, 429").when(by == 2, "request timed out").when(by == 3, "context length 40412").when(by == 4, "error 404").otherwise(F.concat(F.lit("value "), F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", text.error_class(F.concat_ws(": ", "event_type", said)).alias("class"))


@query(r"""SELECT conv_id, turn, array_to_string(list_filter(x, lambda v, i: list_position(list_transform(x, lambda y: lower(y)), lower(v)) = i), '|') AS remarks FROM (
  SELECT conv_id, turn, regexp_extract_all(text || CASE turn % 3 WHEN 0 THEN ' The code shown is the code Shown, not shown. Not Shown' WHEN 1 THEN ' In these excerpts the code excerpt is' ELSE '' END,
    '(?i)\bthe code (?:shown|shows|provided)\b|\b(?:the|these) (?:code )?excerpts?\b|\bnot shown\b') AS x FROM conversations)""")
def remark_scan(spark, sf):
    more = F.when(F.col("turn") % 3 == 0, " The code shown is the code Shown, not shown. Not Shown").when(F.col("turn") % 3 == 1, " In these excerpts the code excerpt is").otherwise("")
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.remarks(F.concat("text", more)), "|").alias("remarks"))


@query("SELECT DISTINCT p_type, replace(replace(replace(lower(p_type || ' and-' || p_name), '-', '_'), ' ', '_'), '_and_', '_') AS key FROM part")
def section_keys(spark, sf):
    return table(spark, sf, "part").select("p_type", text.section_key(F.concat("p_type", F.lit(" and-"), "p_name")).alias("key")).distinct()


@query("SELECT doc_id, length(text) // 4 AS tokens, md5(split_part(trim(text), chr(10) || chr(10), 1)) AS first FROM documents")
def document_heads(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.token_estimate("text").alias("tokens"), F.md5(text.first_paragraph("text")).alias("first"))


_FLAWS = """
WITH p AS (SELECT p_partkey AS diagram_id, p_partkey % 3 AS t, p_size AS s, p_partkey AS k FROM part)
"""


@query(_FLAWS + """
SELECT diagram_id, 'syntax_header' AS rule, CAST(count(*) AS BIGINT) AS n FROM p WHERE s % 10 = 0 GROUP BY diagram_id
UNION ALL SELECT diagram_id, 'empty_diagram', 1 FROM p WHERE s % 11 = 0
UNION ALL SELECT diagram_id, 'graph_direction', 1 FROM p WHERE t = 0 AND s % 10 <> 0 AND s % 4 = 0
UNION ALL SELECT diagram_id, 'quote_escaping', 1 FROM p WHERE t = 0 AND s % 11 <> 0 AND s % 7 <> 0
UNION ALL SELECT diagram_id, 'node_id_format', 1 FROM p WHERE t = 0 AND s % 11 <> 0 AND s % 5 = 0
UNION ALL SELECT diagram_id, 'edge_syntax', 1 FROM p WHERE t = 0 AND s % 11 <> 0 AND s % 7 = 0
UNION ALL SELECT diagram_id, 'node_definition', 1 FROM p WHERE t = 0 AND s % 11 <> 0
UNION ALL SELECT diagram_id, 'class_declaration', 1 FROM p WHERE t = 1 AND s % 11 <> 0 AND s % 6 = 0
UNION ALL SELECT diagram_id, 'participant_references', 1 FROM p WHERE t = 2 AND s % 11 <> 0
""")
def rule_issues(spark, sf):
    found = rules.validate(tables.diagram_lines(spark, sf))
    return found.groupBy("diagram_id", "rule").agg(F.count("*").alias("n"))


@query(_FLAWS + """, k AS (SELECT *, CASE t WHEN 0 THEN 'architecture' WHEN 1 THEN 'class' ELSE 'sequence' END AS kind, s % 11 <> 0 AS body FROM p),
i AS (SELECT diagram_id, 'syntax_header' AS rule, 'error' AS severity, 1 AS line_no, 'first line opens no diagram of type ' || kind AS message FROM k WHERE s % 10 = 0
  UNION ALL SELECT diagram_id, 'empty_diagram', 'error', NULL, 'nothing follows the first line' FROM k WHERE NOT body
  UNION ALL SELECT diagram_id, 'graph_direction', 'warning', 1, 'none of TD, TB, LR, RL, BT' FROM k WHERE t = 0 AND s % 10 <> 0 AND s % 4 = 0
  UNION ALL SELECT diagram_id, 'quote_escaping', 'error', 4, 'a quoted label holds a quote' FROM k WHERE t = 0 AND body AND s % 7 <> 0
  UNION ALL SELECT diagram_id, 'node_id_format', 'error', 3, 'a digit begins the node name 9x' FROM k WHERE t = 0 AND body AND s % 5 = 0
  UNION ALL SELECT diagram_id, 'edge_syntax', 'error', 4, 'no known connector between the nodes' FROM k WHERE t = 0 AND body AND s % 7 = 0
  UNION ALL SELECT diagram_id, 'node_definition', 'warning', NULL, 'edges to nodes without a label: ' || CASE WHEN s % 5 = 0 THEN '9x, ' ELSE '' END || 'b' || s FROM k WHERE t = 0 AND body
  UNION ALL SELECT diagram_id, 'class_declaration', 'error', 2, 'a class without a name' FROM k WHERE t = 1 AND body AND s % 6 = 0
  UNION ALL SELECT diagram_id, 'participant_references', 'warning', NULL, 'messages of undeclared participants: q' || s FROM k WHERE t = 2 AND body),
o AS (SELECT *, row_number() OVER (PARTITION BY diagram_id ORDER BY rule, line_no NULLS FIRST, message) AS nth FROM i),
a AS (SELECT diagram_id, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) AS n, string_agg(message, '; ' ORDER BY nth) FILTER (nth <= 3) AS s FROM o GROUP BY diagram_id)
SELECT p.diagram_id, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, coalesce(errors, 0) = 0 AS valid, coalesce(a.s, '') || CASE WHEN n > 3 THEN ' and ' || (n - 3) || ' more' ELSE '' END AS summary FROM p LEFT JOIN a USING (diagram_id)""")
def rule_verdicts(spark, sf):
    lines = tables.diagram_lines(spark, sf)
    return rules.verdicts(lines, rules.validate(lines))


def _facts(spark, sf, *groups):
    """Facts of the derived modules, written once: several joins read them."""
    return kept(facts.facts(tables.modules(spark, sf), *groups), "facts", by="kind")


_MODULES = """
WITH p AS (SELECT p_brand AS project, p_partkey AS k, (p_partkey * 3 + p_size) % 200 AS o, 'pkg' || CAST(p_partkey % 5 AS VARCHAR) || '.m' || CAST(p_partkey AS VARCHAR) AS module, p_name AS n FROM part)
"""


@query(_MODULES + """
SELECT project, module, 'Thing' || CAST(k AS VARCHAR) AS name, 'class' AS what, 'A ' || n || '.' AS docstring, 'Thing' || CAST(o AS VARCHAR) AS parent FROM p
UNION ALL SELECT project, module, 'helper' || CAST(k AS VARCHAR), 'function', '', NULL FROM p""")
def code_entities(spark, sf):
    found = facts.of_kind(facts.facts(tables.modules(spark, sf), "entities"), "entity")
    return found.select("project", "module", "name", F.col("flags").alias("what"), F.col("value").alias("docstring"), F.col("owner").alias("parent"))


@query(_MODULES + """, t AS (SELECT p.*, 'pkg' || CAST(o % 5 AS VARCHAR) || '.m' || CAST(o AS VARCHAR) AS target FROM p)
SELECT t.project, t.module, x.target FROM t LEFT JOIN (SELECT DISTINCT a.project, a.module, a.target FROM t a JOIN p b ON a.project = b.project AND a.target = b.module WHERE a.module <> a.target) x USING (project, module)""")
def module_imports(spark, sf):
    files = tables.modules(spark, sf)
    rows = facts.of_kind(_facts(spark, sf, "imports"), "import").select("project", "module", "is_package", F.col("name").alias("imported"))
    placed = names.place_imports(rows, files.select("project", "module"), ("project",)).where("kind = 'internal' and target <> module").select("project", "module", "target").distinct()
    return files.select("project", "module").join(placed, ["project", "module"], "left")


@query(_MODULES + """, b AS (SELECT a.project, a.module || '.Thing' || CAST(a.k AS VARCHAR) AS cls, 'Thing' || CAST(a.o AS VARCHAR) AS base, c.module || '.Thing' || CAST(a.o AS VARCHAR) AS full_base, c.k IS NOT NULL AS inside, a.* EXCLUDE (project) FROM p a LEFT JOIN p c ON c.project = a.project AND c.k = a.o)
SELECT project, module || '.Thing' || CAST(k AS VARCHAR) || '.run' AS caller, module || '.helper' || CAST(k AS VARCHAR) AS callee, TRUE AS is_internal FROM p
UNION ALL SELECT project, cls || '.run', 'stop', FALSE FROM b
UNION ALL SELECT project, cls || '.run', cls || '.step', TRUE FROM b
UNION ALL SELECT project, cls || '.step', CASE WHEN inside THEN full_base ELSE base END, inside FROM b
UNION ALL SELECT project, module || '.helper' || CAST(k AS VARCHAR), 'getcwd', FALSE FROM p""")
def call_edges(spark, sf):
    return calls.call_edges(_facts(spark, sf, *calls.GROUPS)).drop("ord", "named").distinct()


@query(_MODULES.replace("WITH p", "WITH RECURSIVE p") + """, b AS (SELECT project, k, o, module || '.Thing' || CAST(k AS VARCHAR) AS cls FROM p),
w AS (SELECT project, cls, CAST(0 AS INTEGER) AS ord, cls AS base, o, [cls] AS path FROM b
  UNION ALL SELECT w.project, w.cls, w.ord + 1, b.cls, b.o, list_append(path, b.cls) FROM w JOIN b ON b.project = w.project AND b.k = w.o WHERE NOT list_contains(path, b.cls))
SELECT project, cls, ord, base FROM w""")
def class_lineage(spark, sf):
    rows = _facts(spark, sf, "entities", "imports")
    defined = calls.definitions(rows)
    return calls.lineage(calls.class_bases(rows, defined, calls.aliases(rows)))


@query(_MODULES + """
SELECT project, module, module || '.Thing' || CAST(k AS VARCHAR) AS full_name, 'outline' AS kind, md5('class Thing' || k || '(Thing' || o || '):' || chr(10) || '    \"\"\"A ' || n || '.\"\"\"' || chr(10) || '    def run(self, other: Thing' || o || '): ...' || chr(10) || '    def step(self): ...') AS digest, FALSE AS env FROM p
UNION ALL SELECT project, module, module || '.Thing' || CAST(k AS VARCHAR) || '.run', 'excerpt', md5('    def run(self, other: Thing' || o || '):' || chr(10) || '        helper' || k || '()' || chr(10) || '        other.stop()' || chr(10) || '        return self.step()'), FALSE FROM p
UNION ALL SELECT project, module, module || '.Thing' || CAST(k AS VARCHAR) || '.step', 'excerpt', md5('    def step(self):' || chr(10) || '        return Thing' || o || '()'), FALSE FROM p
UNION ALL SELECT project, module, module || '.helper' || CAST(k AS VARCHAR), 'excerpt', md5('def helper' || k || '():' || chr(10) || '    return os.getcwd()'), FALSE FROM p""")
def code_excerpts(spark, sf):
    found = facts.facts(tables.modules(spark, sf), "texts").where("kind in ('outline', 'excerpt')")
    return found.select("project", "module", F.concat_ws(".", "module", "name").alias("full_name"), "kind", F.md5("value").alias("digest"), (F.coalesce("flags", F.lit("")) == "env").alias("env"))


@query(_MODULES + """, t AS (SELECT project, module AS source, CAST(k AS VARCHAR) AS k, CAST(o AS VARCHAR) AS o, 'pkg' || CAST(o % 5 AS VARCHAR) || '.m' || CAST(o AS VARCHAR) AS target, n, chr(10) AS nl, repeat('"', 3) AS q FROM p)
SELECT project, source, -1 AS ord, concat('File: ', source, nl, q, n, '.', q, nl, 'import os', nl, 'from ', target, ' import Thing', o, nl, nl, nl, 'class Thing', k, '(Thing', o, '):', nl, '    ', q, 'A ', n, '.', q, nl, nl,
  '    def run(self, other: Thing', o, '):', nl, '        helper', k, '()', nl, '        other.stop()', nl, '        return self.step()', nl, nl, '    def step(self):', nl, '        return Thing', o, '()', nl, nl, nl, 'def helper', k, '():', nl, '    return os.getcwd()', nl) AS text FROM t
UNION ALL SELECT project, source, 3, concat('Class: Thing', k, nl, 'File: ', source, nl, 'Lines: 6-15', nl, 'Base: Thing', o, nl, 'Methods: run, step', nl, 'Docstring: A ', n, '.') FROM t
UNION ALL SELECT project, source, 4, concat('Function: helper', k, nl, 'File: ', source, nl, 'Lines: 18-19') FROM t""")
def code_documents(spark, sf):
    files = tables.modules(spark, sf)
    return structure.documents(_facts(spark, sf, "entities"), files)


@query(_MODULES + r""", t AS (SELECT project, module AS path, k, o, 'pkg' || CAST(o % 5 AS VARCHAR) || '.m' || CAST(o AS VARCHAR) AS target, n, chr(10) AS nl, repeat('"', 3) AS q FROM p),
d AS (SELECT project, path, 'all' AS part, sha256(concat(q, n, '.', q, nl, 'import os', nl, 'from ', target, ' import Thing', o, nl, nl, nl, 'class Thing', k, '(Thing', o, '):', nl, '    ', q, 'A ', n, '.', q, nl, nl,
    '    def run(self, other: Thing', o, '):', nl, '        helper', k, '()', nl, '        other.stop()', nl, '        return self.step()', nl, nl, '    def step(self):', nl, '        return Thing', o, '()', nl, nl, nl, 'def helper', k, '():', nl, '    return os.getcwd()', nl)) AS digest FROM t
  UNION ALL SELECT project, path, 'imports', sha256(concat('os', nl, target, '.Thing', o)) FROM t
  UNION ALL SELECT project, path, 'entities', sha256(concat('Thing', k, chr(0), 'class', chr(0), 'A ', n, '.', nl, 'helper', k, chr(0), 'function', chr(0))) FROM t),
g AS (SELECT project, part, substr(md5(path), 1, 2) AS g, sha256(string_agg(path || chr(0) || digest, chr(10) ORDER BY path)) AS d FROM d GROUP BY ALL),
w AS (SELECT project, part, string_agg(g || chr(0) || d, chr(10) ORDER BY g) AS files FROM g GROUP BY ALL)
SELECT project, section, sha256(concat_ws(chr(0), 'model-a', 'Write about ' || section, 'length=2', files)) AS key_hash
FROM w JOIN (VALUES ('overview', 'all'), ('dependencies', 'imports'), ('key classes', 'entities')) AS s(section, part) USING (part)""")
def section_cache_keys(spark, sf):
    """What each section's cached text is valid for: model, prompt, settings, and contents, imports or entities of the project's files."""
    files = tables.modules(spark, sf)
    parts = incremental.part_digests(files, _facts(spark, sf, "entities", "imports"))
    kinds = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(p).alias("part")) for s, p in (("overview", "all"), ("dependencies", "imports"), ("key classes", "entities"))])
    asked = files.select("project").distinct().select("project", F.explode(kinds).alias("s")).select("project", "s.section", "s.part")
    asked = asked.withColumns({"model": F.lit("model-a"), "prompt": F.concat(F.lit("Write about "), "section"), "settings": F.lit("length=2")})
    return incremental.section_hashes(asked, parts)


@query()
def section_contexts(spark, sf):
    rows = facts.facts(tables.modules(spark, sf), "texts").where("kind = 'outline'")
    return structure.section_context(rows.select("project", F.struct("module", "ord").alias("ord"), "name", F.col("value").alias("text")))


@query(_MODULES + """, t AS (SELECT p.*, 'pkg' || CAST(o % 5 AS VARCHAR) AS head, 'pkg' || CAST(o % 5 AS VARCHAR) || '.m' || CAST(o AS VARCHAR) AS target FROM p)
SELECT t.project, t.module, t.target || '.Thing' || CAST(t.o AS VARCHAR) AS names FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.project = t.project AND p.module = t.target)""")
def third_party_map(spark, sf):
    files = tables.modules(spark, sf)
    return structure.third_party(_facts(spark, sf, "imports"), files)


@query(_MODULES + """, u AS (SELECT a.project, c.module || '.Thing' || CAST(c.k AS VARCHAR) AS cls, count(*) AS users FROM p a JOIN p c ON c.project = a.project AND c.k = a.o AND c.k <> a.k GROUP BY ALL)
SELECT project, cls, users FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY users DESC, cls) AS nth FROM u) WHERE nth <= 10""")
def most_used_classes(spark, sf):
    rows = _facts(spark, sf, *calls.GROUPS)
    return structure.most_used_classes(calls.call_edges(rows), calls.definitions(rows).where("what = 'class'"))


_TOP = """, d AS (SELECT project, node, count(*) AS n FROM (SELECT project, src AS node FROM e UNION ALL SELECT project, dst FROM e) GROUP BY ALL),
top AS (SELECT project, node FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, node) AS nth FROM d) WHERE nth <= 50),
kept AS (SELECT e.* FROM e JOIN top a ON a.project = e.project AND a.node = src JOIN top b ON b.project = e.project AND b.node = dst),
note AS (SELECT project, 9 AS s, '' AS a, '' AS b, '' AS c, '    truncation_notice["the 50 most connected nodes"]' AS line FROM d GROUP BY project HAVING count(*) > 50)
"""


@query(_MODULES + """, e AS (SELECT DISTINCT a.project, a.module AS src, c.module AS dst FROM p a JOIN p c ON c.project = a.project AND c.k = a.o AND c.k <> a.k)""" + _TOP.replace("d AS (", "x AS (").replace("\ntop AS", "\nd AS (SELECT p.project, p.module AS node, coalesce(x.n, 0) AS n FROM p LEFT JOIN x ON x.project = p.project AND x.node = p.module),\ntop AS") + """,
g AS (SELECT project, node, split_part(node, '.', 1) AS grp FROM top),
l AS (SELECT project, 0 AS s, '' AS a, '' AS b, '' AS c, 'graph TD' AS line FROM d
  UNION SELECT project, 1, grp, '0', '', '    subgraph ' || grp || '__group["' || grp || '"]' FROM g
  UNION SELECT project, 1, grp, '1', node, '        ' || replace(node, '.', '_') || '["' || split_part(node, '.', 2) || '"]' FROM g
  UNION SELECT project, 1, grp, '2', '', '    end' FROM g
  UNION SELECT project, 2, src, dst, '', '    ' || replace(src, '.', '_') || ' --> ' || replace(dst, '.', '_') FROM kept
  UNION SELECT * FROM note)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY s, a, b, c, line) AS INTEGER) AS ord, line FROM l""")
def architecture_diagram(spark, sf):
    files = tables.modules(spark, sf)
    edges = module_imports(spark, sf).where("target is not null").select("project", F.col("module").alias("src"), F.col("target").alias("dst"))
    groups = files.select("project", F.col("module").alias("node"), F.regexp_replace("module", r"\.[^.]+$", "").alias("group"))
    return diagrams.grouped_graph(edges, groups, nodes=files.select("project", F.col("module").alias("node")))


@query(_MODULES + """, x AS (SELECT DISTINCT a.project, 'pkg' || CAST(a.k % 5 AS VARCHAR) AS src, 'pkg' || CAST(a.o % 5 AS VARCHAR) AS dst, c.k IS NULL AS outside FROM p a LEFT JOIN p c ON c.project = a.project AND c.k = a.o WHERE a.k % 5 <> a.o % 5),
e AS (SELECT DISTINCT project, src, dst FROM x)""" + _TOP + """,
o AS (SELECT DISTINCT project, dst AS node FROM x WHERE outside),
t AS (SELECT top.*, o.node IS NOT NULL AS outside FROM top LEFT JOIN o USING (project, node)),
l AS (SELECT project, 0 AS s, '' AS a, '' AS b, '' AS c, 'graph LR' AS line FROM e
  UNION SELECT project, 1, node, '', '', '        ' || node || '["' || node || '"]' FROM t WHERE NOT outside
  UNION SELECT project, 2, '0', '', '', '    subgraph third_party["Third-party"]' FROM t WHERE outside
  UNION SELECT project, 2, '1', node, '', '        ' || node || '["' || node || '"]' FROM t WHERE outside
  UNION SELECT project, 2, '2', '', '', '    end' FROM t WHERE outside
  UNION SELECT project, 3, src, dst, '', '    ' || src || ' --> ' || dst FROM kept
  UNION SELECT * FROM note)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY s, a, b, c, line) AS INTEGER) AS ord, line FROM l""")
def dependency_diagram(spark, sf):
    files = tables.modules(spark, sf)
    rows = facts.of_kind(_facts(spark, sf, "imports"), "import").select("project", "module", "is_package", F.col("name").alias("imported"))
    placed = names.place_imports(rows, files.select("project", "module"), ("project",))
    return diagrams.dependency(xref.package_edges(placed, files))


@query(_MODULES + """, f AS (SELECT project, 'Thing' || CAST(k AS VARCHAR) AS id, 'Thing' || CAST(o AS VARCHAR) AS base, row_number() OVER (PARTITION BY project ORDER BY module, 'Thing' || CAST(k AS VARCHAR)) AS r FROM p),
l AS (SELECT DISTINCT project, 0 AS s, 0 AS r, 0 AS a, 'classDiagram' AS line FROM p
  UNION ALL SELECT project, 1, r, 0, '    class ' || id || ' {' FROM f WHERE r <= 20
  UNION ALL SELECT project, 1, r, 1, '        +run()' FROM f WHERE r <= 20
  UNION ALL SELECT project, 1, r, 2, '        +step()' FROM f WHERE r <= 20
  UNION ALL SELECT project, 1, r, 3, '    }' FROM f WHERE r <= 20
  UNION ALL SELECT project, 2, r, 0, '    ' || base || ' <|-- ' || id FROM f
  UNION ALL SELECT project, 9, 0, 0, '    note "the first 20 classes"' FROM f GROUP BY project HAVING count(*) >= 20)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY s, r, a) AS INTEGER) AS ord, line FROM l""")
def class_diagrams(spark, sf):
    rows = _facts(spark, sf, "entities")
    methods = facts.of_kind(rows, "method").groupBy("project", "module", F.col("owner").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col("name").alias("m")))), lambda x: x["m"]).alias("methods"))
    found = facts.of_kind(rows, "entity").where("flags = 'class'").select("project", "module", "name", F.col("owner").alias("base"))
    found = found.join(methods, ["project", "module", "name"], "left").withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))
    return diagrams.class_diagram(found.withColumn("ord", F.col("module")), 20)


_TREES = """
WITH p AS (SELECT 'tree' || CAST(p_partkey // 50 AS VARCHAR) AS project, CAST(p_partkey % 50 AS INTEGER) AS j FROM part),
t AS (SELECT p.*, l.j AS a, r.j AS b, 'app.m' || p.j || '.' AS m, 'app.m' || l.j || '.Part' || l.j AS pa, 'app.m' || r.j || '.build' || r.j AS bb, 'app.m' || r.j || '.Part' || r.j AS pb, 2 * p.j + 1 AS na, 2 * p.j + 2 AS nb
  FROM p LEFT JOIN p l ON l.project = p.project AND l.j = 2 * p.j + 1 LEFT JOIN p r ON r.project = p.project AND r.j = 2 * p.j + 2),
c AS (SELECT project, m || 'Part' || j || '.__init__' AS caller, coalesce(pa, 'Part' || na) AS named FROM t WHERE j % 2 = 0
  UNION SELECT project, m || 'Part' || j || '.run', m || 'Part' || j || '.check' FROM t WHERE j % 2 = 0
  UNION SELECT project, m || 'Part' || j || '.run', coalesce(pa || '.run', 'run') FROM t
  UNION SELECT project, m || 'Part' || j || '.run', coalesce(bb, 'build' || nb) FROM t WHERE j % 2 = 0
  UNION SELECT project, m || 'Part' || j || '.run', coalesce(pb || '.run', 'run') FROM t WHERE j % 2 = 0
  UNION SELECT project, m || 'Part' || j || '.run', m || 'helper' || j FROM t WHERE j % 2 = 1
  UNION SELECT project, m || 'build' || j, m || 'Part' || j FROM t)
"""


def _tree_facts(spark, sf):
    rows = kept(facts.facts(tables.part_trees(spark, sf).drop("j"), *calls.GROUPS), "facts", by="kind")
    defined = calls.definitions(rows)
    return kept(calls.call_edges(rows), "edges"), defined, calls.lineage(calls.class_bases(rows, defined, calls.aliases(rows)))


_SETS = """
WITH p AS (SELECT p_partkey // 50 AS g, p_partkey AS k, (p_partkey % 50 * 7 + p_size) % 50 + p_partkey // 50 * 50 AS o, p_size % 10 AS shape FROM part),
t AS (SELECT p.*, q.k IS NOT NULL AS i, q.o AS o2, r.k IS NOT NULL AS i2, 'app.m' || p.k || '.' AS m, 'app.m' || p.o || '.Part' || p.o AS other, 'app.m' || p.k || '.Part' || p.k AS own, 'app.m' || p.o || '.build' AS made, 'app.m' || q.o || '.Part' || q.o AS third
  FROM p LEFT JOIN p q ON q.k = p.o LEFT JOIN p r ON r.k = q.o),
c AS (SELECT g, m || 'use' AS caller, CASE WHEN i THEN other || '.start' ELSE 'start' END AS named FROM t WHERE shape = 0
  UNION SELECT g, m || 'use', unnest([CASE WHEN i THEN other || '.start' ELSE 'start' END, CASE WHEN i THEN other || '.stop' ELSE 'stop' END, CASE WHEN i AND o <> k THEN 'stop' ELSE own || '.stop' END]) FROM t WHERE shape = 1
  UNION SELECT g, m || 'use', unnest(['make', 'stop', 'start']) FROM t WHERE shape = 2
  UNION SELECT g, m || 'use', unnest(CASE WHEN i THEN [made, other || '.again', other || '.stop', other || '.start'] ELSE ['make', 'again', 'stop', 'start'] END) FROM t WHERE shape = 3
  UNION SELECT g, m || 'Box.__init__', CASE WHEN i THEN made ELSE 'make' END FROM t WHERE shape = 4
  UNION SELECT g, m || 'Box.use', unnest([CASE WHEN i THEN other || '.start' ELSE 'start' END, CASE WHEN i AND i2 THEN third || '.stop' ELSE 'stop' END]) FROM t WHERE shape = 4
  UNION SELECT g, m || 'use', unnest([CASE WHEN i THEN other ELSE 'P' END, own, CASE WHEN i AND o <> k THEN 'start' ELSE own || '.start' END]) FROM t WHERE shape = 5
  UNION SELECT g, m || 'use', unnest(['make', 'start']) FROM t WHERE shape = 6
  UNION SELECT g, m || 'Kid.start', unnest([CASE WHEN i THEN other || '.start' ELSE 'start' END, CASE WHEN i THEN other || '.stop' ELSE 'stop' END, CASE WHEN i AND i2 THEN third || '.start' ELSE 'start' END]) FROM t WHERE shape = 7
  UNION SELECT g, m || 'use', unnest([CASE WHEN i THEN made ELSE 'build' END, CASE WHEN i THEN other || '.stop' ELSE 'stop' END, 'nothing']) FROM t WHERE shape = 8
  UNION SELECT g, m || 'use', unnest([m || 'fetch', 'inner']) FROM t WHERE shape = 9
  UNION SELECT g, m || 'use.inner', unnest([CASE WHEN i THEN other || '.stop' ELSE 'stop' END, 'make']) FROM t WHERE shape = 9)
"""


@query(_SETS + "SELECT 'set' || CAST(g AS VARCHAR) AS project, caller, named, contains(named, '.') AS is_internal FROM c")
def shaped_calls(spark, sf):
    """Calls of modules in ten shapes: names from names, unions, shadows, results, receivers, rebinding, inheritance, modules, closures."""
    rows = kept(facts.facts(tables.shaped_modules(spark, sf), *calls.GROUPS), "facts", by="kind")
    return calls.call_edges(rows).select("project", "caller", "named", "is_internal").distinct()


@query(_TREES + "SELECT project, caller, named, contains(named, '.') AS is_internal FROM c")
def tree_calls(spark, sf):
    """Calls through attributes, constructors, annotated results, super() and functions of other modules."""
    return _tree_facts(spark, sf)[0].select("project", "caller", "named", "is_internal")


@query(_TREES + """, e AS (SELECT project, caller AS src, named AS dst FROM c WHERE contains(named, '.'))""" + _TOP + """,
g AS (SELECT project, node, 'app.' || split_part(node, '.', 2) AS grp, replace(node, '.', '_') AS id FROM top),
l AS (SELECT project, 0 AS s, '' AS a, '' AS b, '' AS c, 'graph TD' AS line FROM e
  UNION SELECT project, 1, grp, '0', '', '    subgraph ' || replace(grp, '.', '_') || '__group["' || grp || '"]' FROM g
  UNION SELECT project, 1, grp, '1', node, '        ' || regexp_replace(id, '_+', '_', 'g').rtrim('_') || '["' || substr(node, length(grp) + 2) || '"]' FROM g
  UNION SELECT project, 1, grp, '2', '', '    end' FROM g
  UNION SELECT project, 2, src, dst, '', '    ' || regexp_replace(replace(src, '.', '_'), '_+', '_', 'g').rtrim('_') || ' --> ' || replace(dst, '.', '_') FROM kept
  UNION SELECT * FROM note)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY s, a, b, c, line) AS INTEGER) AS ord, line FROM l""")
def call_graph_diagram(spark, sf):
    """Traced calls between functions, each in the subgraph of its module."""
    files = tables.part_trees(spark, sf)
    edges = _tree_facts(spark, sf)[0].where(F.contains("named", F.lit("."))).select("project", F.col("caller").alias("src"), F.col("named").alias("dst"))
    ends = edges.select("project", F.explode(F.array("src", "dst")).alias("node"))
    groups = names.longest_prefix(ends, files.select("project", F.col("module").alias("known")), "node", ("project",)).withColumnRenamed("match", "group")
    return diagrams.grouped_graph(edges, groups)


_PLANS = _TREES + """, n AS (SELECT project, count(*) AS n FROM p GROUP BY project),
d AS (SELECT * FROM (VALUES (2, 1, 1, 0, 1, 'run'), (3, 2, 1, 0, 2, 'Part2'), (3, 3, 1, 0, 2, 'run'), (6, 4, 2, 2, 5, 'run'), (7, 5, 2, 2, 6, 'Part6'), (7, 6, 2, 2, 6, 'run')) AS v(needs, ord, level, s, r, label)),
s AS (SELECT project, ord, level, 'app.m' || s || '.Part' || s AS sender, 'app.m' || r || '.Part' || r AS receiver, label, s, r, needs, n FROM n JOIN d ON n >= needs)
"""


@query(_PLANS + """SELECT project, 'classes' AS kind, ord, level, sender, receiver, label, FALSE AS truncated FROM s
UNION ALL SELECT project, 'functions', 1, 1, 'app.m0.Part0.run', 'app.m0.Part0.check', 'check', FALSE FROM n WHERE n = 1""")
def project_sequences(spark, sf):
    """The messages of each project from the method that reaches most; classes inherited from take no part of their own."""
    edges, defined, order = _tree_facts(spark, sf)
    return sequence.project_plan(edges, defined, order)


@query(_PLANS + """, x AS (SELECT project, 0 AS k, 0 AS o, 0 AS z, 'sequenceDiagram' AS line FROM s
  UNION SELECT project, 1, min(o), 0, '    participant app_m' || w || '_Part' || w || ' as Part' || w FROM (SELECT project, 2 * ord AS o, s AS w FROM s UNION ALL SELECT project, 2 * ord + 1, r FROM s) GROUP BY project, w
  UNION SELECT project, 2, ord, 0, '    app_m' || s || '_Part' || s || CASE WHEN ord = 3 AND n >= 6 THEN '->>+' ELSE '->>' END || 'app_m' || r || '_Part' || r || ': ' || label || '()' FROM s
  UNION SELECT project, 2, max(ord), 1, '    deactivate app_m2_Part2' FROM s WHERE level = 2 GROUP BY project)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY k, o, z) AS INTEGER) AS ord, line FROM x WHERE project IN (SELECT project FROM n WHERE n > 1)""")
def sequence_diagrams(spark, sf):
    """Sequence diagrams of ``project_sequences`` where participants are classes."""
    edges, defined, order = _tree_facts(spark, sf)
    plan = kept(sequence.project_plan(edges, defined, order).where("kind = 'classes'"), "plan")
    modules = tables.part_trees(spark, sf).select("project", F.col("module").alias("known"))
    classes = defined.where("what = 'class'").select("project", F.col("qualified").alias("name"))
    return diagrams.sequence_diagram(plan, diagrams.participant_labels(plan, modules, classes))


@query()
def section_excerpts(spark, sf):
    """For each section of a project's documentation, the excerpts that it is given, in order."""
    files = kept(tables.part_trees(spark, sf).drop("j"), "files")
    rows = kept(facts.facts(files), "facts", by="kind")
    defined = kept(calls.definitions(rows), "defined")
    order = kept(calls.lineage(calls.class_bases(rows, defined, calls.aliases(rows))), "order")
    return sections.contexts(sections.candidates(rows, files, kept(calls.call_edges(rows), "edges"), defined, order))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")
def page_sanitize(spark, sf):
    """Text of pages without scripts, styles, comments and tags."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), "<[^>]*>", " ")
    return table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(bare, r"\s+", " ")).alias("text"))
