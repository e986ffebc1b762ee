"""Registered queries over the catalogue of repositories, chunks and symbols: dimensions, listings, headers, graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.retrieval import usable_vector
from tessera.plans.registering import book
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL, query = book()

_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at)"
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"


@query(f"SELECT coalesce(len(embedding), -1)::INT AS dimension, count(*) AS n, count(*) FILTER (WHERE {_USABLE}) AS usable FROM {_CHUNKS} GROUP BY 1")
def vector_dimensions(spark, root):
    """SC15, SC18, F10: vectors per dimension, and those that can be compared; -1 stands for none."""
    size = F.coalesce(F.when(F.col("embedding").isNotNull(), F.size("embedding")), F.lit(-1))
    rows = distinct_chunks(spark, root, size.alias("dimension"), F.coalesce(usable_vector(F.col("embedding")), F.lit(False)).alias("good"))
    return rows.groupBy("dimension").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("usable"))


@query("""SELECT r.full_name, c.files, c.made, c.commit_sha IS NULL AS no_commit FROM repos r LEFT JOIN (SELECT repo_id, count(DISTINCT file_id) AS files, max(created_at AT TIME ZONE 'UTC') AS made, max(commit_sha) AS commit_sha FROM code_chunks WHERE repo_id IS NOT NULL GROUP BY 1) c USING (repo_id)""")
def index_listing(spark, root):
    """SC16, A30: every repository with what is indexed of it and when last."""
    chunks = table(spark, root, "code_chunks").where("repo_id IS NOT NULL").groupBy("repo_id")
    chunks = chunks.agg(F.count_distinct("file_id").alias("files"), F.max(F.col("created_at").cast("timestamp_ntz")).alias("made"), F.max("commit_sha").alias("commit_sha"))
    rows = table(spark, root, "repos").select("repo_id", "full_name").join(chunks, "repo_id", "left")
    return rows.select("full_name", "files", "made", F.col("commit_sha").isNull().alias("no_commit"))


@query(f"""SELECT chunk_id, concat_ws(' | ', 'file: ' || file_path, 'module: ' || module_name, 'role: ' || nest_role, CASE WHEN len(symbols) > 0 THEN 'symbols: ' || array_to_string(list_transform(symbols, lambda s: s.kind || ' ' || s.name), ', ') END) AS header FROM {_CHUNKS}""")
def enriched_headers(spark, root):
    """The header put before a chunk's text, parts that are null left out."""
    names = F.array_join(F.transform("symbols", lambda s: F.concat_ws(" ", s["kind"], s["name"])), ", ")
    part = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(label), value))
    header = F.concat_ws(" | ", part("file: ", F.col("file_path")), part("module: ", F.col("module_name")), part("role: ", F.col("nest_role")), F.when(F.size("symbols") > 0, F.concat(F.lit("symbols: "), names)))
    return distinct_chunks(spark, root, "file_path", "module_name", "nest_role", "symbols").select("chunk_id", header.alias("header"))


@query(f"""WITH c AS (SELECT chunk_id, file_id, unnest(list_distinct(regexp_extract_all(content, '(\\w+)\\(', 1))) AS name FROM {_CHUNKS}), d AS (SELECT DISTINCT k.file_id, s.name, s.chunk_id AS home FROM symbols s JOIN {_CHUNKS} k USING (chunk_id) WHERE s.kind IN ('function', 'method'))
 SELECT c.chunk_id AS caller, d.home AS callee, c.name FROM c JOIN d ON d.file_id = c.file_id AND d.name = c.name WHERE d.home <> c.chunk_id""")
def call_edges(spark, root):
    """Calls from a chunk to functions that other chunks of its file define; an equi-join on file and name."""
    # names leave the scan, texts don't
    chunks = distinct_chunks(spark, root, "file_id", F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\w+)\("), F.lit(1))).alias("names"))
    called = chunks.select(F.col("chunk_id").alias("caller"), "file_id", F.explode("names").alias("name"))
    symbols = table(spark, root, "symbols").where(F.col("kind").isin("function", "method")).select(F.col("chunk_id").alias("callee"), "name")
    defined = symbols.join(chunks.select(F.col("chunk_id").alias("callee"), "file_id"), "callee").distinct()
    return called.join(defined, ["file_id", "name"]).where("caller != callee").select("caller", "callee", "name")


@query(f"""WITH f AS (SELECT DISTINCT file_id FROM code_chunks), s AS (SELECT s.node_id, s.kind, c.file_id FROM symbols s JOIN {_CHUNKS} c USING (chunk_id)), i AS (SELECT DISTINCT file_id, target_path FROM imports)
 SELECT 'node' AS what, 'file' AS kind, count(*) AS n FROM f UNION ALL SELECT 'node', kind, count(*) FROM s GROUP BY kind UNION ALL SELECT 'edge', 'DEFINES', count(*) FROM s UNION ALL SELECT 'edge', 'IMPORTS', count(*) FROM i""")
def graph_tables(spark, root):
    """G9, SC14: nodes and edges of the property graph in one union, counted by kind."""
    chunks = distinct_chunks(spark, root, "file_id")
    symbols = table(spark, root, "symbols").select("chunk_id", "node_id", "kind").join(chunks, "chunk_id")
    kind = lambda what, name: [F.lit(what).alias("what"), name.alias("kind")]
    rows = chunks.select("file_id").distinct().select(*kind("node", F.lit("file")))
    rows = rows.unionByName(symbols.select(*kind("node", F.col("kind")))).unionByName(symbols.select(*kind("edge", F.lit("DEFINES"))))
    rows = rows.unionByName(table(spark, root, "imports").select("file_id", "target_path").distinct().select(*kind("edge", F.lit("IMPORTS"))))
    return rows.groupBy("what", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT q.request_id, q.status, r.full_name FROM (SELECT DISTINCT ON (request_id) * FROM ai_request_metrics ORDER BY request_id) q LEFT JOIN repos r USING (repo_id) WHERE q.source = 'agent' AND q.status <> 'completed'""")
def open_runs(spark, root):
    """Runs that did not complete, with their repository if it is known."""
    rows = table(spark, root, "ai_request_metrics").where("source = 'agent' AND status != 'completed'").select("request_id", "status", "repo_id").dropDuplicates(["request_id"])
    return rows.join(table(spark, root, "repos").select("repo_id", "full_name"), "repo_id", "left").select("request_id", "status", "full_name")


@query("SELECT org_id, count(*) AS repos, count(*) FILTER (WHERE is_active) AS active, sum(coalesce(n, 0))::BIGINT AS chunks FROM repos LEFT JOIN (SELECT repo_id, count(DISTINCT chunk_id) AS n FROM code_chunks WHERE repo_id IS NOT NULL GROUP BY 1) USING (repo_id) GROUP BY org_id")
def organisations(spark, root):
    """Organisations with their repositories and chunks."""
    sizes = table(spark, root, "code_chunks").where("repo_id IS NOT NULL").groupBy("repo_id").agg(F.count_distinct("chunk_id").alias("n"))
    rows = table(spark, root, "repos").select("repo_id", "org_id", "is_active").join(sizes, "repo_id", "left")
    return rows.groupBy("org_id").agg(F.count(F.lit(1)).alias("repos"), F.count_if("is_active").alias("active"), F.sum(F.coalesce("n", F.lit(0))).alias("chunks"))


@query(f"SELECT DISTINCT file_path, line_start FROM {_CHUNKS} WHERE nest_role = 'service' UNION SELECT DISTINCT file_path, line_start FROM {_CHUNKS} WHERE len(list_filter(imports, lambda i: i.source ILIKE '%.service')) > 0")
def context_union(spark, root):
    """Two sources of context merged, one row per place."""
    rows = distinct_chunks(spark, root, "file_path", "line_start", "nest_role", F.exists("imports", lambda i: i["source"].ilike("%.service")).alias("uses"))
    part = lambda condition: rows.where(condition).select("file_path", "line_start")
    return part("nest_role = 'service'").unionByName(part("uses")).distinct()


@query("""SELECT repo_id, arg_max(commit_sha, (created_at AT TIME ZONE 'UTC')::VARCHAR || chunk_id) AS commit_sha, max(created_at AT TIME ZONE 'UTC') AS made FROM code_chunks WHERE repo_id IS NOT NULL AND commit_sha IS NOT NULL GROUP BY repo_id""")
def last_sync(spark, root):
    """The latest version of a setting by key: here each repository's commit."""
    rows = table(spark, root, "code_chunks").where("repo_id IS NOT NULL AND commit_sha IS NOT NULL").select("repo_id", "commit_sha", "chunk_id", F.col("created_at").cast("timestamp_ntz").alias("made"))
    return rows.groupBy("repo_id").agg(F.max_by("commit_sha", F.struct("made", "chunk_id")).alias("commit_sha"), F.max("made").alias("made"))


@query("""SELECT e.event_type, count(*) AS n, count(*) FILTER (WHERE (props->>'$.k')::INT >= 50) AS high, round(avg(value), 4) AS average, round(min(value), 4) AS least, round(max(value), 4) AS greatest FROM events e GROUP BY e.event_type""")
def event_payloads(spark, root):
    """T8, scalar JSON functions: events with a field of their payload."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, root, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(k >= 50).alias("high"), F.round(F.avg("value"), 4).alias("average"), F.round(F.min("value"), 4).alias("least"), F.round(F.max("value"), 4).alias("greatest")
    )
