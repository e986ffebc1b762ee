"""Registered queries that put smaller operators together: search with fallback, recall, citations, snapshots, graph tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.operators import store
from tessera.plans.graph_queries import edges
from tessera.plans.registering import book
from tessera.plans.retrieval_queries import _CHUNKS, _GOOD, _asked, _tf
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL, query = book()

ASKED = ("ledger", "quiver")
_REQ = "(SELECT DISTINCT ON (request_id) * FROM ai_request_metrics ORDER BY request_id)"
_SHARE = [f"({_tf('text', t)} / ({_tf('text', t)} + 1))" for t in ASKED]


@query(f"""WITH s AS (SELECT doc_id, {' AND '.join(f'{x} > 0' for x in _SHARE)} OR contains(lower(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), 'ledger quiver') OR contains(lower(replace(text, ' ', '')), 'ledgerquiver') AS direct, ({' + '.join(_SHARE)}) / 2 AS whole, greatest({', '.join(_SHARE)}) AS best FROM documents WHERE text IS NOT NULL),
 n AS (SELECT count(*) AS n FROM s WHERE direct), k AS (SELECT doc_id, round(CASE WHEN direct THEN greatest(whole, CASE WHEN n < 8 THEN best ELSE 0 END) ELSE best END, 6) AS similarity, CASE WHEN direct THEN 'direct' ELSE 'expanded' END AS mode FROM s, n WHERE direct OR (n < 8 AND best > 0)) SELECT * FROM k ORDER BY similarity DESC, doc_id LIMIT 8""")
def expanded_search(spark, root):
    """Texts with all words, or the phrase in camel case or run together; if they are too few, those with any word as well.

    The mode says which way a row was found. Direct hits are counted by a scalar subquery of the same plan.
    """
    rows = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", "text")
    share = [R.lexical_score(F.col("text"), (t,)) for t in ASKED]
    low = F.lower(X.split_camel(F.col("text")))
    direct = ((share[0] > 0) & (share[1] > 0)) | F.contains(low, F.lit(" ".join(ASKED))) | F.contains(F.lower(F.replace("text", F.lit(" "), F.lit(""))), F.lit("".join(ASKED)))
    scored = rows.select("doc_id", direct.alias("direct"), ((share[0] + share[1]) / 2).alias("whole"), F.greatest(*share).alias("best"))
    few = scored.agg((F.count_if("direct") < 8).alias("few")).select("few").scalar()
    found = scored.withColumn("few", few).where(F.col("direct") | (F.col("few") & (F.col("best") > 0)))
    similarity = F.when(F.col("direct"), F.greatest("whole", F.when(F.col("few"), F.col("best")).otherwise(0.0))).otherwise(F.col("best"))
    return found.select("doc_id", F.round(similarity, 6).alias("similarity"), F.when(F.col("direct"), "direct").otherwise("expanded").alias("mode")).orderBy(F.desc("similarity"), "doc_id").limit(8)


@query(f"""WITH n AS (SELECT DISTINCT name FROM symbols WHERE kind = 'interface'), w AS (SELECT chunk_id, unnest(regexp_extract_all(content, '[A-Za-z0-9_]+')) AS name FROM {_CHUNKS}), c AS (SELECT name, chunk_id, count(*) AS tf FROM w JOIN n USING (name) GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY tf DESC, chunk_id) AS rn FROM c), h AS (SELECT n.name, max(CASE WHEN t.rn <= 5 AND s.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM n LEFT JOIN t USING (name) LEFT JOIN symbols s ON s.name = t.name AND s.chunk_id = t.chunk_id AND s.kind = 'interface' GROUP BY 1)
 SELECT count(*) AS asked, sum(hit)::BIGINT AS found, round(avg(hit), 4) AS recall FROM h""")
def retrieval_recall(spark, root):
    """Recall at 5: is the chunk that defines an interface among the five that name it most often?"""
    defined = table(spark, root, "symbols").where("kind = 'interface'").select("name", "chunk_id").distinct()
    names = defined.select("name").distinct()
    words = distinct_chunks(spark, root, F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)).alias("words")).select("chunk_id", F.explode("words").alias("name"))
    counts = words.join(names, "name").groupBy("name", "chunk_id").agg(F.count(F.lit(1)).alias("tf"))
    top = counts.groupBy("name").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("tf")).alias("far"), "chunk_id"))), 1, 5).alias("top"))
    hits = defined.join(top, "name", "left").groupBy("name").agg(F.coalesce(F.max(F.array_contains("top.chunk_id", F.col("chunk_id")).cast("int")), F.lit(0)).alias("hit"))
    return hits.agg(F.count(F.lit(1)).alias("asked"), F.sum("hit").alias("found"), F.round(F.avg("hit"), 4).alias("recall"))


@query(f"""SELECT chunk_id, c.file_path, c.line_start, c.line_end, similarity, 'INFERRED' AS confidence, similarity AS confidence_score FROM (SELECT chunk_id, round(list_cosine_similarity(e, q), 6) AS similarity FROM {_GOOD}, (SELECT arg_min(e, chunk_id) AS q FROM {_GOOD}) WHERE list_cosine_similarity(e, q) >= 0.3 ORDER BY similarity DESC, chunk_id LIMIT 8) JOIN {_CHUNKS} c USING (chunk_id)""")
def citations(spark, root):
    """The chunks an answer rests on as citation rows, tagged as found by a model with its similarity."""
    rows = table(spark, root, "code_chunks").select("chunk_id", "file_path", "line_start", "line_end", "embedding")
    near = R.nearest(rows, "chunk_id", "embedding", _asked(spark, root), 8, 0.3)
    confidence, score = G.tagged(F.lit("llm"), F.least(F.col("similarity"), F.lit(1.0)))
    return near.select("chunk_id", "file_path", "line_start", "line_end", "similarity", confidence.alias("confidence"), score.alias("confidence_score"))


# Checks of a change that need no model, with category and severity.
CHECKS = (
    ("secret", "security", "critical", r"(password|secret|api[_-]?key|private[_-]?key)"),
    ("dynamic_execution", "security", "warning", r"(eval\(|new function\(|exec\(|child_process)"),
    ("async_loop", "performance", "warning", r"(?s)(\.map\(|\.foreach\(|for\s*\().{0,120}(await\s+)"),
    ("dependencies", "maintainability", "suggestion", r"(package\.json|package-lock\.json|pnpm-lock|yarn\.lock|requirements\.txt|go\.mod|cargo\.toml)"),
)


@query(f"""WITH t AS (SELECT chunk_id, file_path, lower(content || chr(10) || file_path) AS t FROM {_CHUNKS}), f AS (
 SELECT 'secret' AS rule, 'security' AS category, 'critical' AS severity, file_path FROM t WHERE regexp_matches(t, '(password|secret|api[_-]?key|private[_-]?key)') UNION ALL SELECT 'dynamic_execution', 'security', 'high', file_path FROM t WHERE regexp_matches(t, '(eval\\(|new function\\(|exec\\(|child_process)')
 UNION ALL SELECT 'async_loop', 'performance', 'high', file_path FROM t WHERE regexp_matches(t, '(\\.map\\(|\\.foreach\\(|for\\s*\\().{{0,120}}(await\\s+)', 's') UNION ALL SELECT 'dependencies', 'maintainability', 'medium', file_path FROM t WHERE regexp_matches(lower(file_path), '(package\\.json|package-lock\\.json|pnpm-lock|yarn\\.lock|requirements\\.txt|go\\.mod|cargo\\.toml)'))
 SELECT rule, category, severity, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files FROM f GROUP BY 1, 2, 3""")
def diff_checks(spark, root):
    """Scalar functions: deterministic checks of changed text, as findings with the index's severities."""
    whole, path = F.lower(F.concat("content", F.lit("\n"), "file_path")), F.lower("file_path")
    found = [F.when((path if name == "dependencies" else whole).rlike(p), F.struct(F.lit(name).alias("rule"), F.lit(c).alias("category"), X.severity(F.lit(s)).alias("severity"))) for name, c, s, p in CHECKS]
    rows = distinct_chunks(spark, root, "file_path", F.array_compact(F.array(*found)).alias("found"))
    return rows.select("file_path", F.explode("found").alias("f")).groupBy("f.rule", "f.category", "f.severity").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file_path").alias("n_files"))


@query("""WITH m AS (SELECT max(created_at) AS t FROM documents), d AS (SELECT doc_id, text, n_chars * 1000 AS n, floor(epoch(t - created_at))::BIGINT AS s FROM documents, m)
 SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', round(n / 1024.0, 1)) WHEN n < 1073741824 THEN printf('%.1f MB', round(n / 1048576.0, 1)) WHEN n IS NOT NULL THEN printf('%.2f GB', round(n / 1073741824.0, 2)) END AS size,
 CASE WHEN s IS NULL THEN 'unknown' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s // 86400 // 30 < 12 THEN s // 86400 // 30 || 'mo ago' ELSE s // 86400 // 365 || 'y ago' END AS age,
 CASE WHEN length(text) > 140 THEN left(text, 139) || '…' ELSE text END AS short, CASE WHEN length(text) > 200 THEN left(text, 200 - 13) || '…[truncated]…' ELSE text END AS cut FROM d""")
def formats(spark, root):
    """Scalar functions: sizes and ages for people, texts shortened with a sign of omission or a marker."""
    last = table(spark, root, "documents").agg(F.max("created_at").alias("t")).select("t").scalar()
    age = F.floor((F.unix_micros(last) - F.unix_micros("created_at")) / 1_000_000)
    return table(spark, root, "documents").select(
        "doc_id", X.human_size(F.col("n_chars") * 1000).alias("size"), X.human_age(age).alias("age"), X.ellipsis(F.col("text")).alias("short"), X.truncated(F.col("text"), 200, "…[truncated]…").alias("cut")
    )


@query(f"""SELECT provider, count(*) AS n, count(*) FILTER (WHERE json_valid(metadata)) AS n_json FROM {_REQ} GROUP BY provider""")
def tolerant_answers(spark, root):
    """Scalar functions: JSON taken out of answers, bare, fenced or between braces."""
    rows = table(spark, root, "ai_request_metrics").select("request_id", "provider", "metadata").dropDuplicates(["request_id"])
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "metadata", F.lit("\n```"))
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("n"), F.count(X.tolerant_json(fenced)).alias("n_json"))


@query(f"""WITH g AS (SELECT repo_id, count(*) AS total, count(embedding) AS covered, round(100.0 * count(embedding) / count(*))::INT AS pct FROM {_CHUNKS} WHERE repo_id IS NOT NULL GROUP BY 1) SELECT repo_id, pct, CASE WHEN pct >= 80 THEN 'good' WHEN pct >= 50 THEN 'ok' ELSE 'poor' END AS verdict FROM g""")
def coverage_verdicts(spark, root):
    """Plugin function: share of chunks with a vector per repository, and what it is worth."""
    rows = distinct_chunks(spark, root, "repo_id", F.col("embedding").isNotNull().alias("has")).where("repo_id IS NOT NULL")
    sums = rows.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("has").alias("covered"))
    pct, verdict = X.coverage_verdict(F.col("total"), F.col("covered"))
    return sums.select("repo_id", pct.alias("pct"), verdict.alias("verdict"))


@query("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '#(\\d+)', 1)) AS n, generate_subscripts(regexp_extract_all(text, '#(\\d+)', 1), 1) AS pos FROM documents), f AS (SELECT doc_id, n, min(pos) AS pos FROM r GROUP BY 1, 2) SELECT doc_id, string_agg(n, ',' ORDER BY pos) AS refs, count(*) AS n FROM f GROUP BY 1""")
def ordered_ids(spark, root):
    """Distinct issue numbers of each document in order of their first mention."""
    refs = F.array_distinct(F.regexp_extract_all("text", F.lit(r"#(\d+)"), F.lit(1)))
    rows = table(spark, root, "documents").select("doc_id", refs.alias("ids")).where(F.size("ids") > 0)
    return rows.select("doc_id", F.array_join("ids", ",").alias("refs"), F.size("ids").cast("long").alias("n"))


@query(f"SELECT source, count(*) FILTER (WHERE completed_at IS NULL AND first_token_at IS NOT NULL) AS active, count(*) FILTER (WHERE completed_at IS NULL AND first_token_at IS NULL) AS queued, count(*) FILTER (WHERE status = 'failed') AS failed FROM {_REQ} GROUP BY source")
def run_gauges(spark, root):
    """Runs at work, waiting and failed, per source."""
    rows = table(spark, root, "ai_request_metrics").select("request_id", "source", "status", "completed_at", "first_token_at").dropDuplicates(["request_id"])
    open_run, begun = F.col("completed_at").isNull(), F.col("first_token_at").isNotNull()
    return rows.groupBy("source").agg(F.count_if(open_run & begun).alias("active"), F.count_if(open_run & ~begun).alias("queued"), F.count_if(F.col("status") == "failed").alias("failed"))


@query(f"""WITH l AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, request_id) AS rn FROM {_REQ} WHERE source = 'pr_review'), k AS (SELECT * FROM l WHERE rn <= 80), m AS (SELECT model, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, model LIMIT 5)
 SELECT count(*) AS reviews, round(avg(total_tokens))::BIGINT AS average, round(100.0 * count(*) FILTER (WHERE rn <= 20 AND status = 'failed') / greatest(1, least(20, count(*))))::BIGINT AS recent_failure_rate, (SELECT string_agg(model, ',' ORDER BY n DESC, model) FROM m) AS common FROM k""")
def review_history(spark, root):
    """The latest 80 reviews: their average, the five most frequent models, and the share of failures among the latest 20."""
    rows = table(spark, root, "ai_request_metrics").where("source = 'pr_review'").select("request_id", "model", "status", "total_tokens", "created_at").dropDuplicates(["request_id"])
    latest = rows.orderBy(F.desc("created_at"), "request_id").limit(80)
    # at most 80 rows from here on
    gathered = latest.agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros("created_at")).alias("t"), "request_id", "status"))).alias("runs"), F.round(F.avg("total_tokens")).cast("long").alias("average"), F.count(F.lit(1)).alias("reviews"))
    failed = F.size(F.filter(F.slice("runs", 1, 20), lambda r: r["status"] == "failed"))
    models = latest.groupBy("model").agg(F.count(F.lit(1)).alias("n")).agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "model"))), 1, 5), lambda m: m["model"]), ",").alias("common"))
    rate = F.round(100.0 * failed / F.greatest(F.lit(1), F.least(F.lit(20), F.col("reviews")))).cast("long")
    return gathered.select("reviews", "average", rate.alias("recent_failure_rate"), models.select("common").scalar().alias("common"))


@query(f"""WITH c AS (SELECT count(*) AS chunks, count(embedding) AS embedded, count(DISTINCT file_path) AS files FROM {_CHUNKS}), r AS (SELECT count(*) AS repos, count(*) FILTER (WHERE is_active) AS active FROM repos), a AS (SELECT count(*) FILTER (WHERE status = 'failed') AS failed, max(created_at AT TIME ZONE 'UTC') AS last FROM (SELECT * FROM {_REQ} WHERE source = 'pr_review' ORDER BY created_at DESC, request_id LIMIT 100)),
 h AS (SELECT count(*) AS hotspots FROM (SELECT target_path FROM imports WHERE target_path NOT LIKE 'pkg:%' GROUP BY 1 HAVING count(DISTINCT src_file) >= 25))
 SELECT repos, active, chunks, files, round(100.0 * embedded / chunks, 2) AS coverage, hotspots, failed, CASE WHEN failed > 10 THEN 'error' WHEN failed > 5 THEN 'warning' ELSE 'healthy' END AS health, last FROM c, r, a, h""")
def dashboard_snapshot(spark, root):
    """Totals, coverage, hotspots, failures of the latest 100 reviews and the state they mean, in one row of scalar subqueries."""
    chunks = distinct_chunks(spark, root, "file_path", F.col("embedding").isNotNull().alias("has")).agg(F.struct(F.count(F.lit(1)).alias("chunks"), F.count_if("has").alias("embedded"), F.count_distinct("file_path").alias("files")).alias("c"))
    reviews = table(spark, root, "ai_request_metrics").where("source = 'pr_review'").select("request_id", "status", "created_at").dropDuplicates(["request_id"]).orderBy(F.desc("created_at"), "request_id").limit(100)
    reviews = reviews.agg(F.struct(F.count_if(F.col("status") == "failed").alias("failed"), F.max(F.col("created_at").cast("timestamp_ntz")).alias("last")).alias("a"))
    own = edges(spark, root).where(~F.col("dst").startswith("pkg:")).groupBy("dst").agg(F.count_distinct("src").alias("n")).where("n >= 25").agg(F.count(F.lit(1)).alias("h"))
    one = table(spark, root, "repos").agg(F.count(F.lit(1)).alias("repos"), F.count_if("is_active").alias("active"))
    one = one.withColumn("c", chunks.select("c").scalar()).withColumn("a", reviews.select("a").scalar()).withColumn("hotspots", own.select("h").scalar())
    health = F.when(F.col("a.failed") > 10, "error").when(F.col("a.failed") > 5, "warning").otherwise("healthy")
    return one.select("repos", "active", "c.chunks", "c.files", F.round(100.0 * F.col("c.embedded") / F.col("c.chunks"), 2).alias("coverage"), "hotspots", "a.failed", health.alias("health"), "a.last")


@query(f"""WITH c AS (SELECT chunk_id, file_id, created_at, commit_sha FROM {_CHUNKS} WHERE file_id IS NOT NULL), cut AS (SELECT max(created_at) - INTERVAL 20 DAY AS t FROM code_chunks), n AS (SELECT c.* FROM c, cut WHERE created_at >= t), o AS (SELECT c.* FROM c, cut WHERE created_at < t)
 SELECT chunk_id, file_id FROM o WHERE file_id NOT IN (SELECT file_id FROM n) UNION ALL SELECT chunk_id, file_id FROM n""")
def replaced_files(spark, root):
    """Files that were read again replace all they had; others stay. The latest 20 days stand for the new reading."""
    rows = table(spark, root, "code_chunks").where("file_id IS NOT NULL AND chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("file_id").alias("file_id"), F.min("created_at").alias("made"))
    since = table(spark, root, "code_chunks").agg((F.max("created_at") - F.expr("INTERVAL 20 DAYS")).alias("t")).select("t").scalar()
    marked = rows.withColumn("new", F.col("made") >= since)
    return store.replace_files(marked.where("NOT new"), marked.where("new"), "file_id").select("chunk_id", "file_id")


@query(f"""SELECT 'File' AS label, left(sha256(file_path || chr(31) || 'file' || chr(31) || file_path), 16) AS node_id, min(file_path) AS name FROM {_CHUNKS} GROUP BY file_path
 UNION SELECT CASE s.kind WHEN 'class' THEN 'Class' WHEN 'method' THEN 'Method' WHEN 'function' THEN 'Function' ELSE 'Symbol' END, left(sha256(c.file_path || chr(31) || s.kind || chr(31) || s.qualified), 16), s.qualified FROM symbols s JOIN {_CHUNKS} c USING (chunk_id)""")
def graph_nodes(spark, root):
    """Nodes of the property graph with their labels and ids."""
    chunks = distinct_chunks(spark, root, "file_path")
    files = chunks.select("file_path").distinct().select(F.lit("File").alias("label"), X.hex_id(F.col("file_path"), F.lit("file"), F.col("file_path")).alias("node_id"), F.col("file_path").alias("name"))
    kind = F.col("kind")
    label = F.when(kind == "class", "Class").when(kind == "method", "Method").when(kind == "function", "Function").otherwise("Symbol")
    symbols = table(spark, root, "symbols").join(chunks, "chunk_id").select(label.alias("label"), X.hex_id(F.col("file_path"), kind, F.col("qualified")).alias("node_id"), F.col("qualified").alias("name"))
    return files.unionByName(symbols.distinct())


@query(f"""WITH d AS (SELECT DISTINCT left(sha256(c.file_path || chr(31) || 'file' || chr(31) || c.file_path), 16) AS src, left(sha256(c.file_path || chr(31) || s.kind || chr(31) || s.qualified), 16) AS dst, 'DEFINES' AS relation, 'EXTRACTED' AS confidence FROM symbols s JOIN {_CHUNKS} c USING (chunk_id)),
 i AS (SELECT left(sha256(src_file || chr(31) || 'file' || chr(31) || src_file), 16) AS src, target_path AS dst, 'IMPORTS' AS relation, coalesce(min(confidence), 'AMBIGUOUS') AS confidence FROM imports GROUP BY src_file, target_path)
 SELECT left(sha256(src || chr(31) || dst || chr(31) || relation), 16) AS edge_id, * FROM (SELECT * FROM d UNION ALL SELECT * FROM i)""")
def graph_edges(spark, root):
    """Edges of the property graph with ids, ambiguous where nothing says how they are known."""
    file_node = lambda path: X.hex_id(path, F.lit("file"), path)
    chunks = distinct_chunks(spark, root, "file_path")
    defines = table(spark, root, "symbols").join(chunks, "chunk_id").select(file_node(F.col("file_path")).alias("src"), X.hex_id(F.col("file_path"), F.col("kind"), F.col("qualified")).alias("dst"), F.lit("DEFINES").alias("relation"), F.lit("EXTRACTED").alias("confidence")).distinct()
    imports = table(spark, root, "imports").groupBy("src_file", "target_path").agg(F.coalesce(F.min("confidence"), F.lit("AMBIGUOUS")).alias("confidence"))
    imports = imports.select(file_node(F.col("src_file")).alias("src"), F.col("target_path").alias("dst"), F.lit("IMPORTS").alias("relation"), "confidence")
    return defines.unionByName(imports).select(X.hex_id(F.col("src"), F.col("dst"), F.col("relation")).alias("edge_id"), "src", "dst", "relation", "confidence")


_KIND = "CASE event_type WHEN 'view' THEN 'ast' WHEN 'click' THEN 'llm' WHEN 'signup' THEN 'hybrid' ELSE 'other' END"


@query(f"""WITH w AS (SELECT user_id, kind, s FROM (SELECT user_id, {_KIND} AS kind, greatest(0, least(1, value / 20)) AS s, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END DESC, ts, event_id) AS rn FROM events) WHERE rn = 1),
 t AS (SELECT user_id, CASE WHEN kind = 'ast' THEN 'EXTRACTED' WHEN kind = 'llm' AND s IS NOT NULL THEN 'INFERRED' WHEN kind = 'hybrid' AND s >= 0.5 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS tag FROM w), e AS (SELECT edge_id, min(confidence) AS confidence FROM imports GROUP BY 1)
 SELECT edge_id, confidence AS before, coalesce(tag, confidence, 'AMBIGUOUS') AS confidence, coalesce(tag, confidence) IS DISTINCT FROM confidence AS changed FROM e LEFT JOIN t ON t.user_id = ('0x' || left(edge_id, 6))::BIGINT % 1000""")
def retagged_edges(spark, root):
    """Edges with the confidence of their audit of greatest authority, else their own, else ambiguous.

    The event log stands for the audits: those of a user are the audits of the edges whose id falls to that user.
    """
    e = F.col("event_type")
    rank = F.when(e == "view", 3).when(e == "click", 2).when(e == "signup", 1).otherwise(0)
    kind = F.when(e == "view", "ast").when(e == "click", "llm").when(e == "signup", "hybrid").otherwise("other")
    audits = G.winners(table(spark, root, "events").select("user_id", "event_id", "event_type", "ts", "value"), "user_id", rank, F.asc("ts"), F.asc("event_id"))
    tag, _ = G.tagged(kind, F.col("value") / 20)
    tags = audits.select("user_id", tag.alias("tag"))
    own = table(spark, root, "imports").groupBy("edge_id").agg(F.min("confidence").alias("before"))
    of = own.withColumn("user_id", F.conv(F.left("edge_id", F.lit(6)), 16, 10).cast("long") % 1000)
    both = of.join(tags, "user_id", "left")
    new = F.coalesce("tag", "before")
    return both.select("edge_id", "before", F.coalesce(new, F.lit("AMBIGUOUS")).alias("confidence"), (~new.eqNullSafe(F.col("before"))).alias("changed"))


@query(f"""WITH e AS (SELECT date_trunc('hour', started_at AT TIME ZONE 'UTC') AS hour, 1 AS begun, 0 AS ended FROM {_REQ} WHERE started_at IS NOT NULL UNION ALL SELECT date_trunc('hour', completed_at AT TIME ZONE 'UTC'), 0, 1 FROM {_REQ} WHERE started_at IS NOT NULL AND completed_at IS NOT NULL),
 h AS (SELECT hour::TIMESTAMP AS hour, sum(begun)::BIGINT AS begun, sum(ended)::BIGINT AS ended FROM e GROUP BY 1) SELECT *, sum(begun - ended) OVER (ORDER BY hour)::BIGINT AS depth FROM h""")
def queue_depth(spark, root):
    """Requests that begin and end in each hour, and how many are open after it. Hours are few rows, so their order is one small task."""
    from pyspark.sql import Window

    rows = table(spark, root, "ai_request_metrics").select("request_id", "started_at", "completed_at").dropDuplicates(["request_id"]).where("started_at IS NOT NULL")
    hour = lambda c: F.date_trunc("hour", F.col(c)).cast("timestamp_ntz").alias("hour")
    begun = rows.select(hour("started_at"), F.lit(1).alias("b"), F.lit(0).alias("e"))
    ended = rows.where("completed_at IS NOT NULL").select(hour("completed_at"), F.lit(0).alias("b"), F.lit(1).alias("e"))
    hours = begun.unionByName(ended).groupBy("hour").agg(F.sum("b").alias("begun"), F.sum("e").alias("ended"))
    return hours.withColumn("depth", F.sum(F.col("begun") - F.col("ended")).over(Window.orderBy("hour")))


@query(f"""WITH f AS (SELECT file_path, max(created_at) AS made FROM {_CHUNKS} GROUP BY 1 ORDER BY made DESC, file_path LIMIT 4), r AS (SELECT file_path, chunk_id, line_start, row_number() OVER (PARTITION BY file_path ORDER BY line_start, chunk_id) AS rn FROM {_CHUNKS} JOIN f USING (file_path)) SELECT file_path, chunk_id, line_start FROM r WHERE rn <= 2""")
def first_chunks(spark, root):
    """The first two chunks, by line, of each of the four files changed last."""
    from pyspark.sql import Window

    rows = table(spark, root, "code_chunks").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("file_path").alias("file_path"), F.min("line_start").alias("line_start"), F.min("created_at").alias("made"))
    latest = rows.groupBy("file_path").agg(F.max("made").alias("last")).orderBy(F.desc("last"), "file_path").limit(4).select("file_path")
    order = Window.partitionBy("file_path").orderBy("line_start", "chunk_id")
    return rows.join(F.broadcast(latest), "file_path", "left_semi").withColumn("rn", F.row_number().over(order)).where("rn <= 2").select("file_path", "chunk_id", "line_start")


@query(f"""SELECT doc_id, doc_kind, round({' + '.join(_SHARE)}, 6) AS score FROM documents WHERE doc_kind IN ('readme', 'runbook', 'schema', 'changelog') AND text IS NOT NULL AND {' AND '.join(f'{x} > 0' for x in _SHARE)} ORDER BY score DESC, doc_id LIMIT 5""")
def artifact_search(spark, root):
    """The five best context documents that have all words, of some kinds only."""
    rows = table(spark, root, "documents").where(F.col("doc_kind").isin("readme", "runbook", "schema", "changelog") & F.col("text").isNotNull())
    share = [R.lexical_score(F.col("text"), (t,)) for t in ASKED]
    return rows.where((share[0] > 0) & (share[1] > 0)).select("doc_id", "doc_kind", F.round(share[0] + share[1], 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(5)


@query(rf"""WITH q AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_./-]+\.(?:ts|js|py|go|java)')) AS name, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9_./-]+\.(?:ts|js|py|go|java)'), 1) AS pos FROM documents WHERE doc_kind IN ('review', 'issue')), d AS (SELECT doc_id, name, min(pos) AS pos FROM q GROUP BY 1, 2),
 n AS (SELECT regexp_extract(file_path, '[^/]+$') AS base, count(DISTINCT file_id) AS files, min(file_path) AS best FROM code_chunks GROUP BY 1)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS place, name, coalesce(files, 0) AS files, best, CASE WHEN files IS NULL THEN 'not_found' ELSE 'found' END AS state FROM d LEFT JOIN n ON n.base = regexp_extract(d.name, '[^/]+$')""")
def evidence_in_order(spark, root):
    """The files a text cites, once each in order of mention, with what is known of files of that name or not_found."""
    from pyspark.sql import Window

    names = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_./-]+\.(?:ts|js|py|go|java)"), F.lit(0)))
    cited = table(spark, root, "documents").where(F.col("doc_kind").isin("review", "issue")).select("doc_id", F.posexplode(names).alias("k", "name")).withColumn("base", F.substring_index("name", "/", -1))
    known = table(spark, root, "code_chunks").groupBy(F.substring_index("file_path", "/", -1).alias("base")).agg(F.count_distinct("file_id").alias("files"), F.min("file_path").alias("best"))
    both = cited.join(known, "base", "left")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("k"))
    return both.select("doc_id", place.alias("place"), "name", F.coalesce("files", F.lit(0)).alias("files"), "best", F.when(F.col("files").isNull(), "not_found").otherwise("found").alias("state"))


@query("""WITH v AS (SELECT repo_id, commit_sha, min(created_at AT TIME ZONE 'UTC') AS made FROM code_chunks WHERE repo_id IS NOT NULL AND commit_sha IS NOT NULL GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY made, commit_sha) AS version, lag(commit_sha) OVER (PARTITION BY repo_id ORDER BY made, commit_sha) AS before FROM v)
 SELECT repo_id, version, commit_sha, before, version = max(version) OVER (PARTITION BY repo_id) AS current FROM n""")
def setting_versions(spark, root):
    """Versions of a value by key in order, each with the one it replaced and whether it holds now: an audit of appended rows."""
    from pyspark.sql import Window

    rows = table(spark, root, "code_chunks").where("repo_id IS NOT NULL AND commit_sha IS NOT NULL")
    first = rows.groupBy("repo_id", "commit_sha").agg(F.min(F.col("created_at").cast("timestamp_ntz")).alias("made"))
    order = Window.partitionBy("repo_id").orderBy("made", "commit_sha")
    numbered = first.select("repo_id", "commit_sha", F.row_number().over(order).alias("version"), F.lag("commit_sha").over(order).alias("before"), F.lead("commit_sha").over(order).isNull().alias("current"))
    return numbered.select("repo_id", F.col("version").cast("long").alias("version"), "commit_sha", "before", "current")
