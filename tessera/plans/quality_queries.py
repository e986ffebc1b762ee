"""Registered queries of rules, merging, incremental refresh, sources and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import quality as Q
from tessera.operators import sequence, store
from tessera.plans.registering import book
from tessera.sources import scan
from tessera.sources.files import file_texts
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL, query = book()

_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at)"
_SPANS = f"(SELECT DISTINCT file_id, s.name AS name, s.kind AS kind, s.lineStart AS first, s.lineEnd AS last FROM (SELECT file_id, unnest(symbols) AS s FROM {_CHUNKS}))"
_SMELLS = f"""s AS {_SPANS}, f AS (SELECT file_id, max(line_end) AS lines, max(len(list_distinct(list_transform(imports, lambda i: i.source)))) AS imports, count(*) FILTER (WHERE regexp_matches(content, '(^|\\n)[ \\t]{{16,}}[^\\s]')) AS deep FROM {_CHUNKS} GROUP BY file_id),
 m AS (SELECT c.file_id, split_part(s.qualified, '.', 1) AS owner, count(*) AS n FROM symbols s JOIN {_CHUNKS} c USING (chunk_id) WHERE s.kind = 'method' AND contains(s.qualified, '.') GROUP BY 1, 2),
 smells AS (SELECT 'long_function' AS rule, 'high' AS severity, file_id || ':' || name AS subject, (last - first)::BIGINT AS measure FROM s WHERE kind IN ('function', 'method') AND last - first > 80
 UNION ALL SELECT 'god_class', 'critical', file_id || ':' || name, last - first FROM s WHERE kind = 'class' AND last - first > 500
 UNION ALL SELECT 'many_methods', 'critical', file_id || ':' || owner, n FROM m WHERE n > 15
 UNION ALL SELECT 'large_file', 'medium', file_id, lines FROM f WHERE lines > 400 UNION ALL SELECT 'fan_out', 'medium', file_id, imports FROM f WHERE imports > 10
 UNION ALL SELECT 'deep_nesting', 'medium', file_id, deep FROM f WHERE deep > 0)"""


def _smells(spark, root):
    chunks = distinct_chunks(spark, root, "file_id", "line_end", "imports", "symbols", F.coalesce(F.col("content").rlike(Q.DEEP), F.lit(False)).alias("deep"))
    spans = chunks.select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.name", "s.kind", F.col("s.lineStart").alias("first"), F.col("s.lineEnd").alias("last")).distinct()
    methods = table(spark, root, "symbols").where("kind = 'method'").join(chunks.select("chunk_id", "file_id"), "chunk_id").select("file_id", "qualified")
    return Q.smells(chunks, spans, methods)


@query(f"WITH {_SMELLS} SELECT * FROM smells")
def smell_union(spark, root):
    """All smells of files and symbols; files on cycles are in bounded_cycles."""
    return _smells(spark, root)


@query(f"WITH {_SMELLS} SELECT rule, count(*) AS n, max(measure) AS worst FROM smells GROUP BY rule")
def health_report(spark, root):
    """Findings per rule."""
    return _smells(spark, root).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.max("measure").alias("worst"))


@query(f"""WITH {_SMELLS}, g AS (SELECT left(subject, 16) AS file_id, severity FROM smells), k AS (SELECT file_id, count(*) AS n, greatest(0, least(100, 100 - sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 10 WHEN 'medium' THEN 4 WHEN 'low' THEN 1 ELSE 0 END)))::BIGINT AS score FROM g GROUP BY file_id)
 SELECT *, CASE WHEN score < 55 THEN 'request_changes' WHEN score >= 85 THEN 'approve' ELSE 'comment' END AS recommendation FROM k""")
def review_score(spark, root):
    """Score and recommendation per file."""
    return Q.score(_smells(spark, root).withColumn("file_id", F.left("subject", F.lit(16))), "file_id")


@query(f"""WITH {_SMELLS}, t AS (SELECT 'todo' AS rule, 'low' AS severity, file_id AS subject, count(*) AS measure FROM {_CHUNKS} WHERE contains(content, 'TODO') GROUP BY file_id),
 b AS (SELECT *, 0 AS origin FROM smells UNION ALL SELECT *, 1 FROM t), u AS (SELECT *, row_number() OVER (PARTITION BY rule, subject ORDER BY origin, measure DESC) AS rn FROM b)
 SELECT rule, severity, subject, measure, origin FROM (SELECT * EXCLUDE rn, row_number() OVER (PARTITION BY rule ORDER BY origin, measure DESC, rule, subject) AS rn FROM u WHERE rn = 1) WHERE rn <= 80""")
def merge_findings(spark, root):
    """Findings of two detectors, the first winning, at most 80 a rule."""
    todo = distinct_chunks(spark, root, "file_id", F.contains("content", F.lit("TODO")).alias("hit")).where("hit").groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    second = todo.select(*Q.finding("todo", "low", F.col("file_id"), F.col("n")))
    return Q.merged(_smells(spark, root), second, ["rule", "subject"], 80, "rule")


@query(f"""SELECT file_path, risk FROM (SELECT file_path, sum(length(content)) / 1000.0 + 5 * count(*) FILTER (WHERE contains(content, 'TODO')) + max(len(imports)) AS r, round(r, 4) AS risk FROM {_CHUNKS} GROUP BY file_path) ORDER BY risk DESC, file_path LIMIT 80""")
def risk_rank(spark, root):
    """K9: the 80 files of greatest computed risk."""
    rows = distinct_chunks(spark, root, "file_path", F.length("content").alias("n"), F.contains("content", F.lit("TODO")).alias("todo"), F.size("imports").alias("i"))
    risk = F.sum("n") / 1000.0 + 5 * F.count_if("todo") + F.max(F.when(F.col("i") >= 0, F.col("i")))
    return rows.groupBy("file_path").agg(F.round(risk, 4).alias("risk")).orderBy(F.desc("risk"), "file_path").limit(80)


@query("SELECT chunk_id, max(created_at AT TIME ZONE 'UTC') AS made, count(*) AS versions FROM code_chunks GROUP BY chunk_id")
def versions(spark, root):
    """Versions of each key and the latest."""
    rows = table(spark, root, "code_chunks").select("chunk_id", F.col("created_at").cast("timestamp_ntz").alias("made"))
    return rows.groupBy("chunk_id").agg(F.max("made").alias("made"), F.count(F.lit(1)).alias("versions"))


@query()
def upsert_merge(spark, root):
    """The later part of the index merged into the earlier, one row per file."""
    rows = table(spark, root, "file_hashes").select("file_id", "file_path", "sha256", F.col("indexed_at").alias("made"))
    cutoff = table(spark, root, "file_hashes").agg((F.max("indexed_at") - 864_000_000).alias("t")).select("t").scalar()
    return store.upsert(rows.where(F.col("made") < cutoff), rows.where(F.col("made") >= cutoff), ["file_id", "file_path"], "made")


SQL["upsert_merge"] = "SELECT file_id, file_path, arg_max(sha256, indexed_at) AS sha256, max(indexed_at) AS made FROM file_hashes GROUP BY file_id, file_path"


@query("SELECT file_id FROM file_hashes WHERE file_id NOT IN (SELECT file_id FROM code_chunks WHERE language IS NOT NULL AND file_id IS NOT NULL)")
def orphans(spark, root):
    """Indexed files without a chunk in a known language."""
    known = table(spark, root, "code_chunks").where("language IS NOT NULL").select("file_id").distinct()
    return table(spark, root, "file_hashes").select("file_id").join(known, "file_id", "left_anti")


@query("""WITH t AS (SELECT file_id, string_agg(content, chr(10) ORDER BY line_start) AS text FROM (SELECT DISTINCT ON (chunk_id) file_id, chunk_id, line_start, content FROM code_chunks ORDER BY chunk_id, created_at) GROUP BY file_id)
 SELECT h.file_id, sha256(t.text) = h.sha256 AS unchanged FROM file_hashes h JOIN t USING (file_id)""")
def hash_skip(spark, root):
    """T4, SC17: which files are unchanged since they were indexed, by the hash of their whole text."""
    now = file_texts(spark, root).select("file_id", F.sha2("text", 256).alias("now"))
    return table(spark, root, "file_hashes").join(now, "file_id").select("file_id", (F.col("now") == F.col("sha256")).alias("unchanged"))


@query(r"SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\x{FEFF}', ''), '\r\n?', chr(10), 'g')) AS key FROM documents WHERE text IS NOT NULL")
def content_keys(spark, root):
    """Cache keys: the same for any line ends and byte-order mark."""
    return table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", store.content_key(F.col("text")).alias("key"))


@query("""SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY created_at, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM (SELECT doc_id, created_at, coalesce(n_chars, 0) AS n FROM documents))
 WHERE upto < (SELECT sum(coalesce(n_chars, 0)) FROM documents) - 200000""")
def lru_evict(spark, root):
    """What to evict so that 200,000 characters stay."""
    rows = table(spark, root, "documents").select("doc_id", "n_chars", "created_at")
    return store.evict(rows, "n_chars", "created_at", "doc_id", 200_000).select("doc_id")


@query("SELECT count(*) AS entries, count(DISTINCT sha256) AS distinct_keys, count(DISTINCT file_path) AS paths FROM file_hashes")
def cache_totals(spark, root):
    """Entries and distinct keys."""
    rows = table(spark, root, "file_hashes")
    return rows.agg(F.count(F.lit(1)).alias("entries"), F.count_distinct("sha256").alias("distinct_keys"), F.count_distinct("file_path").alias("paths"))


@query("""SELECT full_name AS source, count(d.doc_id) AS n FROM repos r LEFT JOIN documents d ON d.source = r.full_name WHERE NOT EXISTS (SELECT 1 FROM ai_request_metrics a WHERE a.repo_id = r.repo_id AND a.source = 'agent') GROUP BY 1""")
def append_missing(spark, root):
    """What is not there yet, by anti-join."""
    ran = table(spark, root, "ai_request_metrics").where("source = 'agent'").select("repo_id").distinct()
    quiet = table(spark, root, "repos").select("repo_id", F.col("full_name").alias("source")).join(ran, "repo_id", "left_anti")
    counts = table(spark, root, "documents").where("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return quiet.join(counts, "source", "left").na.fill(0, ["n"]).select("source", "n")


@query("SELECT d.doc_id, coalesce(d.repo_id, r.repo_id) AS repo_id FROM documents d LEFT JOIN repos r ON d.source = r.full_name")
def backfill(spark, root):
    """Missing ids filled from the parent."""
    names = table(spark, root, "repos").select(F.col("repo_id").alias("other"), F.col("full_name").alias("source"))
    return table(spark, root, "documents").select("doc_id", "repo_id", "source").join(names, "source", "left").select("doc_id", F.coalesce("repo_id", "other").alias("repo_id"))


@query(r"""WITH q AS (SELECT doc_id, regexp_extract(text, '^([^\s:]+):\d+', 1) AS path FROM documents WHERE doc_kind = 'review' AND regexp_matches(text, '^[^\s:]+:\d+')), n AS (SELECT regexp_extract(file_path, '[^/]+$') AS name, count(*) AS files, min(file_id) AS first FROM (SELECT DISTINCT file_id, file_path FROM code_chunks) GROUP BY 1)
 SELECT doc_id, path, CASE WHEN n.name IS NULL THEN 'not_found' ELSE 'found' END AS state, coalesce(files, 0) AS files, n.first AS file_id FROM q LEFT JOIN n ON n.name = regexp_extract(q.path, '[^/]+$')""")
def evidence_batch(spark, root):
    """Every cited file with what is known of files of its name, or not_found."""
    cited = table(spark, root, "documents").where("doc_kind = 'review'").where(F.col("text").rlike(r"^[^\s:]+:\d+"))
    cited = cited.select("doc_id", F.regexp_extract("text", r"^([^\s:]+):\d+", 1).alias("path")).withColumn("name", F.substring_index("path", "/", -1))
    files = table(spark, root, "code_chunks").select("file_id", "file_path").distinct()
    names = files.groupBy(F.substring_index("file_path", "/", -1).alias("name")).agg(F.count(F.lit(1)).alias("files"), F.min("file_id").alias("file_id"))
    state = F.when(F.col("files").isNull(), "not_found").otherwise("found")
    return cited.join(names, "name", "left").select("doc_id", "path", state.alias("state"), F.coalesce("files", F.lit(0)).alias("files"), "file_id")


_LANGUAGES = "ts:typescript tsx:typescript mts:typescript cts:typescript js:javascript jsx:javascript mjs:javascript cjs:javascript py:python go:go java:java kt:kotlin kts:kotlin rs:rust swift:swift php:php vue:vue css:css scss:css less:css html:html htm:html md:markdown mdx:markdown yml:yaml yaml:yaml json:json tf:terraform tfvars:terraform sql:sql"


@query("SELECT file_path, coalesce(max(l.lang), 'unknown') AS detected FROM (SELECT DISTINCT file_path FROM code_chunks) c LEFT JOIN (VALUES " + ", ".join("('.{}', '{}')".format(*x.split(":")) for x in _LANGUAGES.split()) + ") AS l(ending, lang) ON ends_with(lower(c.file_path), l.ending) GROUP BY file_path")
def languages(spark, root):
    """SC3, SC4: language by extension."""
    return table(spark, root, "code_chunks").select("file_path").distinct().select("file_path", X.language_of(F.col("file_path")).alias("detected"))


@query(r"""SELECT count(*) AS n_files, count(*) FILTER (WHERE NOT regexp_matches(p, '(^|/)\.[^/]') AND NOT regexp_matches(p, 'node_modules/|dist/|\.git/|/migrations/') AND NOT regexp_matches(p, '\.(spec\.ts|test\.ts|e2e-spec\.ts|json|lock|env|png|jpg|jpeg|gif|pdf|zip|ico|svg|woff|woff2|ttf|eot)$')
 AND regexp_matches(p, '\.(ts|tsx|mts|cts|js|jsx|mjs|cjs|py|go|java|kt|kts|rs|swift|php|vue|svelte|md|mdx|yml|yaml|sql|prisma|graphql|gql|proto|tf|tfvars)$')) AS n_indexed FROM (SELECT DISTINCT file_path, lower(file_path) AS p FROM code_chunks)""")
def indexable(spark, root):
    """SC2, SC8: how many files the index takes."""
    files = table(spark, root, "code_chunks").select("file_path").distinct()
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(scan.should_index(F.col("file_path"))).alias("n_indexed"))


@query(r"""SELECT kind, count(*) AS n FROM (SELECT DISTINCT file_path, CASE WHEN regexp_matches(p, 'node_modules/|dist/|\.git/|coverage/|test/|__tests__/') THEN NULL WHEN regexp_matches(b, '\.sql$|schema\.(ts|js|prisma)$|\.prisma$') THEN 'schema' WHEN regexp_matches(b, '\.ya?ml$|openapi\.json$|swagger\.json$') THEN 'openapi'
 WHEN regexp_matches(b, '\.(tf|tfvars)$') THEN 'terraform' WHEN regexp_matches(b, '\.(graphql|gql)$') THEN 'graphql' WHEN regexp_matches(b, '\.proto$') THEN 'proto' WHEN regexp_matches(b, '^(architecture|adr|design|api|database|schema|readme)\.mdx?$') OR regexp_matches(p, '/(docs?|documentation|architecture|adr)/') THEN 'markdown' END AS kind
 FROM (SELECT file_path, lower(file_path) AS p, lower(regexp_extract(file_path, '[^/]+$')) AS b FROM code_chunks)) WHERE kind IS NOT NULL GROUP BY kind""")
def artifacts(spark, root):
    """SC9, A25: context artifacts per kind."""
    files = table(spark, root, "code_chunks").select("file_path").distinct().select(scan.artifact_kind(F.col("file_path")).alias("kind"))
    return files.where("kind IS NOT NULL").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT repo_id, CASE WHEN bool_or(regexp_matches(file_path, '\.(module|controller|service)\.ts$')) THEN 'nestjs' WHEN bool_or(contains(file_path, 'src/main/java/')) THEN 'spring' WHEN bool_or(regexp_matches(file_path, '\.m?js$')) THEN 'express' END AS framework FROM code_chunks WHERE repo_id IS NOT NULL GROUP BY repo_id""")
def frameworks(spark, root):
    """A guess at the framework of each repository by the names of its files alone."""
    return scan.framework_of(table(spark, root, "code_chunks").where("repo_id IS NOT NULL").select("repo_id", "file_path"), "repo_id")


@query(r"""SELECT role, coalesce(nest_role, 'none') AS given, count(*) AS n FROM (SELECT nest_role, CASE WHEN regexp_matches(file_path, '\.(entity|dto|guard|interceptor|filter|pipe|middleware|strategy|decorator)\.ts$') THEN regexp_extract(file_path, '\.(\w+)\.ts$', 1) WHEN list_contains(d, 'Controller') THEN 'controller'
 WHEN list_contains(d, 'Injectable') AND contains(file_path, 'service') THEN 'service' WHEN list_contains(d, 'Module') THEN 'module' WHEN list_contains(d, 'Injectable') THEN 'service' ELSE 'unknown' END AS role
 FROM (SELECT *, flatten(list_transform(symbols, lambda s: s.decorators)) AS d FROM """ + _CHUNKS + """)) GROUP BY 1, 2""")
def roles(spark, root):
    """SC12: roles by path and decorators against the given ones."""
    rows = distinct_chunks(spark, root, "nest_role", scan.nest_role(F.col("file_path"), F.flatten("symbols.decorators")).alias("role"))
    return rows.groupBy("role", F.coalesce("nest_role", F.lit("none")).alias("given")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT DISTINCT repo_id, file_path FROM code_chunks WHERE repo_id IS NOT NULL), t AS (SELECT repo_id, file_path, string_agg(content, chr(10) ORDER BY line_start) AS text FROM (SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at) WHERE file_path IN ('package.json', 'requirements.txt', 'pom.xml') OR file_path LIKE 'vite.config.%' GROUP BY 1, 2),
 r AS (SELECT repo_id, bool_or(file_path = 'package.json' AND contains(text, '@nestjs/core')) AS nest, bool_or(file_path = 'package.json' AND contains(text, '"express"')) AS express FROM t GROUP BY 1),
 g AS (SELECT repo_id, min(CASE regexp_extract(lower(file_path), '[^/]+$') WHEN 'next.config.js' THEN 'a:nextjs' WHEN 'next.config.ts' THEN 'a:nextjs' WHEN 'next.config.mjs' THEN 'a:nextjs' WHEN 'vite.config.ts' THEN 'b:vite-react' WHEN 'vite.config.js' THEN 'b:vite-react' WHEN 'vite.config.mts' THEN 'b:vite-react' WHEN 'angular.json' THEN 'c:angular' WHEN '.angular-cli.json' THEN 'c:angular'
   WHEN 'svelte.config.js' THEN 'd:svelte' WHEN 'svelte.config.ts' THEN 'd:svelte' WHEN 'nuxt.config.ts' THEN 'e:nuxt' WHEN 'nuxt.config.js' THEN 'e:nuxt' END) FILTER (WHERE len(string_split(file_path, '/')) <= 2) AS signal FROM f GROUP BY 1)
 SELECT g.repo_id, CASE WHEN nest THEN 'nestjs' WHEN signal IS NOT NULL THEN substr(signal, 3) WHEN express THEN 'express' ELSE 'unknown' END AS framework FROM g LEFT JOIN r USING (repo_id)""")
def detected_frameworks(spark, root):
    """SC10: framework of each repository by manifest, signal files, requirements and build files."""
    paths = table(spark, root, "code_chunks").where("repo_id IS NOT NULL").select("repo_id", "file_path").distinct()
    texts = file_texts(spark, root, "repo_id", where=F.col("file_path").isin(*scan.READ)).where("repo_id IS NOT NULL")
    return scan.detected_framework(paths, texts, "repo_id")


@query()
def framework_roles(spark, root):
    """SC11: roles that each framework would give to the files."""
    files = table(spark, root, "code_chunks").select("file_path").distinct()
    each = F.array(*[F.struct(F.lit(f).alias("framework"), scan.framework_role(F.col("file_path"), f).alias("role")) for f in (*scan.FRAMEWORK_ROLES, "svelte", "django", "nestjs")])
    return files.select(F.explode(each).alias("x")).select("x.*").groupBy("framework", "role").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT s.node_id, arg_min(c.chunk_id, (c.line_end - c.line_start) * 100000 + c.line_start) AS chunk_id FROM (SELECT s.node_id, k.file_id, z.lineStart AS first FROM symbols s JOIN {_CHUNKS} k USING (chunk_id), LATERAL (SELECT unnest(k.symbols) AS z) WHERE z.name = s.name AND z.kind = s.kind) s
 JOIN {_CHUNKS} c ON c.file_id = s.file_id AND c.line_start <= s.first AND c.line_end >= s.first GROUP BY s.node_id""")
def symbol_chunks(spark, root):
    """The smallest chunk that spans each symbol's first line: a range join within files."""
    chunks = distinct_chunks(spark, root, "file_id", "line_start", "line_end", "symbols")
    placed = table(spark, root, "symbols").join(chunks.select("chunk_id", "file_id", F.explode("symbols").alias("z")), "chunk_id").where("z.name = name AND z.kind = kind").select("node_id", "file_id", F.col("z.lineStart").alias("first"))
    spans = chunks.select("file_id", F.col("chunk_id").alias("of"), "line_start", "line_end")
    hits = placed.join(spans, "file_id").where("line_start <= first AND line_end >= first")
    return hits.groupBy("node_id").agg(F.min_by("of", (F.col("line_end") - F.col("line_start")) * 100000 + F.col("line_start")).alias("chunk_id"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
 SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n, arg_max(event_type, ts) AS action FROM s GROUP BY user_id, session""")
def debounce(spark, root):
    """Bursts of a key collapsed to their last action; the batch form of the streaming operator."""
    rows = table(spark, root, "events").select("user_id", "ts", "event_id", "event_type")
    by = rows.groupBy("user_id", F.session_window("ts", "30 minutes"))
    return by.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("action")).drop("session_window")


@query("""WITH w AS (SELECT event_id, event_type, unnest(generate_series(time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 55 MINUTE, time_bucket(INTERVAL 5 MINUTE, ts), INTERVAL 5 MINUTE)) AS start FROM events)
 SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING count(*) >= 6""")
def sliding_sweep(spark, root):
    """Windows of an hour, every 5 minutes, with 6 or more events of a kind."""
    counts = table(spark, root, "events").groupBy(F.window("ts", "60 minutes", "5 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.where("n >= 6").select(F.col("window.start").alias("start"), "event_type", "n")


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error'), p(user_id, event_id, t) AS (SELECT user_id, arg_min(event_id, t), min(t) FROM e GROUP BY user_id
 UNION ALL SELECT user_id, event_id, t FROM (SELECT e.user_id, e.event_id, e.t, row_number() OVER (PARTITION BY e.user_id ORDER BY e.t, e.event_id) AS rn FROM p JOIN e ON e.user_id = p.user_id AND e.t - p.t >= 86400000000) WHERE rn = 1)
 SELECT user_id, event_id FROM p""")
def cooldown(spark, root):
    """Alerts of each key at least a day apart, greedily in order of time."""
    rows = table(spark, root, "events").where("event_type = 'error'").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return sequence.cooled_down(rows, "user_id", "t", "event_id", 86_400_000_000)


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, value AS cost, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS rn FROM events),
 b AS (SELECT user_id, event_id, t, rn, 100.0::DOUBLE AS had, cost FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.event_id, o.t, o.rn, least(100.0, CASE WHEN b.cost <= b.had THEN b.had - b.cost ELSE b.had END + greatest(0, o.t - b.t) / 1e6 * 0.001), o.cost FROM b JOIN o ON o.user_id = b.user_id AND o.rn = b.rn + 1)
 SELECT user_id, event_id, cost <= had AS ok, CASE WHEN cost <= had THEN 0 ELSE ceil((cost - had) * 1000 / 0.001) END::BIGINT AS retry_ms FROM b""")
def rate_control(spark, root):
    """A token bucket per key over the event log."""
    rows = table(spark, root, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("cost"))
    return sequence.token_bucket(rows, "user_id", "t", "event_id", "cost", 100.0, 0.001)


@query("SELECT event_type, day, n, n - lag(n) OVER (PARTITION BY event_type ORDER BY day) AS change FROM (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)")
def daily_buckets(spark, root):
    """Tumbling days and their change."""
    days = table(spark, root, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy("event_type").orderBy("day")))
