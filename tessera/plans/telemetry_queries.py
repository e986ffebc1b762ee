"""Registered queries over request logs, repositories and documents (SURVEY A-family)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import telemetry as T
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL = {}, {}


def query(sql):
    def keep(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function

    return keep


def requests(spark, root, *columns):
    """Every request once (repeated rows are equal in all fields)."""
    rows = table(spark, root, "ai_request_metrics").select("request_id", *columns)
    return rows.dropDuplicates(["request_id"])


_REQ = "(SELECT DISTINCT ON (request_id) *, (created_at AT TIME ZONE 'UTC') AS made, (created_at AT TIME ZONE 'UTC')::DATE AS day FROM ai_request_metrics ORDER BY request_id)"
_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at)"
_WEEK = f"(SELECT * FROM {_REQ} WHERE made > (SELECT max(created_at AT TIME ZONE 'UTC') - INTERVAL 7 DAY FROM ai_request_metrics))"


def _day(column="created_at"):
    return F.to_date(column).alias("day")


@query(f"SELECT count(*) AS total, count(embedding) AS embedded, CASE WHEN count(*) = 0 THEN 0 ELSE round(100.0 * count(embedding) / count(*), 0) END AS coverage FROM {_CHUNKS}")
def coverage(spark, root):
    """A1: chunks, chunks with a vector and their share."""
    chunks = distinct_chunks(spark, root, F.col("embedding").isNotNull().alias("has"))
    n, k = F.count(F.lit(1)), F.count_if("has")
    return chunks.agg(n.alias("total"), k.alias("embedded"), T.percent(k, n, 0).alias("coverage"))


@query(f"SELECT repo_id, count(*) AS total, round(100.0 * count(embedding) / count(*), 2) AS coverage FROM {_CHUNKS} GROUP BY repo_id")
def coverage_pct(spark, root):
    """A2: share of chunks with a vector per repository, 100 where there are none."""
    chunks = distinct_chunks(spark, root, "repo_id", F.col("embedding").isNotNull().alias("has"))
    n = F.count(F.lit(1))
    return chunks.groupBy("repo_id").agg(n.alias("total"), T.percent(F.count_if("has"), n, 2, 100.0).alias("coverage"))


@query("SELECT count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT file_id) AS n_files, count(DISTINCT repo_id) AS n_repos, count(DISTINCT module_name) AS n_modules FROM code_chunks")
def totals(spark, root):
    """Totals and distinct counts."""
    rows = table(spark, root, "code_chunks")
    return rows.agg(*[F.count_distinct(c).alias(a) for c, a in (("chunk_id", "n_chunks"), ("file_id", "n_files"), ("repo_id", "n_repos"), ("module_name", "n_modules"))])


@query("""SELECT coalesce(r.full_name, c.repo_id) AS repo, c.n AS n_chunks FROM (SELECT repo_id, count(DISTINCT chunk_id) AS n FROM code_chunks WHERE repo_id IS NOT NULL GROUP BY repo_id) c
 LEFT JOIN repos r USING (repo_id) ORDER BY n DESC, repo LIMIT 20""")
def group_topk(spark, root):
    """The 20 repositories with most chunks."""
    sizes = distinct_chunks(spark, root, "repo_id").where(F.col("repo_id").isNotNull()).groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_chunks"))
    named = sizes.join(table(spark, root, "repos").select("repo_id", "full_name"), "repo_id", "left")
    return T.top(named.select(F.coalesce("full_name", "repo_id").alias("repo"), "n_chunks"), 20, F.desc("n_chunks"), F.asc("repo"))


@query(f"SELECT source, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('completed', 'failed')) AS other FROM {_REQ} GROUP BY source")
def role_counts(spark, root):
    """A5: filtered counts in one pass."""
    s = F.col("status")
    return requests(spark, root, "source", "status").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("completed", "failed")).alias("other")
    )


@query("SELECT count(DISTINCT repo_id) AS active FROM ai_request_metrics WHERE created_at > (SELECT max(created_at) - INTERVAL 15 MINUTE FROM ai_request_metrics)")
def active_users(spark, root):
    """Distinct repositories active in the last 15 minutes."""
    rows = table(spark, root, "ai_request_metrics").select("repo_id", "created_at")
    last = rows.agg((F.max("created_at") - F.expr("INTERVAL 15 MINUTES")).alias("t")).select("t")
    return rows.where(F.col("created_at") > last.scalar()).agg(F.count_distinct("repo_id").alias("active"))


_P = "round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.9), 4) AS p90, round(quantile_cont(duration_ms, 0.95), 4) AS p95, round(quantile_cont(duration_ms, 0.99), 4) AS p99"


@query(f"SELECT count(*) AS n, round(avg(duration_ms), 4) AS average, {_P}, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM {_WEEK}")
def latency_percentiles(spark, root):
    """Average, exact percentiles and token sums of the last 7 days."""
    tokens = ("prompt_tokens", "completion_tokens", "total_tokens")
    week = T.since(requests(spark, root, "duration_ms", "created_at", *tokens), "created_at", 7, table(spark, root, "ai_request_metrics"))
    week = week.withColumn("all", F.lit(1))
    stats = week.agg(F.max(F.lit(1)).alias("all"), F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 4).alias("average"), *[F.sum(t).alias(t) for t in tokens])
    return T.with_percentiles(stats, week, "all", "duration_ms", (0.5, 0.9, 0.95, 0.99)).drop("all")


@query(f"""WITH m AS (SELECT max(created_at AT TIME ZONE 'UTC') AS t FROM ai_request_metrics),
 a AS (SELECT source, round(avg(duration_ms) FILTER (WHERE made > t - INTERVAL 7 DAY), 4) AS this_week, round(avg(duration_ms) FILTER (WHERE made <= t - INTERVAL 7 DAY), 4) AS last_week
       FROM {_REQ}, m WHERE made > t - INTERVAL 14 DAY GROUP BY source)
 SELECT *, CASE WHEN last_week IS NULL OR last_week = 0 THEN 0 ELSE round(100.0 * (this_week - last_week) / last_week, 2) END AS delta_pct FROM a""")
def trend_delta(spark, root):
    """Average of a week against the week before, in one pass."""
    rows = T.since(requests(spark, root, "source", "duration_ms", "created_at"), "created_at", 14, table(spark, root, "ai_request_metrics"))
    now = table(spark, root, "ai_request_metrics").agg((F.max("created_at") - F.expr("INTERVAL 7 DAYS")).alias("t")).select("t").scalar()
    recent = rows.withColumn("recent", F.col("created_at") > now)
    a = recent.groupBy("source").agg(
        F.round(F.avg(F.when(F.col("recent"), F.col("duration_ms"))), 4).alias("this_week"), F.round(F.avg(F.when(~F.col("recent"), F.col("duration_ms"))), 4).alias("last_week")
    )
    change = F.round(100.0 * (F.col("this_week") - F.col("last_week")) / F.col("last_week"), 2)
    return a.withColumn("delta_pct", F.when(F.col("last_week").isNull() | (F.col("last_week") == 0), 0.0).otherwise(change))


@query(f"""WITH r AS {_REQ}, d AS (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY))::DATE AS day)
 SELECT d.day, a.n, a.average, a.p50, a.p90, a.p99, a.tokens FROM d LEFT JOIN (SELECT day, count(*) AS n, round(avg(duration_ms), 4) AS average, round(quantile_cont(duration_ms, 0.5), 4) AS p50,
 round(quantile_cont(duration_ms, 0.9), 4) AS p90, round(quantile_cont(duration_ms, 0.99), 4) AS p99, sum(total_tokens)::BIGINT AS tokens FROM r GROUP BY day) a ON a.day = d.day""")
def latency_series(spark, root):
    """Daily latency and tokens on a gapless calendar."""
    rows = requests(spark, root, _day(), "duration_ms", "total_tokens")
    stats = T.series(rows, "day", F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 4).alias("average"), F.sum("total_tokens").alias("tokens"))
    return T.with_percentiles(stats, rows, "day", "duration_ms", (0.5, 0.9, 0.99))


@query(f"""SELECT coalesce(p.full_name, 'unassigned') AS repo, count(*) AS n, round(avg(duration_ms), 4) AS average, round(quantile_cont(duration_ms, 0.5), 4) AS p50, round(quantile_cont(duration_ms, 0.9), 4) AS p90
 FROM {_REQ} q LEFT JOIN repos p USING (repo_id) GROUP BY 1 ORDER BY p90 DESC NULLS LAST, n DESC, repo LIMIT 12""")
def latency_by_group(spark, root):
    """The 12 slowest repositories by p90."""
    rows = requests(spark, root, "repo_id", "duration_ms").join(table(spark, root, "repos").select("repo_id", "full_name"), "repo_id", "left")
    named = rows.select(F.coalesce("full_name", F.lit("unassigned")).alias("repo"), "duration_ms")
    stats = named.groupBy("repo").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 4).alias("average"))
    return T.top(T.with_percentiles(stats, named, "repo", "duration_ms", (0.5, 0.9)), 12, F.desc_nulls_last("p90"), F.desc("n"), F.asc("repo"))


@query(f"""WITH r AS {_REQ}, d AS (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY))::DATE AS day)
 SELECT d.day, coalesce(u.n, 0) AS repos, coalesce(c.n, 0) AS chats, coalesce(s.n, 0) AS searches FROM d
 LEFT JOIN (SELECT day, count(DISTINCT repo_id) AS n FROM r GROUP BY day) u ON u.day = d.day LEFT JOIN (SELECT day, count(*) AS n FROM r WHERE source = 'chat' GROUP BY day) c ON c.day = d.day
 LEFT JOIN (SELECT day, count(*) AS n FROM r WHERE source = 'search' GROUP BY day) s ON s.day = d.day""")
def daily_usage(spark, root):
    """Distinct repositories, chats and searches per day, from one scan instead of three."""
    rows = requests(spark, root, _day(), "repo_id", "source")
    counts = T.series(rows, "day", F.count_distinct("repo_id").alias("repos"), F.count_if(F.col("source") == "chat").alias("chats"), F.count_if(F.col("source") == "search").alias("searches"))
    return counts.na.fill(0, ["repos", "chats", "searches"])


@query("""WITH l AS (SELECT coalesce(language, 'unknown') AS language, sum(greatest(1, coalesce(file_count, 0)))::BIGINT AS files FROM repos GROUP BY 1)
 SELECT language, files, round(100.0 * files / (SELECT sum(files) FROM l), 0) AS pct FROM l ORDER BY files DESC, language LIMIT 8""")
def language_distribution(spark, root):
    """The 8 languages with most files, and their share of all."""
    by = table(spark, root, "repos").groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.sum(F.greatest(F.lit(1), F.coalesce("file_count", F.lit(0)))).alias("files"))
    whole = by.agg(F.sum("files").alias("s")).select("s").scalar()
    return T.top(by.withColumn("pct", F.round(100.0 * F.col("files") / whole, 0)), 8, F.desc("files"), F.asc("language"))


@query("""SELECT left(text, 140) AS question, count(*) AS n FROM documents WHERE doc_kind = 'chat' AND length(trim(text, E' ')) >= 3 GROUP BY 1 ORDER BY n DESC, question LIMIT 8""")
def top_queries(spark, root):
    """The 8 most frequent chat questions by their first 140 characters."""
    chats = table(spark, root, "documents").where((F.col("doc_kind") == "chat") & (F.length(F.trim("text")) >= 3))
    return T.top(chats.groupBy(F.left("text", F.lit(140)).alias("question")).agg(F.count(F.lit(1)).alias("n")), 8, F.desc("n"), F.asc("question"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(total_tokens) FILTER (WHERE status = 'completed'), 4) AS average_tokens
 FROM (SELECT * FROM {_REQ} WHERE source = 'pr_review' ORDER BY created_at DESC, request_id LIMIT 100)""")
def recent_review_stats(spark, root):
    """Outcome of the latest 100 reviews."""
    reviews = requests(spark, root, "source", "status", "total_tokens", "created_at").where("source = 'pr_review'")
    recent, s = T.latest(reviews, 100, F.desc("created_at"), F.asc("request_id")), F.col("status")
    return recent.agg(F.count(F.lit(1)).alias("n"), F.count_if(s == "completed").alias("completed"), F.count_if(s == "failed").alias("failed"), F.round(F.avg(F.when(s == "completed", F.col("total_tokens"))), 4).alias("average_tokens"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE (props->>'$.k')::INT >= 50) AS high, max(ts) AS latest FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 200) GROUP BY event_type""")
def recent_event_stats(spark, root):
    """Kinds of the latest 200 events."""
    recent = T.latest(table(spark, root, "events"), 200, F.desc("ts"), F.asc("event_id"))
    k = F.get_json_object("props", "$.k").cast("int")
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(k >= 50).alias("high"), F.max("ts").alias("latest"))


@query(f"""WITH s AS (SELECT DISTINCT ON (chunk_id) chunk_id, repo_id, symbols FROM code_chunks ORDER BY chunk_id, created_at), e AS (SELECT repo_id, unnest(symbols) AS s FROM s)
 SELECT repo_id, kind, n FROM (SELECT repo_id, s.kind AS kind, count(*) AS n, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, s.kind) AS rn FROM e WHERE repo_id IS NOT NULL GROUP BY 1, 2) WHERE rn <= 3""")
def historical_patterns(spark, root):
    """The 3 most frequent kinds of symbols per repository, from nested arrays."""
    each = distinct_chunks(spark, root, "repo_id", F.col("symbols.kind").alias("kinds")).where(F.col("repo_id").isNotNull()).select("repo_id", F.explode("kinds").alias("kind"))
    counts = each.groupBy("repo_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("repo_id").orderBy(F.desc("n"), F.asc("kind"))
    return counts.withColumn("rn", F.row_number().over(order)).where("rn <= 3").drop("rn")


@query(f"SELECT p.org_id, sum(total_tokens)::BIGINT AS tokens FROM {_WEEK} q JOIN repos p USING (repo_id) WHERE p.org_id IS NOT NULL GROUP BY p.org_id HAVING sum(total_tokens) >= 1000")
def token_spike(spark, root):
    """Organisations whose tokens of the week reach a threshold."""
    week = T.since(requests(spark, root, "repo_id", "total_tokens", "created_at"), "created_at", 7, table(spark, root, "ai_request_metrics"))
    owned = table(spark, root, "repos").where("org_id IS NOT NULL").select("repo_id", "org_id")
    return week.join(owned, "repo_id").groupBy("org_id").agg(F.sum("total_tokens").alias("tokens")).where("tokens >= 1000")


@query(f"SELECT model, day, count(*) AS n FROM {_REQ} WHERE metadata LIKE '%\"retries\"%' GROUP BY model, day HAVING count(*) >= 5")
def sustained_flags(spark, root):
    """Models with at least 5 retried requests a day."""
    flagged = requests(spark, root, "model", _day(), "metadata").where(F.contains("metadata", F.lit('"retries"')))
    return flagged.groupBy("model", "day").agg(F.count(F.lit(1)).alias("n")).where("n >= 5")


@query(f"SELECT count(*) AS failures FROM {_WEEK} WHERE status <> 'completed' HAVING count(*) >= 1")
def volume_alert(spark, root):
    """One row if the week's failures reach a threshold, else none."""
    week = T.since(requests(spark, root, "status", "created_at"), "created_at", 7, table(spark, root, "ai_request_metrics"))
    return week.where("status <> 'completed'").agg(F.count(F.lit(1)).alias("failures")).where("failures >= 1")


@query("SELECT doc_kind, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY doc_kind")
def type_stats(spark, root):
    """Documents and characters per kind."""
    return table(spark, root, "documents").groupBy("doc_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast("long")).alias("chars"))


@query(f"""SELECT request_id, recent FROM (SELECT a.request_id, (SELECT count(*) FROM {_REQ} b WHERE b.repo_id = a.repo_id AND b.source = 'agent' AND b.made < a.made AND b.made >= a.made - INTERVAL 1 HOUR) AS recent
 FROM {_REQ} a WHERE a.source = 'agent' AND a.repo_id IS NOT NULL) WHERE recent >= 1""")
def rate_limit(spark, root):
    """Agent runs that start when their repository already had one in the hour before."""
    runs = requests(spark, root, "repo_id", "source", "created_at").where("source = 'agent' AND repo_id IS NOT NULL")
    return T.busy_keys(runs, "repo_id", "created_at", 1, 3600).select("request_id", "recent")


@query("""WITH f AS (SELECT * FROM (SELECT DISTINCT ON (chunk_id) chunk_id, module_name, file_path, line_start, line_end, content, row_number() OVER () AS x FROM code_chunks WHERE module_name IS NOT NULL ORDER BY chunk_id, created_at)),
 r AS (SELECT *, row_number() OVER (PARTITION BY module_name ORDER BY file_path, line_start) AS rn FROM f)
 SELECT module_name, file_path, min(line_start) AS line_start, max(line_end) AS line_end, left(arg_min(content, line_start), 120) AS preview FROM r WHERE rn <= 30 GROUP BY module_name, file_path""")
def module_summary(spark, root):
    """First 30 chunks of each module by file, with span and preview."""
    chunks = distinct_chunks(spark, root, "module_name", "file_path", "line_start", "line_end", F.left("content", F.lit(120)).alias("preview")).where("module_name IS NOT NULL")
    order = Window.partitionBy("module_name").orderBy("file_path", "line_start")
    first = chunks.withColumn("rn", F.row_number().over(order)).where("rn <= 30")
    return first.groupBy("module_name", "file_path").agg(F.min("line_start").alias("line_start"), F.max("line_end").alias("line_end"), F.min_by("preview", "line_start").alias("preview"))


@query(f"SELECT provider, day, count(*) AS n, count(*) FILTER (WHERE status = 'failed') AS failed, coalesce(sum(total_tokens), 0)::BIGINT AS tokens FROM {_REQ} GROUP BY provider, day")
def ops_queries(spark, root):
    """Requests, failures and tokens per provider and day."""
    rows = requests(spark, root, "provider", _day(), "status", "total_tokens")
    return rows.groupBy("provider", "day").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("tokens"))


_BOUNDS = (100, 500, 1000, 5000, 30000)


@query(f"SELECT source, le, CASE le WHEN '+Inf' THEN count(*) ELSE count(*) FILTER (WHERE duration_ms <= try_cast(le AS DOUBLE)) END AS n FROM {_REQ}, (VALUES {', '.join(f"('{b}')" for b in _BOUNDS)}, ('+Inf')) AS q(le) WHERE duration_ms IS NOT NULL GROUP BY source, le")
def histogram(spark, root):
    """Cumulative duration buckets per source."""
    return T.buckets(requests(spark, root, "source", "duration_ms"), "source", "duration_ms", _BOUNDS)


@query(f"""SELECT model, n, p50, p95, p99 FROM (SELECT model, count(*) AS n, max(duration_ms) FILTER (WHERE rn = ceil(0.5 * c)) AS p50, max(duration_ms) FILTER (WHERE rn = ceil(0.95 * c)) AS p95, max(duration_ms) FILTER (WHERE rn = ceil(0.99 * c)) AS p99
 FROM (SELECT model, duration_ms, row_number() OVER (PARTITION BY model ORDER BY duration_ms) AS rn, count(*) OVER (PARTITION BY model) AS c FROM {_REQ} WHERE duration_ms IS NOT NULL) GROUP BY model)""")
def nearest_rank(spark, root):
    """Nearest-rank percentiles, exact, from value frequencies."""
    from tessera.operators.skew import key_percentiles

    rows = requests(spark, root, "model", "duration_ms").where("duration_ms IS NOT NULL")
    points = key_percentiles(rows, "model", "duration_ms", (0.5, 0.95, 0.99))
    wide = points.groupBy("key").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"p{round(p * 100)}") for p in (0.5, 0.95, 0.99)])
    counts = rows.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(wide, counts["model"].eqNullSafe(wide["key"])).drop("key")


@query(f"""WITH u AS (SELECT repo_id, count(*) AS requests FROM {_REQ} WHERE repo_id IS NOT NULL GROUP BY 1), c AS (SELECT repo_id, count(DISTINCT chunk_id) AS chunks, count(DISTINCT file_id) AS files FROM code_chunks WHERE repo_id IS NOT NULL GROUP BY 1),
 d AS (SELECT repo_id, count(*) AS documents FROM documents WHERE repo_id IS NOT NULL GROUP BY 1)
 SELECT r.full_name, r.is_active, coalesce(chunks, 0) AS chunks, coalesce(files, 0) AS files, coalesce(documents, 0) AS documents, coalesce(requests, 0) AS requests FROM repos r LEFT JOIN c USING (repo_id) LEFT JOIN d USING (repo_id) LEFT JOIN u USING (repo_id)""")
def repo_dashboard(spark, root):
    """Repositories with pre-aggregated chunks, documents and requests."""
    there = F.col("repo_id").isNotNull()
    chunks = table(spark, root, "code_chunks").where(there).groupBy("repo_id").agg(F.count_distinct("chunk_id").alias("chunks"), F.count_distinct("file_id").alias("files"))
    documents = table(spark, root, "documents").where(there).groupBy("repo_id").agg(F.count(F.lit(1)).alias("documents"))
    asked = requests(spark, root, "repo_id").where(there).groupBy("repo_id").agg(F.count(F.lit(1)).alias("requests"))
    rows = table(spark, root, "repos").select("repo_id", "full_name", "is_active")
    for part in (chunks, documents, asked):
        rows = rows.join(part, "repo_id", "left")
    return rows.na.fill(0, ["chunks", "files", "documents", "requests"]).drop("repo_id")


@query(f"""SELECT p.org_id, date_trunc('month', q.made)::DATE AS month, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM {_REQ} q JOIN repos p USING (repo_id) WHERE p.org_id IS NOT NULL GROUP BY 1, 2""")
def monthly_usage(spark, root):
    """Token counters per organisation and month, recomputed instead of incremented."""
    rows = requests(spark, root, "repo_id", F.trunc("created_at", "month").alias("month"), "prompt_tokens", "completion_tokens")
    owned = table(spark, root, "repos").where("org_id IS NOT NULL").select("repo_id", "org_id")
    return rows.join(owned, "repo_id").groupBy("org_id", "month").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))


@query(f"""WITH m AS (SELECT p.org_id, date_trunc('month', q.made)::DATE AS month, sum(total_tokens)::BIGINT AS used FROM {_REQ} q JOIN repos p USING (repo_id) GROUP BY 1, 2),
 o AS (SELECT DISTINCT org_id FROM repos WHERE org_id IS NOT NULL) SELECT o.org_id, coalesce(m.used, 0) AS used, coalesce(m.used, 0) >= 1000000 AS over FROM o LEFT JOIN m ON m.org_id = o.org_id AND m.month = DATE '2025-02-01'""")
def usage_vs_cap(spark, root):
    """Every organisation with its usage of a month against a cap."""
    rows = requests(spark, root, "repo_id", F.trunc("created_at", "month").alias("month"), "total_tokens").where("month = DATE '2025-02-01'")
    owned = table(spark, root, "repos").where("org_id IS NOT NULL").select("repo_id", "org_id")
    used = rows.join(owned, "repo_id").groupBy("org_id").agg(F.sum("total_tokens").alias("used"))
    return owned.select("org_id").distinct().join(used, "org_id", "left").na.fill(0, ["used"]).withColumn("over", F.col("used") >= 1_000_000)


@query("""SELECT * FROM (SELECT 'request' AS kind, request_id AS id, created_at AT TIME ZONE 'UTC' AS made FROM (SELECT DISTINCT ON (request_id) * FROM ai_request_metrics ORDER BY request_id) ORDER BY made DESC, id LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'document', doc_id::VARCHAR AS id, created_at AT TIME ZONE 'UTC' AS made FROM documents ORDER BY made DESC, id LIMIT 10) ORDER BY made DESC, id LIMIT 15""")
def recent_activity(spark, root):
    """The 15 latest of the latest of two logs."""
    asked = requests(spark, root, "created_at").select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), F.col("created_at").cast("timestamp_ntz").alias("made"))
    written = table(spark, root, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id"), F.col("created_at").cast("timestamp_ntz").alias("made"))
    order = (F.desc("made"), F.asc("id"))
    return T.top(T.top(asked, 10, *order).unionByName(T.top(written, 10, *order)), 15, *order)
