"""Registered queries of filters, retrieval, ranking and extraction by expressions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import retrieval as R
from tessera.plans.registering import book
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL, query = book()

TOKENS = ("ledger", "quiver", "notice")
_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at)"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_GOOD = f"(SELECT chunk_id, repo_id, file_path, content, embedding::DOUBLE[] AS e FROM {_CHUNKS} WHERE {_USABLE})"
_ASKED = f"(SELECT arg_min(e, chunk_id) AS q FROM {_GOOD})"
_WORDS = "list_filter(string_split_regex(lower({}), '[^a-z0-9]+'), lambda t: length(t) > 1)"


def _tf(column, token):
    return f"len(list_filter({_WORDS.format(column)}, lambda w: w = '{token}'))::DOUBLE"


def _lexical(column):
    return " + ".join(f"{_tf(column, t)} / ({_tf(column, t)} + 1)" for t in TOKENS)


def _asked(spark, root):
    """The vector asked for: that of the least chunk_id with a usable one, as a scalar subquery."""
    rows = table(spark, root, "code_chunks").where(R.usable_vector(F.col("embedding")))
    return rows.agg(F.min_by("embedding", "chunk_id").alias("e")).select("e").scalar()


@query(f"""SELECT chunk_id FROM {_CHUNKS} WHERE (repo_id IN (SELECT repo_id FROM repos WHERE org_id = 'org-kirholm') OR repo_id IS NULL) AND nest_role = 'service' AND language = 'typescript'""")
def scoped_filter(spark, root):
    """chunks of an organisation's repositories or of none, by role and language."""
    scope = table(spark, root, "repos").where("org_id = 'org-kirholm'").select("repo_id")
    rows = distinct_chunks(spark, root, "repo_id", "nest_role", "language").where("nest_role = 'service' AND language = 'typescript'")
    return rows.join(scope, "repo_id", "left_semi").select("chunk_id").unionByName(rows.where("repo_id IS NULL").select("chunk_id"))


@query(f"SELECT chunk_id FROM {_CHUNKS} WHERE len(list_filter(symbols, lambda s: s.kind = 'class' AND s.exported)) > 0")
def json_containment(spark, root):
    """chunks whose nested symbols hold an exported class; no explode."""
    has = F.exists("symbols", lambda s: (s["kind"] == "class") & s["exported"])
    return distinct_chunks(spark, root, has.alias("has")).where("has").select("chunk_id")


@query(f"SELECT chunk_id, len(list_filter(imports, lambda i: i.source ILIKE '%.service')) AS n FROM {_CHUNKS} WHERE len(list_filter(imports, lambda i: i.source ILIKE '%.service')) > 0")
def json_semi_join(spark, root):
    """chunks that import a service, and how often."""
    n = F.size(F.filter("imports", lambda i: i["source"].ilike("%.service")))
    return distinct_chunks(spark, root, n.cast("long").alias("n")).where("n > 0")


@query(f"SELECT file_path, line_start, line_end FROM {_CHUNKS} WHERE module_name = (SELECT min(module_name) FROM code_chunks) ORDER BY file_path, line_start LIMIT 50")
def module_lookup(spark, root):
    """the chunks of one module in order of lines."""
    first = table(spark, root, "code_chunks").agg(F.min("module_name").alias("m")).select("m").scalar()
    rows = distinct_chunks(spark, root, "module_name", "file_path", "line_start", "line_end").where(F.col("module_name") == first)
    return rows.select("file_path", "line_start", "line_end").orderBy("file_path", "line_start").limit(50)


_RULES = {
    "todo": r"\bTODO\b",
    "bare_except": r"except\s*(?:\(|:|Exception)",
    "any_type": r":\s*any\b",
    "env_secret": r"(?i)(?:password|secret)\s*[:=]",
    "deep_nesting": r"(?m)^(?: {16}|\t{4})\S",
}


@query("SELECT rule, count(*) AS n_chunks, count(DISTINCT file_id) AS n_files FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, file_id FROM {_CHUNKS} WHERE regexp_matches(content, '{v}')" for k, v in _RULES.items()) + ") GROUP BY rule")
def regex_rules(spark, root):
    """Rules as regular expressions, all of them in one scan."""
    hit = F.filter(F.array(*[F.when(F.col("content").rlike(v), F.lit(k)) for k, v in _RULES.items()]), lambda x: x.isNotNull())
    rows = distinct_chunks(spark, root, "file_id", hit.alias("rules")).select("file_id", F.explode("rules").alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_distinct("file_id").alias("n_files"))


@query("SELECT rule, chunk_id FROM (SELECT rule, chunk_id, row_number() OVER (PARTITION BY rule ORDER BY chunk_id) AS rn FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS rule, chunk_id FROM {_CHUNKS} WHERE regexp_matches(content, '{v}')" for k, v in _RULES.items()) + ")) WHERE rn <= 20")
def rule_table_join(spark, root):
    """at most 20 examples of each rule, all rules in one scan instead of a join of texts and rules; the limit of each rule is cut before the shuffle."""
    hit = F.filter(F.array(*[F.when(F.col("content").rlike(v), F.lit(k)) for k, v in _RULES.items()]), lambda x: x.isNotNull())
    rows = distinct_chunks(spark, root, hit.alias("rules")).select("chunk_id", F.explode("rules").alias("rule"))
    order = Window.partitionBy("rule").orderBy("chunk_id")
    return rows.withColumn("rn", F.row_number().over(order)).where("rn <= 20").drop("rn")


@query(f"SELECT c.chunk_id FROM {_CHUNKS} c WHERE regexp_matches(content, '{_RULES['any_type']}') AND NOT EXISTS (SELECT 1 FROM imports i WHERE i.file_id = c.file_id AND i.confidence = 'AMBIGUOUS')")
def dismissed_anti(spark, root):
    """F8: findings without those of dismissed files."""
    found = distinct_chunks(spark, root, "file_id", F.col("content").rlike(_RULES["any_type"]).alias("hit")).where("hit")
    dismissed = table(spark, root, "imports").where("confidence = 'AMBIGUOUS'").select("file_id").distinct()
    return found.join(dismissed, "file_id", "left_anti").select("chunk_id")


@query("SELECT request_id, provider FROM (SELECT DISTINCT ON (request_id) * FROM ai_request_metrics ORDER BY request_id) WHERE completed_at IS NULL AND created_at < (SELECT max(created_at) - INTERVAL 30 DAY FROM ai_request_metrics)")
def expired(spark, root):
    """requests that never completed and are older than 30 days."""
    rows = table(spark, root, "ai_request_metrics").select("request_id", "provider", "completed_at", "created_at")
    last = rows.agg((F.max("created_at") - F.expr("INTERVAL 30 DAYS")).alias("t")).select("t").scalar()
    return rows.dropDuplicates(["request_id"]).where(F.col("completed_at").isNull() & (F.col("created_at") < last)).select("request_id", "provider")


@query("SELECT lower(a.repo_full_name) AS repo, count(DISTINCT a.request_id) AS n FROM ai_request_metrics a JOIN repos r ON lower(r.full_name) = lower(a.repo_full_name) GROUP BY 1")
def folded_names(spark, root):
    """names joined without regard to case."""
    asked = table(spark, root, "ai_request_metrics").select("request_id", F.lower("repo_full_name").alias("repo")).dropDuplicates(["request_id"])
    names = table(spark, root, "repos").select(F.lower("full_name").alias("repo"))
    return asked.join(names, "repo").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT node_id, name, qualified FROM symbols WHERE qualified ILIKE '%\_s%' ESCAPE '\' ORDER BY (name = 'yystep') DESC, qualified, node_id LIMIT 10")
def like_escape(spark, root):
    """A search pattern with an escaped wildcard; exact names first."""
    rows = table(spark, root, "symbols").where(F.col("qualified").ilike(r"%\_s%"))
    return rows.orderBy((F.col("name") == "yystep").desc(), "qualified", "node_id").limit(10).select("node_id", "name", "qualified")


@query()
def find_symbol(spark, root):
    """The definitions of the most frequent name, with their files."""
    symbols = table(spark, root, "symbols")
    counts = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), F.asc("name")).limit(1).select("name").scalar()
    return symbols.where((F.col("name") == best) & (F.col("kind") != "const")).join(distinct_chunks(spark, root, "file_path"), "chunk_id").select("name", "file_path", "kind")


SQL["find_symbol"] = f"SELECT s.name, c.file_path, s.kind FROM symbols s JOIN {_CHUNKS} c USING (chunk_id) WHERE s.kind <> 'const' AND s.name = (SELECT name FROM symbols GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


@query(f"SELECT chunk_id, repo_id, round(list_cosine_similarity(e, q), 6) AS similarity FROM {_GOOD}, {_ASKED} WHERE list_cosine_similarity(e, q) >= 0.3 ORDER BY similarity DESC, chunk_id LIMIT 8")
def semantic_topk(spark, root):
    """The 8 chunks most similar to a vector."""
    rows = table(spark, root, "code_chunks").select("chunk_id", "repo_id", "embedding")
    return R.nearest(rows, "chunk_id", "embedding", _asked(spark, root), 8, 0.3)


@query(f"SELECT doc_id, round({_lexical('text')}, 6) AS score FROM documents WHERE text IS NOT NULL AND {_lexical('text')} > 0 ORDER BY score DESC, doc_id LIMIT 8")
def keyword_search(spark, root):
    """The 8 documents with the best lexical score."""
    return R.keyword(table(spark, root, "documents").select("doc_id", "text"), "doc_id", "text", TOKENS, 8)


@query(f"SELECT chunk_id, round(0.7 * list_cosine_similarity(e, q) + 0.3 * (({_lexical('content')}) / {len(TOKENS)}), 6) AS score FROM {_GOOD}, {_ASKED} ORDER BY score DESC, chunk_id LIMIT 8")
def hybrid_search(spark, root):
    """Vector and lexical score blended."""
    rows = table(spark, root, "code_chunks").select("chunk_id", "content", "embedding")
    return R.hybrid(rows, "chunk_id", "content", "embedding", _asked(spark, root), TOKENS, 8)


_MATCHED = " + ".join(f"(contains(lower(content), '{t}'))::INT::DOUBLE" for t in TOKENS)


@query(f"""WITH n AS (SELECT chunk_id, content, list_distance(e, q) AS d FROM {_GOOD}, {_ASKED} ORDER BY d, chunk_id LIMIT 20)
 SELECT chunk_id, round(least(1, 0.9 * greatest(0, least(1, 1 - d / 2)) + 0.1 * ({_MATCHED}) / {len(TOKENS)}), 6) AS score, left(content, 120) AS preview FROM n ORDER BY score DESC, chunk_id LIMIT 5""")
def local_search(spark, root):
    """Nested top-k with a rerank."""
    rows = table(spark, root, "code_chunks").select("chunk_id", "content", "embedding")
    return R.reranked(rows, "chunk_id", "content", "embedding", _asked(spark, root), TOKENS)


_STOP = "the a an and or to for of in on with how what where when why which show find list get give all from into that this these those does do is are be about please".split()
_TOKENS = "list_filter(string_split(lower(regexp_replace(regexp_replace(text, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^a-zA-Z0-9_./-]+', ' ', 'g')), ' '), lambda t: length(t) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in _STOP) + "], t))"


@query(f"SELECT token, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest({_TOKENS}) AS token FROM documents WHERE doc_kind = 'chat') GROUP BY token")
def token_document_counts(spark, root):
    """How many chats have each token (all tokens, not the first few)."""
    chats = table(spark, root, "documents").where("doc_kind = 'chat'").select(F.explode(X.search_tokens(F.col("text"), 1 << 30)).alias("token"))
    return chats.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT chunk_id, max(similarity) AS similarity FROM (" + " UNION ALL ".join(f"SELECT chunk_id, ({1.0 - 0.1 * k})::DOUBLE AS similarity FROM {_CHUNKS} WHERE contains(lower(content), '{t}')" for k, t in enumerate(TOKENS)) + ") GROUP BY chunk_id ORDER BY similarity DESC, chunk_id LIMIT 24")
def token_expand(spark, root):
    """Hits of all tokens merged, the best kept; one scan instead of one query a token."""
    best = F.greatest(*[F.when(F.contains(F.lower("content"), F.lit(t)), F.lit(round(1.0 - 0.1 * k, 1))) for k, t in enumerate(TOKENS)])
    hits = distinct_chunks(spark, root, best.alias("similarity")).where("similarity IS NOT NULL")
    return hits.orderBy(F.desc("similarity"), "chunk_id").limit(24)


@query(f"SELECT file_path, chunk_id, line_start FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY line_start, chunk_id) AS rn FROM {_CHUNKS} WHERE len(list_filter(imports, lambda i: i.source ILIKE '%ledger%')) > 0) WHERE rn = 1 ORDER BY file_path LIMIT 50")
def distinct_on(spark, root):
    """K4, K5: the first matching chunk of each file."""
    hit = F.exists("imports", lambda i: i["source"].ilike("%ledger%"))
    rows = distinct_chunks(spark, root, "file_path", "line_start", hit.alias("hit")).where("hit")
    first = rows.groupBy("file_path").agg(F.min(F.struct("line_start", "chunk_id")).alias("x"))
    return first.select("file_path", "x.chunk_id", "x.line_start").orderBy("file_path").limit(50)


@query(f"""WITH h AS (SELECT chunk_id, file_path, round({_lexical('content')}, 6) AS score FROM {_CHUNKS}), r AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, chunk_id) AS rn FROM h WHERE score > 0)
 SELECT chunk_id, file_path, score FROM r ORDER BY (rn > 1), score DESC, chunk_id LIMIT 12""")
def diverse_pick(spark, root):
    """K8: the best chunk of each file first, then the rest."""
    scored = distinct_chunks(spark, root, "file_path", F.round(R.lexical_score(F.col("content"), TOKENS), 6).alias("score")).where("score > 0")
    order = Window.partitionBy("file_path").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rn", F.row_number().over(order)).orderBy(F.col("rn") > 1, F.desc("score"), "chunk_id").limit(12).drop("rn")


@query(f"SELECT repo_id, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, chunk_id) AS rn FROM (SELECT repo_id, chunk_id, round({_lexical('content')}, 6) AS score FROM {_CHUNKS} WHERE repo_id IS NOT NULL) WHERE score > 0) WHERE rn <= 3")
def similar_per_group(spark, root):
    """The 3 best chunks of each repository."""
    scored = distinct_chunks(spark, root, "repo_id", F.round(R.lexical_score(F.col("content"), TOKENS), 6).alias("score")).where("score > 0 AND repo_id IS NOT NULL")
    order = Window.partitionBy("repo_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rn", F.row_number().over(order)).where("rn <= 3").drop("rn")


@query("SELECT doc_id, created_at AT TIME ZONE 'UTC' AS made FROM documents WHERE doc_kind = 'chat' ORDER BY made, doc_id LIMIT 20")
def oldest_n(spark, root):
    """The oldest 20 chats, as the history view returns them."""
    rows = table(spark, root, "documents").where("doc_kind = 'chat'").select("doc_id", F.col("created_at").cast("timestamp_ntz").alias("made"))
    return rows.orderBy("made", "doc_id").limit(20)


@query("SELECT repo_id, full_name FROM repos ORDER BY full_name LIMIT 25 OFFSET 50")
def page(spark, root):
    """The third page of repositories."""
    return table(spark, root, "repos").select("repo_id", "full_name").orderBy("full_name").offset(50).limit(25)


@query()
def default_pick(spark, root):
    """The first active repository of each organisation, else the first."""
    return table(spark, root, "repos").groupBy("org_id").agg(F.min_by("full_name", F.struct(~F.col("is_active"), F.col("full_name"))).alias("chosen"))


SQL["default_pick"] = "SELECT org_id, arg_min(full_name, CASE WHEN is_active THEN '0' ELSE '1' END || full_name) AS chosen FROM repos GROUP BY org_id"


@query("SELECT doc_id, string_agg(n, ',' ORDER BY pos) AS refs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '#(\\d+)', 1)) AS n, generate_subscripts(regexp_extract_all(text, '#(\\d+)', 1), 1) AS pos FROM documents) WHERE pos <= 20 GROUP BY doc_id")
def issue_refs(spark, root):
    """The first 20 issue numbers of each document."""
    refs = F.slice(F.regexp_extract_all("text", F.lit(r"#(\d+)"), F.lit(1)), 1, 20)
    return table(spark, root, "documents").select("doc_id", F.array_join(refs, ",").alias("refs")).where("refs != ''")


@query(r"SELECT doc_id, regexp_extract(text, '^([^\s:]+):(\d+)', 1) AS file_path, try_cast(regexp_extract(text, '^([^\s:]+):(\d+)', 2) AS INT) AS line FROM documents WHERE doc_kind = 'review' AND regexp_matches(text, '^[^\s:]+:\d+')")
def line_span(spark, root):
    """File and line a review speaks of."""
    rows = table(spark, root, "documents").where("doc_kind = 'review'").where(F.col("text").rlike(r"^[^\s:]+:\d+"))
    part = lambda k: F.regexp_extract("text", r"^([^\s:]+):(\d+)", k)
    return rows.select("doc_id", part(1).alias("file_path"), part(2).try_cast("int").alias("line"))


@query(r"""SELECT DISTINCT file_path, coalesce(upper(left(m, 1)) || substr(m, 2) || 'Module', '') AS module FROM (SELECT file_path, nullif(regexp_extract(file_path, '(?:^|/)src/([^/]+)/', 1), '') AS m FROM code_chunks) WHERE m IS NOT NULL""")
def module_names(spark, root):
    """Module names from paths."""
    name = F.regexp_extract("file_path", "(?:^|/)src/([^/]+)/", 1)
    rows = table(spark, root, "code_chunks").select("file_path", name.alias("m")).where("m != ''")
    return rows.select("file_path", F.concat(F.upper(F.left("m", F.lit(1))), F.expr("substr(m, 2)"), F.lit("Module")).alias("module")).distinct()


@query(r"""WITH l AS (SELECT chunk_id, line_start, generate_subscripts(string_split(content, chr(10)), 1) AS k, unnest(string_split(content, chr(10))) AS line FROM (SELECT DISTINCT ON (chunk_id) chunk_id, line_start, content FROM code_chunks WHERE nest_role IS NOT NULL ORDER BY chunk_id, created_at)),
 n AS (SELECT *, lead(line) OVER (PARTITION BY chunk_id ORDER BY k) AS next FROM l)
 SELECT chunk_id, (line_start + k - 1)::INT AS line_no, regexp_extract(line, '@(\w+)', 1) AS decorator, regexp_extract(next, 'class\s+(\w+)', 1) AS target FROM n WHERE regexp_matches(line, '^\s*@\w+')""")
def endpoint_scan(spark, root):
    """Decorated lines of files with a role and the class declared on the line that follows; routes are in `endpoints`."""
    rows = distinct_chunks(spark, root, "nest_role", "line_start", "content").where("nest_role IS NOT NULL")
    lines = F.split("content", "\n")
    pairs = rows.select("chunk_id", "line_start", F.posexplode(F.arrays_zip(lines.alias("line"), F.expr("slice(split(content, '\\n'), 2, 1000000)").alias("next"))).alias("k", "p"))
    hits = pairs.where(F.col("p.line").rlike(r"^\s*@\w+"))
    target = F.regexp_extract(F.coalesce("p.next", F.lit("")), r"class\s+(\w+)", 1)
    return hits.select("chunk_id", (F.col("line_start") + F.col("k")).alias("line_no"), F.regexp_extract("p.line", r"@(\w+)", 1).alias("decorator"), F.when(F.col("p.next").isNull(), F.lit(None)).otherwise(target).alias("target"))


@query("""SELECT CASE WHEN doc_kind = 'source' THEN 'code' WHEN regexp_matches(text, '(?i)(error|exception|fail)') THEN 'debugging' WHEN regexp_matches(text, '(?i)(test|spec)') THEN 'testing' WHEN regexp_matches(text, '(?i)(deploy|release|version)') THEN 'release'
 WHEN regexp_matches(text, '(?i)(refactor|clean)') THEN 'refactoring' ELSE 'general' END AS category, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def keyword_category(spark, root):
    """Scalar functions: first matching class of an ordered list of patterns."""
    t = F.col("text")
    category = F.when(F.col("doc_kind") == "source", "code")
    for pattern, name in (("error|exception|fail", "debugging"), ("test|spec", "testing"), ("deploy|release|version", "release"), ("refactor|clean", "refactoring")):
        category = category.when(t.rlike(f"(?i)({pattern})"), name)
    return table(spark, root, "documents").where(t.isNotNull()).groupBy(category.otherwise("general").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT coalesce(CASE WHEN json_valid(metadata) THEN metadata->>'$.cache' END, 'none') AS cache, count(*) AS n, coalesce(sum(CASE WHEN json_valid(metadata) THEN try_cast(metadata->>'$.retries' AS BIGINT) END), 0)::BIGINT AS retries
 FROM (SELECT DISTINCT ON (request_id) metadata FROM ai_request_metrics ORDER BY request_id) GROUP BY 1""")
def json_fields(spark, root):
    """Scalar functions: fields of open JSON; what is no JSON counts as none."""
    rows = table(spark, root, "ai_request_metrics").select("request_id", F.from_json("metadata", "cache string, retries bigint").alias("m")).dropDuplicates(["request_id"])
    return rows.groupBy(F.coalesce("m.cache", F.lit("none")).alias("cache")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("m.retries"), F.lit(0)).alias("retries"))
