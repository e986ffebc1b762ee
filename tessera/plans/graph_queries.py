"""Registered queries of dependency graphs, identity and confidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import graph as G
from tessera.plans.registering import book
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL, query = book()

_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at)"
_EDGES = "(SELECT DISTINCT ON (edge_id) edge_id, file_id, src_file, target_path, confidence FROM imports ORDER BY edge_id)"


def edges(spark, root):
    """Import edges, repeated rows once: src is the file, dst what it names."""
    rows = table(spark, root, "imports").dropDuplicates(["edge_id"])
    return rows.select("edge_id", F.col("src_file").alias("src"), F.col("target_path").alias("dst"), "confidence")


def trade(spark, root):
    """A small graph with cycles: each nation's customers to the two nations that supply them most, over all orders."""
    nation = lambda name, key: table(spark, root, name).select(key, F.col(f"{key[0]}_nationkey").alias(f"{key[0]}n"))
    lines = table(spark, root, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice")
    orders = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    flow = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(nation("customer", "c_custkey"), F.col("o_custkey") == F.col("c_custkey")).join(nation("supplier", "s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = flow.groupBy(F.col("cn").alias("src"), F.col("sn").alias("dst")).agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))
    return sums.withColumn("rn", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("value"), "dst"))).where("rn <= 2").drop("rn")


_TRADE = """trade AS (SELECT src, dst, value FROM (SELECT src, dst, value, row_number() OVER (PARTITION BY src ORDER BY value DESC, dst) AS rn FROM (SELECT c_nationkey AS src, s_nationkey AS dst, round(sum(l_extendedprice), 2) AS value
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)) WHERE rn <= 2)"""


_ENDINGS = ", ".join(f"({k}, '{e}')" for k, e in enumerate(["", ".ts", ".tsx", "/index.ts", "/index.tsx", ".js", ".vue", ".py", "/__init__.py", ".go", ".java", ".kt", ".php", ".rs"]))
_FORMS = ", ".join(f"('{e}')" for e in [".ts", ".tsx", "/index.ts", ".py", "/__init__.py", ".go", ".java", ".kt", ".php", ".rs", ""])
_NORMAL = "array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split({}, '/'), lambda q: [q])), lambda done, q: CASE WHEN q[1] IN ('', '.') THEN done WHEN q[1] = '..' THEN done[1 : len(done) - 1] ELSE list_concat(done, q) END), '/')"


def _resolution(wanted):
    """SQL of resolution: ``wanted`` gives repo, src, target; res has repo, src, target, resolved."""
    up = "CASE WHEN regexp_matches(target, '^\\.+[A-Za-z_]') THEN repeat('../', greatest(length(regexp_extract(target, '^(\\.+)', 1)) - 1, 0)) || replace(ltrim(target, '.'), '.', '/') ELSE base END"
    return f"""f AS (SELECT DISTINCT coalesce(repo_id, '') AS repo, file_path FROM code_chunks), w AS ({wanted}),
 b AS (SELECT *, regexp_replace(target, '\\.(ts|tsx|js|jsx|py|go|java|kt|php|rs)$', '') AS base FROM w WHERE target NOT LIKE 'pkg:%'),
 near AS (SELECT *, {_NORMAL.format(f"regexp_replace(src, '[^/]*$', '') || {up}")} AS path FROM b WHERE target LIKE '.%'),
 far AS (SELECT *, CASE WHEN NOT contains(base, '/') AND contains(base, '.') THEN replace(base, '.', '/') ELSE regexp_replace(base, '^[@~]/', '') END AS clean FROM b WHERE target NOT LIKE '.%'),
 hit AS (SELECT near.repo, src, target, arg_min(f.file_path, rank) AS resolved FROM near, (VALUES {_ENDINGS}) AS e(rank, ending), f WHERE f.repo = near.repo AND f.file_path = path || ending GROUP BY 1, 2, 3
  UNION ALL SELECT far.repo, src, target, min(f.file_path) FROM far, (VALUES {_FORMS}) AS e(ending), f WHERE f.repo = far.repo AND ends_with(f.file_path, '/' || clean || ending) GROUP BY 1, 2, 3),
 res AS (SELECT w.*, hit.resolved FROM w LEFT JOIN hit USING (repo, src, target))"""


_OWN = "(SELECT file_id, min(coalesce(repo_id, '')) AS repo FROM code_chunks GROUP BY file_id)"
_IMPORTED = _resolution(f"SELECT DISTINCT repo, src_file AS src, target_path AS target FROM {_EDGES} JOIN {_OWN} USING (file_id)")
_RESOLVED = f"{_IMPORTED}, e AS (SELECT DISTINCT repo || ':' || src AS src, repo || ':' || resolved AS dst FROM res WHERE resolved IS NOT NULL)"
_NESTED = "SELECT DISTINCT repo, file_path AS src, i.source AS target FROM (SELECT file_id, file_path, unnest(imports) AS i FROM code_chunks) JOIN " + _OWN + " USING (file_id)"


def _files(spark, root):
    return distinct_chunks(spark, root, "file_id", "file_path", F.coalesce("repo_id", F.lit("")).alias("repo"))


@query(f"WITH {_IMPORTED} SELECT edge_id, src_file, target_path, resolved FROM {_EDGES} JOIN {_OWN} o USING (file_id) JOIN res ON res.repo = o.repo AND res.src = src_file AND res.target = target_path")
def dependency_edges(spark, root):
    """Imports with the file they resolve to."""
    files = _files(spark, root)
    of_file = files.groupBy("file_id").agg(F.min("repo").alias("repo"))
    rows = table(spark, root, "imports").dropDuplicates(["edge_id"]).join(of_file, "file_id").select("edge_id", "src_file", "target_path", "repo")
    return G.resolve_imports(rows, files).select("edge_id", "src_file", "target_path", "resolved")


def _nested(spark, root):
    """Imports nested in chunks: repo, src_file, file_id, target_path, names."""
    rows = distinct_chunks(spark, root, "file_id", "file_path", "imports")
    of_file = _files(spark, root).groupBy("file_id").agg(F.min("repo").alias("repo"))
    each = rows.select("file_id", F.col("file_path").alias("src_file"), F.explode("imports").alias("i")).select("file_id", "src_file", F.col("i.source").alias("target_path"), "i.names")
    return each.where("target_path IS NOT NULL").join(of_file, "file_id")


@query(f"WITH {_resolution(_NESTED)} SELECT repo, src, target, resolved FROM res")
def module_edges(spark, root):
    """Imports as the source writes them, relative, aliased or dotted, with the file they resolve to."""
    rows = _nested(spark, root).select("repo", "src_file", "target_path").distinct()
    return G.resolve_imports(rows, _files(spark, root)).select("repo", F.col("src_file").alias("src"), F.col("target_path").alias("target"), "resolved")


@query(f"""WITH {_resolution(_NESTED)}, d AS (SELECT repo, resolved, count(DISTINCT src) AS n FROM res WHERE resolved IS NOT NULL GROUP BY 1, 2), best AS (SELECT repo, resolved FROM d ORDER BY n DESC, repo, resolved LIMIT 1),
 u AS (SELECT DISTINCT r.repo, r.src, nm.name FROM res r JOIN best USING (repo, resolved) JOIN (SELECT repo, file_path AS src, i.source AS target, unnest(i.names) AS name FROM (SELECT file_id, file_path, unnest(imports) AS i FROM code_chunks) JOIN {_OWN} USING (file_id)) nm USING (repo, src, target)),
 g AS (SELECT r.repo, r.src, count(u.name) AS n_symbols, string_agg(u.name, ',' ORDER BY u.name) AS used, string_agg(u.name, ',' ORDER BY u.name) FILTER (WHERE contains(lower(u.name), 'state')) AS states FROM (SELECT DISTINCT repo, src FROM res JOIN best USING (repo, resolved)) r LEFT JOIN u USING (repo, src) GROUP BY 1, 2)
 SELECT src AS dependent, coalesce(used, '') AS used_symbols, coalesce(states, used, '') AS state_names FROM g""")
def dependents_of_file(spark, root):
    """Files that import the most imported file, with the symbols they use of it; those of its state, or all if none is."""
    rows, files = _nested(spark, root), _files(spark, root)
    found = G.resolve_imports(rows, files).where("resolved IS NOT NULL")
    counts = found.groupBy("repo", "resolved").agg(F.count_distinct("src_file").alias("n")).orderBy(F.desc("n"), "repo", "resolved").limit(1).select("repo", "resolved")
    used = found.join(F.broadcast(counts), ["repo", "resolved"]).groupBy("src_file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("used"))
    states = F.filter("used", lambda x: F.contains(F.lower(x), F.lit("state")))
    return used.select(F.col("src_file").alias("dependent"), F.array_join("used", ",").alias("used_symbols"), F.array_join(F.when(F.size(states) > 0, states).otherwise(F.col("used")), ",").alias("state_names"))


def resolved_edges(spark, root):
    """Resolved imports between files, each as repo:path: src is the importing file, dst the imported one."""
    files = _files(spark, root)
    of_file = files.groupBy("file_id").agg(F.min("repo").alias("repo"))
    rows = table(spark, root, "imports").dropDuplicates(["edge_id"]).join(of_file, "file_id").select("src_file", "target_path", "repo")
    name = lambda path: F.concat("repo", F.lit(":"), path)
    return G.resolve_imports(rows, files).where("resolved IS NOT NULL").select(name(F.col("src_file")).alias("src"), name(F.col("resolved")).alias("dst")).distinct()


def resolved_files(spark, root):
    """(file_id, target_file): resolved imports between files by their ids."""
    files = _files(spark, root)
    of_file = files.groupBy("file_id").agg(F.min("repo").alias("repo"))
    rows = table(spark, root, "imports").dropDuplicates(["edge_id"]).join(of_file, "file_id").select("file_id", "src_file", "target_path", "repo")
    names = files.groupBy("repo", F.col("file_path").alias("resolved")).agg(F.min("file_id").alias("target_file"))
    return G.resolve_imports(rows, files).where("resolved IS NOT NULL").join(names, ["repo", "resolved"]).select("file_id", "target_file").distinct()


def impact_of_each(found):
    """(file, node, depth): for every dst of the edges, whatever depends on it, at any distance."""
    back = found.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reachable(back, back.select(F.col("src").alias("node"), F.col("src").alias("file")), origin="file")


@query(f"""WITH RECURSIVE {_RESOLVED}, r(file, impacted, depth) AS (SELECT dst, src, 1 FROM e UNION SELECT r.file, e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.impacted WHERE r.depth < 40) SELECT file, impacted, min(depth)::INT AS depth FROM r GROUP BY 1, 2""")
def import_impact(spark, root):
    """For every file, the files that import it directly or through others, by resolved imports."""
    return impact_of_each(resolved_edges(spark, root)).select("file", F.col("node").alias("impacted"), "depth")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT target_path AS file, src_file AS impacted FROM imports WHERE target_path IS NOT NULL AND src_file IS NOT NULL),
 r(file, impacted) AS (SELECT file, impacted FROM e UNION SELECT r.file, e.impacted FROM r JOIN e ON e.file = r.impacted) SELECT file, impacted FROM r""")
def import_impact_written(spark, root):
    """The same by the names that imports are written with."""
    found = edges(spark, root).where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    return impact_of_each(found).select("file", F.col("node").alias("impacted"))


_CYCLES = f"""WITH RECURSIVE {_RESOLVED}, p(path, last, n) AS (SELECT [src], dst, 1 FROM e WHERE dst >= src UNION ALL SELECT list_append(p.path, p.last), e.dst, p.n + 1 FROM p JOIN e ON e.src = p.last WHERE p.n < 5 AND p.last > p.path[1] AND NOT list_contains(p.path, p.last) AND e.dst >= p.path[1])"""


@query(f"{_CYCLES} SELECT array_to_string(list_sort(path), '>') AS members, min(n)::INT AS length FROM p WHERE last = path[1] GROUP BY 1")
def import_cycles(spark, root):
    """Cycles of up to 5 resolved imports, once per set of members."""
    return G.cycles(resolved_edges(spark, root), 5)


@query(f"""WITH RECURSIVE {_RESOLVED}, r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b) SELECT x.a AS file, min(x.b) AS component, count(*) AS size FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY 1""")
def import_components(spark, root):
    """Files on import cycles of any length, by strongly connected component."""
    return G.components(impact_of_each(resolved_edges(spark, root)), "file").withColumnRenamed("node", "file")


@query(f"""WITH RECURSIVE {_RESOLVED}, t AS (SELECT dst FROM e GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), r(node, depth) AS (SELECT src, 1 FROM e WHERE dst IN (SELECT dst FROM t) UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.node WHERE r.depth < 40) SELECT node AS impacted, min(depth)::INT AS depth FROM r GROUP BY 1""")
def impact(spark, root):
    """What a change of the most imported file reaches, by breadth."""
    found = resolved_edges(spark, root)
    start = found.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").limit(1).select(F.col("dst").alias("node"))
    return G.reachable(found.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select(F.col("node").alias("impacted"), "depth")


@query(f"""{_CYCLES} SELECT DISTINCT unnest(path) AS file FROM p WHERE last = path[1]""")
def bounded_cycles(spark, root):
    """Files on a cycle of up to 5 resolved imports."""
    return G.cycles(resolved_edges(spark, root), 5).select(F.explode(F.split("members", ">")).alias("file")).distinct()


@query(f"SELECT target_path AS dst, count(DISTINCT src_file) AS n FROM {_EDGES} GROUP BY 1 ORDER BY n DESC, dst LIMIT 20")
def hotspots(spark, root):
    """The 20 most imported targets."""
    return G.in_degrees(edges(spark, root)).orderBy(F.desc("n"), "dst").limit(20)


@query("""WITH p AS (SELECT DISTINCT src_file AS src, target_path AS dst FROM imports), i AS (SELECT dst AS node, count(*) AS fan_in FROM p GROUP BY 1), o AS (SELECT src AS node, count(*) AS fan_out FROM p GROUP BY 1),
 s AS (SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS importers FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS rn FROM p) WHERE rn <= 10 GROUP BY 1)
 SELECT coalesce(i.node, o.node) AS node, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, importers FROM i FULL JOIN o ON i.node = o.node LEFT JOIN s ON s.node = coalesce(i.node, o.node)""")
def fan_in_summary(spark, root):
    """Degrees of every node with the first importers."""
    return G.fans(edges(spark, root))


@query(f"""WITH RECURSIVE {_TRADE}, r(node, depth) AS (SELECT dst, 1 FROM trade WHERE src = 0 UNION SELECT t.dst, r.depth + 1 FROM r JOIN trade t ON t.src = r.node WHERE r.depth < 25) SELECT node, min(depth)::INT AS depth FROM r GROUP BY node""")
def trade_reach(spark, root):
    """Everything reached from a node, by breadth, over a small graph with cycles."""
    graph = trade(spark, root)
    start = graph.where("src = 0").select(F.col("src").alias("node"))
    return G.reachable(graph, start)


@query(f"""WITH RECURSIVE {_TRADE}, p(path, last, n) AS (SELECT [src], dst, 1 FROM trade WHERE dst >= src UNION ALL SELECT list_append(p.path, p.last), t.dst, p.n + 1 FROM p JOIN trade t ON t.src = p.last WHERE p.n < 5 AND p.last > p.path[1] AND NOT list_contains(p.path, p.last) AND t.dst >= p.path[1])
 SELECT array_to_string(list_sort(list_transform(path, lambda x: x::VARCHAR)), '>') AS members, min(n)::INT AS length FROM p WHERE last = path[1] GROUP BY 1""")
def trade_cycles(spark, root):
    """Cycles of up to 5 edges, once per set of members, over a small graph with cycles."""
    return G.cycles(trade(spark, root), 5)


@query(f"""SELECT edge_id, target_path, CASE WHEN target_path LIKE 'pkg:%' THEN 'package' WHEN target_path LIKE '@%' THEN 'package' WHEN target_path LIKE '.%' THEN 'file' WHEN contains(target_path, '/') THEN 'file' WHEN regexp_matches(target_path, '\\.(ts|js|py|go|java)$') THEN 'file' ELSE 'symbol' END AS grain FROM {_EDGES}""")
def target_grain(spark, root):
    """Whether a target is a package, a file or a symbol."""
    t = F.col("target_path")
    grain = F.when(t.startswith("pkg:") | t.startswith("@"), "package").when(t.startswith(".") | F.contains(t, F.lit("/")) | t.rlike(r"\.(ts|js|py|go|java)$"), "file").otherwise("symbol")
    return table(spark, root, "imports").dropDuplicates(["edge_id"]).select("edge_id", "target_path", grain.alias("grain"))


@query(f"SELECT s.node_id AS given, left(sha256(c.file_path || chr(31) || s.kind || chr(31) || s.qualified), 16) AS node_id FROM symbols s JOIN {_CHUNKS} c USING (chunk_id)")
def node_ids(spark, root):
    """Deterministic ids of symbols."""
    paths = distinct_chunks(spark, root, "file_path")
    return table(spark, root, "symbols").join(paths, "chunk_id").select(F.col("node_id").alias("given"), X.hex_id(F.col("file_path"), F.col("kind"), F.col("qualified")).alias("node_id"))


@query(f"SELECT edge_id AS given, left(sha256(src_file || chr(31) || target_path || chr(31) || 'IMPORTS'), 16) AS edge_id FROM {_EDGES}")
def edge_ids(spark, root):
    """Deterministic ids of edges."""
    e = edges(spark, root)
    return e.select(F.col("edge_id").alias("given"), X.hex_id(F.col("src"), F.col("dst"), F.lit("IMPORTS")).alias("edge_id"))


_KIND = "CASE event_type WHEN 'view' THEN 'ast' WHEN 'click' THEN 'llm' WHEN 'signup' THEN 'hybrid' ELSE 'other' END"


@query(f"""SELECT kind, confidence, count(*) AS n, round(sum(score), 4) AS score FROM (SELECT kind, CASE WHEN kind = 'ast' THEN 'EXTRACTED' WHEN kind = 'llm' AND s IS NOT NULL THEN 'INFERRED' WHEN kind = 'hybrid' AND s >= 0.5 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
 CASE WHEN kind = 'ast' THEN 1.0 WHEN kind IN ('llm', 'hybrid') THEN s END AS score FROM (SELECT {_KIND} AS kind, greatest(0, least(1, value / 20)) AS s FROM events)) GROUP BY 1, 2""")
def confidence_tag(spark, root):
    """Confidence from the kind of producer and its score, over an event log."""
    kind = F.when(F.col("event_type") == "view", "ast").when(F.col("event_type") == "click", "llm").when(F.col("event_type") == "signup", "hybrid").otherwise("other")
    rows = table(spark, root, "events").select(kind.alias("kind"), (F.col("value") / 20).alias("s"))
    confidence, score = G.tagged(F.col("kind"), F.col("s"))
    return rows.select("kind", confidence.alias("confidence"), score.alias("score")).groupBy("kind", "confidence").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"))


_RANK = "CASE event_type WHEN 'view' THEN 3 WHEN 'click' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END"


@query(f"SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {_RANK} DESC, ts, event_id) AS rn FROM events) WHERE rn = 1")
def edge_winner(spark, root):
    """The record of greatest authority per key, the earliest among equals, over the whole log at once."""
    e = F.col("event_type")
    rank = F.when(e == "view", 3).when(e == "click", 2).when(e == "signup", 1).otherwise(0)
    return G.winners(table(spark, root, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", rank, F.asc("ts"), F.asc("event_id")).select("user_id", "event_id", "event_type")


@query(f"""WITH d AS (SELECT name, count(*) AS definitions, count(DISTINCT c.repo_id) AS repos FROM symbols s JOIN {_CHUNKS} c USING (chunk_id) GROUP BY name), u AS (SELECT name, count(*) AS uses FROM (SELECT unnest(i.names) AS name FROM (SELECT unnest(imports) AS i FROM {_CHUNKS})) GROUP BY name)
 SELECT coalesce(u.name, d.name) AS name, coalesce(definitions, 0) AS definitions, coalesce(repos, 0) AS repos, coalesce(uses, 0) AS uses, CASE WHEN coalesce(definitions, 0) = 0 THEN 'UNRESOLVED' WHEN definitions = 1 THEN 'EXTRACTED' ELSE 'AMBIGUOUS' END AS confidence FROM u FULL JOIN d ON u.name = d.name""")
def call_resolution(spark, root):
    """Imported names against definitions; both sides are aggregated first, so frequent names give no pairs."""
    chunks = distinct_chunks(spark, root, "repo_id", "imports")
    defined = table(spark, root, "symbols").join(chunks.select("chunk_id", "repo_id"), "chunk_id").groupBy("name").agg(F.count(F.lit(1)).alias("definitions"), F.count_distinct("repo_id").alias("repos"))
    used = chunks.select(F.explode("imports.names").alias("names")).select(F.explode("names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("uses"))
    n = F.col("definitions")
    both = used.join(defined, "name", "full").na.fill(0, ["definitions", "repos", "uses"])
    return both.withColumn("confidence", F.when(n == 0, "UNRESOLVED").when(n == 1, "EXTRACTED").otherwise("AMBIGUOUS"))


@query("SELECT DISTINCT src_file FROM imports WHERE target_path = 'pkg:context' OR target_path = 'pkg:fmt'")
def callers(spark, root):
    """Who depends on either of two names; equality in a set, not a disjunction of joins."""
    return table(spark, root, "imports").where(F.col("target_path").isin("pkg:context", "pkg:fmt")).select("src_file").distinct()


@query("SELECT confidence, count(DISTINCT edge_id) AS n FROM imports GROUP BY confidence")
def edge_confidence(spark, root):
    """Edges per confidence."""
    return edges(spark, root).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))
