"""Registered queries of structure: definitions, calls, inheritance, chunks by definition, endpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import structure as S
from tessera.plans.registering import book
from tessera.sources.files import file_texts
from tessera.sources.tables import distinct_chunks, table

QUERIES, SQL, query = book()

_CHUNKS = "(SELECT DISTINCT ON (chunk_id) * FROM code_chunks ORDER BY chunk_id, created_at)"
_GIVEN = f"(SELECT DISTINCT file_id, s.kind AS kind, s.name AS name, s.lineStart AS first FROM {_CHUNKS}, unnest(symbols) AS t(s))"


def _structure(spark, root):
    return S.structure(file_texts(spark, root))


@query()
def definitions(spark, root):
    """Every definition of every file with its id, qualified name, export and lines."""
    rows = S.definitions(_structure(spark, root))
    return rows.select(X.hex_id(F.col("file_path"), F.col("kind"), F.col("qualified")).alias("node_id"), "file_id", "kind", "name", "qualified", "exported", "first", "last")


@query(f"SELECT kind, count(*) AS given, true AS found_enough, true AS lines_enough FROM {_GIVEN} GROUP BY kind HAVING count(*) >= 20")
def definition_recall(spark, root):
    """The given symbols against those scanned, per kind: are 95 % of them found, and on their lines?"""
    given = table(spark, root, "code_chunks").select("file_id", F.explode("symbols").alias("s")).select("file_id", "s.kind", "s.name", F.col("s.lineStart").alias("first")).distinct()
    found = S.definitions(_structure(spark, root)).groupBy("file_id", "kind", "name").agg(F.collect_set("first").alias("lines"))
    both = given.join(found, ["file_id", "kind", "name"], "left")
    n = F.count(F.lit(1))
    return both.groupBy("kind").agg(
        n.alias("given"), (F.count("lines") >= 0.95 * n).alias("found_enough"), (F.count_if(F.array_contains("lines", F.col("first"))) >= 0.95 * n).alias("lines_enough")
    ).where("given >= 20")


@query(f"""WITH g AS (SELECT file_id, kind, name, min(first) AS first FROM {_GIVEN} GROUP BY 1, 2, 3), n AS (SELECT count(*) AS n FROM g) SELECT true AS found_enough, n AS given FROM n""")
def chunk_starts(spark, root):
    """Do 95 % of the given symbols begin a chunk of their own?"""
    given = table(spark, root, "code_chunks").select("file_id", F.explode("symbols").alias("s")).groupBy("file_id", "s.kind", "s.name").agg(F.min("s.lineStart").alias("first"))
    starts = _definition_chunks(spark, root).where("kind IS NOT NULL").select("file_id", "kind", F.substring_index("name", ".", -1).alias("name"), F.col("line_start").alias("first"), F.lit(True).alias("hit")).distinct()
    both = given.join(starts, ["file_id", "kind", "name", "first"], "left")
    return both.agg((F.count("hit") >= 0.95 * F.count(F.lit(1))).alias("found_enough"), F.count(F.lit(1)).alias("given"))


def _definition_chunks(spark, root):
    """(file_id, file_path, kind, name, line_start, line_end, content): one chunk per definition, the whole file where there is none."""
    files = file_texts(spark, root)
    # the scanner gets the text once and hands on spans only; texts meet their spans in a join by file
    spans = S.definitions(S.structure(files)).select("file_id", "kind", F.col("qualified").alias("name"), F.col("first").alias("line_start"), F.col("last").alias("line_end"))
    lines = files.select("file_id", "file_path", F.split("text", "\n").alias("lines"))
    rows = lines.join(spans, "file_id", "left").withColumn("line_start", F.coalesce("line_start", F.lit(1))).withColumn("line_end", F.coalesce("line_end", F.size("lines")))
    content = F.array_join(F.slice("lines", F.col("line_start"), F.greatest(F.lit(1), F.col("line_end") - F.col("line_start") + 1)), "\n")
    return rows.select("file_id", "file_path", "kind", "name", "line_start", "line_end", content.alias("content"))


@query()
def definition_chunks(spark, root):
    """A chunk per class, method, function, interface, type and function constant, else the whole file, with deterministic ids."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    ident = X.hex_id(F.col("file_path"), text("line_start"), text("line_end"), text("kind"), text("name"))
    return _definition_chunks(spark, root).select(ident.alias("chunk_id"), "file_id", "kind", "name", "line_start", "line_end", F.length("content").alias("n_chars"))


@query()
def calls(spark, root):
    """Calls with their nearest enclosing function and their line."""
    rows = _structure(spark, root).select("file_id", "file_path", F.explode("calls").alias("c")).select("file_id", "file_path", "c.*").distinct()
    ident = X.hex_id(F.col("file_path"), F.col("caller"), F.concat(F.col("qualified"), F.lit(":"), F.col("line")), F.lit("CALLS"))
    return rows.select(ident.alias("edge_id"), "file_id", "caller", "callee", "qualified", "line")


@query()
def call_targets(spark, root):
    """What calls mean: a definition of the same file (2), of an imported file (1), else only how many definitions have the name (0).

    All targets of the best score are kept. Names are joined within files and along imports, so a name that many files
    define gives no pairs of all its calls and definitions.
    """
    from tessera.plans.graph_queries import resolved_files

    found = _structure(spark, root)
    called = found.select("file_id", F.explode("calls").alias("c")).select("file_id", "c.caller", "c.callee").distinct()
    defined = S.definitions(found).where(F.col("kind").isin("function", "method", "const", "class", "constructor")).select(F.col("file_id").alias("target_file"), F.col("name").alias("callee"), F.col("qualified").alias("target")).distinct()
    same = called.join(defined, (F.col("file_id") == F.col("target_file")) & (called["callee"] == defined["callee"])).select("file_id", "caller", called["callee"], "target_file", "target", F.lit(2).alias("score"))
    along = resolved_files(spark, root).select("file_id", F.col("target_file").alias("of"))
    reached = called.join(along, "file_id").join(defined, (F.col("of") == F.col("target_file")) & (called["callee"] == defined["callee"])).select("file_id", "caller", called["callee"], "target_file", "target", F.lit(1).alias("score"))
    best = same.unionByName(reached).withColumn("rank", F.rank().over(Window.partitionBy("file_id", "caller", "callee").orderBy(F.desc("score")))).where("rank = 1").drop("rank").distinct()
    named = defined.groupBy("callee").agg(F.count(F.lit(1)).alias("definitions"))
    rest = called.join(best.select("file_id", "caller", "callee").distinct(), ["file_id", "caller", "callee"], "left_anti").join(named, "callee", "left")
    nothing = F.lit(None).cast("string")
    loose = rest.select("file_id", "caller", "callee", nothing.alias("target_file"), nothing.alias("target"), F.lit(0).alias("score"), F.coalesce("definitions", F.lit(0)).alias("definitions"))
    return best.withColumn("definitions", F.lit(1).cast("long")).unionByName(loose)


@query()
def inheritance(spark, root):
    """Classes with what they extend or implement, and the files that define it in their repository; null where none does."""
    found = S.structure(file_texts(spark, root, "repo_id"))
    repo = file_texts(spark, root, "repo_id").select("file_id", F.coalesce("repo_id", F.lit("")).alias("repo"))
    bases = found.select("file_id", F.explode("bases").alias("b")).select("file_id", "b.*").distinct().join(repo, "file_id")
    types = S.definitions(found).where(F.col("kind").isin("class", "interface")).join(repo, "file_id").select("repo", F.col("name").alias("base"), F.col("file_id").alias("base_file")).distinct()
    return bases.join(types, ["repo", "base"], "left").select("file_id", "name", "base", "relation", "base_file")


_VERB = r"@(Get|Post|Put|Patch|Delete)\(['\"]?([^'\")\s]*)['\"]?\)"


@query(rf"""WITH l AS (SELECT chunk_id, file_path, line_start, string_split(content, chr(10)) AS lines FROM {_CHUNKS} WHERE regexp_matches(content, '@(Get|Post|Put|Patch|Delete)\(')),
 e AS (SELECT *, unnest(generate_series(1, len(lines))) AS k FROM l),
 h AS (SELECT chunk_id, file_path, line_start + k - 1 AS line_no, regexp_extract(lines[k], '@(Get|Post|Put|Patch|Delete)\([''"]?([^''")\s]*)[''"]?\)', ['verb', 'path']) AS m, list_filter(list_transform(lines[k + 1 : k + 3], lambda x: trim(x, E' \t\r')), lambda x: x <> '')[1] AS next FROM e WHERE regexp_matches(lines[k], '@(Get|Post|Put|Patch|Delete)\([''"]?[^''")\s]*[''"]?\)'))
 SELECT chunk_id, file_path, line_no::INT AS line_no, upper(m.verb) AS verb, CASE WHEN starts_with(m.path, '/') THEN m.path ELSE '/' || m.path END AS path, coalesce(nullif(regexp_extract(next, '(?:async\s+)?(\w+)\s*\(', 1), ''), 'unknown') AS handler FROM h""")
def endpoints(spark, root):
    """Verb, path and handler of every decorated route; the handler is named on the next line with text, of at most three."""
    rows = distinct_chunks(spark, root, "file_path", "line_start", "content").where(F.col("content").rlike(r"@(Get|Post|Put|Patch|Delete)\("))
    lines = rows.select("chunk_id", "file_path", "line_start", F.split("content", "\n").alias("lines"))
    each = lines.select("*", F.posexplode("lines").alias("k", "line")).where(F.col("line").rlike(_VERB))
    following = F.filter(F.transform(F.slice("lines", F.col("k") + 2, 3), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    handler = F.regexp_extract(F.get(following, F.lit(0)), r"(?:async\s+)?(\w+)\s*\(", 1)
    path = F.regexp_extract("line", _VERB, 2)
    return each.select(
        "chunk_id", "file_path", (F.col("line_start") + F.col("k")).alias("line_no"), F.upper(F.regexp_extract("line", _VERB, 1)).alias("verb"),
        F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)).alias("path"), F.coalesce(F.nullif(handler, F.lit("")), F.lit("unknown")).alias("handler"),
    )
