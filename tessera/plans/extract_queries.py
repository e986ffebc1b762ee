"""Registered queries of extraction from source text."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import extract as E
from tessera.plans.registering import book
from tessera.sources.files import file_texts
from tessera.sources.tables import table

QUERIES, SQL, query = book()

_FILES = """f AS (SELECT file_id, min(file_path) AS file_path, string_agg(content, chr(10) ORDER BY line_start) AS text FROM (SELECT DISTINCT ON (chunk_id) file_id, file_path, chunk_id, line_start, coalesce(content, '') AS content FROM code_chunks ORDER BY chunk_id, created_at) GROUP BY file_id),
 l AS (SELECT *, CASE WHEN file_path LIKE '%.ts' THEN 'typescript' WHEN file_path LIKE '%.js' OR file_path LIKE '%.mjs' THEN 'javascript' WHEN file_path LIKE '%.py' THEN 'python' WHEN file_path LIKE '%.go' THEN 'go' WHEN file_path LIKE '%.java' THEN 'java' END AS language FROM f)"""


def _quoted(pattern):
    return pattern.replace("'", "''")


_IMPORTS = " UNION ".join(f"SELECT file_id, unnest(regexp_extract_all(text, '{_quoted(p)}', 1)) AS target FROM l WHERE language = '{name}'" for name, patterns in E.IMPORTS.items() for p in patterns)
_SYMBOLS = " UNION ".join(f"SELECT file_id, '{kind}' AS kind, unnest(regexp_extract_all(text, '{_quoted(p)}', 1)) AS name FROM l WHERE language = '{name}'" for name, patterns in E.SYMBOLS.items() for kind, p in patterns)


@query(f"WITH {_FILES} {_IMPORTS}")
def extracted_imports(spark, root):
    """Import targets of every file, as written."""
    return E.imports_of(file_texts(spark, root))


@query(f"WITH {_FILES} {_SYMBOLS}")
def extracted_symbols(spark, root):
    """Top-level declarations by patterns inside code generation, a quick outline without Python; the scanner of `definitions` finds methods and constants too."""
    return E.symbols_of(file_texts(spark, root))


@query(f"""WITH {_FILES}, e AS ({_SYMBOLS}), g AS (SELECT DISTINCT c.file_id, s.kind, s.name FROM symbols s JOIN (SELECT DISTINCT chunk_id, file_id FROM code_chunks) c USING (chunk_id))
 SELECT g.kind, count(*) AS given, count(e.name) AS found FROM g LEFT JOIN e ON e.file_id = g.file_id AND e.name = g.name AND e.kind = g.kind GROUP BY g.kind""")
def extraction_recall(spark, root):
    """How many of the given symbols the patterns find, per kind; `definition_recall` measures the scanner."""
    found = E.symbols_of(file_texts(spark, root)).withColumn("hit", F.lit(True))
    files = table(spark, root, "code_chunks").select("chunk_id", "file_id").distinct()
    given = table(spark, root, "symbols").join(files, "chunk_id").select("file_id", "kind", "name").distinct()
    return given.join(found, ["file_id", "kind", "name"], "left").groupBy("kind").agg(F.count(F.lit(1)).alias("given"), F.count("hit").alias("found"))


@query(f"""WITH RECURSIVE {_FILES}, n AS (SELECT file_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM f WHERE regexp_matches(text, '[^\\s]') AND NOT contains(text, chr(0))),
 c AS (SELECT file_id, k, length(line) + 1 AS len, NOT regexp_matches(line, '[^\\s]') AS blank, sum(length(line) + 1) OVER (PARTITION BY file_id ORDER BY k) AS upto, count(*) OVER (PARTITION BY file_id) AS size FROM n),
 w(file_id, start, stop, good, prev, prev_upto, nxt, base, size) AS (SELECT DISTINCT file_id, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::HUGEINT, 1::BIGINT, 0::HUGEINT, size FROM c
  UNION ALL SELECT file_id, nxt, stop, stop > prev, greatest(prev, stop), CASE WHEN stop > prev THEN stop_upto ELSE prev_upto END, CASE WHEN stop >= size THEN NULL WHEN stop <= prev THEN prev + 1 ELSE coalesce(back, stop + 1) END, CASE WHEN stop <= prev THEN prev_upto ELSE coalesce(back_base, stop_upto) END, size
  FROM (SELECT y.*, min(c.k) FILTER (WHERE c.k > nxt AND stop_upto - (c.upto - c.len) <= 200) AS back, arg_min(c.upto - c.len, c.k) FILTER (WHERE c.k > nxt AND stop_upto - (c.upto - c.len) <= 200) AS back_base
   FROM (SELECT x.*, e.k AS stop, e.upto AS stop_upto FROM (SELECT r.file_id, r.prev, r.prev_upto, r.size, r.nxt, r.base, max(c.k) FILTER (WHERE c.upto - r.base <= 2000 OR c.k = r.nxt) AS l, min(c.k) FILTER (WHERE c.blank AND c.k > r.nxt AND c.upto - r.base BETWEEN 1200 AND 2000) AS b
     FROM w r JOIN c ON c.file_id = r.file_id AND c.k >= r.nxt GROUP BY ALL) x JOIN c e ON e.file_id = x.file_id AND e.k = coalesce(b, l)) y JOIN c ON c.file_id = y.file_id AND c.k BETWEEN y.nxt AND y.stop GROUP BY ALL))
 SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY start) - 1)::INT AS window_no, start::INT AS line_start, stop::INT AS line_end, (SELECT sum(c.len) - 1 FROM c WHERE c.file_id = w.file_id AND c.k BETWEEN w.start AND w.stop)::INT AS n_chars FROM w WHERE good""")
def windows(spark, root):
    """Overlapping line windows of every file."""
    return E.windows(file_texts(spark, root)).select("file_id", "window_no", "line_start", "line_end", F.length("content").alias("n_chars"))


_BLOCKS = "sha256(text || ':0') || sha256(text || ':1')"


@query(f"SELECT doc_id, round(list_sum(list_transform(generate_series(0, 63), lambda i: ('0x' || substr({_BLOCKS}, (i * 2 + 1)::BIGINT, 2))::INT / 127.5 - 1)), 6) AS total FROM documents WHERE text IS NOT NULL")
def stand_in_vectors(spark, root):
    """Deterministic stand-in vectors of every document, by their sum."""
    rows = table(spark, root, "documents").where("text IS NOT NULL").select("doc_id", E.stand_in_vector(F.col("text")).alias("v"))
    return rows.select("doc_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
