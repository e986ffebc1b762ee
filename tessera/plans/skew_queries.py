"""Registered queries of the skewed-key operator (problem 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.skew import heavy_keys, key_percentiles, key_summary
from tessera.sources.tables import distinct_chunks, table

SHARE = 0.03


def p6_found(spark, root):
    """repo_ids that hold at least 3 % of all chunk_ids."""
    rows = table(spark, root, "code_chunks").select("repo_id", "chunk_id")
    return heavy_keys(rows, "repo_id", "chunk_id", SHARE).select(F.col("key").alias("repo_id"))


def _sizes(spark, root):
    return distinct_chunks(spark, root, "repo_id", F.length("content").cast("long").alias("n_chars"), "language")


def p6_repo_volume(spark, root):
    """Chunks, text volume, distinct chunk lengths and the most common length per repo_id."""
    return key_summary(_sizes(spark, root), "repo_id", "n_chars").select(
        F.col("key").alias("repo_id"), F.col("n_rows").alias("n_chunks"), F.col("total").alias("n_chars"),
        F.col("n_distinct").alias("n_lengths"), F.col("mode").alias("common_length"),
    )


def p6_repo_percentiles(spark, root):
    """Exact nearest-rank percentiles of chunk length per repo_id."""
    rows = key_percentiles(_sizes(spark, root), "repo_id", "n_chars", (0.5, 0.9, 0.99))
    return rows.select(F.col("key").alias("repo_id"), "p", F.col("value").alias("n_chars"))


QUERIES = {"p6_found": p6_found, "p6_repo_volume": p6_repo_volume, "p6_repo_percentiles": p6_repo_percentiles}

_CHUNKS = "(SELECT DISTINCT ON (chunk_id) chunk_id, repo_id, length(content)::BIGINT AS n_chars FROM code_chunks ORDER BY chunk_id, created_at)"

SQL = {
    "p6_found": """
        SELECT repo_id FROM (SELECT repo_id, count(DISTINCT chunk_id) AS n FROM code_chunks GROUP BY repo_id)
        WHERE repo_id IS NOT NULL AND n >= 0.03 * (SELECT count(DISTINCT chunk_id) FROM code_chunks)""",
    "p6_repo_volume": f"""
        WITH f AS (SELECT repo_id, n_chars, count(*) AS freq FROM {_CHUNKS} GROUP BY ALL),
             m AS (SELECT repo_id, n_chars, row_number() OVER (PARTITION BY repo_id ORDER BY freq DESC, n_chars) AS rn FROM f)
        SELECT f.repo_id, sum(freq)::BIGINT AS n_chunks, sum(f.n_chars * freq)::BIGINT AS n_chars, count(*)::BIGINT AS n_lengths,
               max(m.n_chars)::BIGINT AS common_length
        FROM f JOIN m ON f.repo_id IS NOT DISTINCT FROM m.repo_id AND m.rn = 1 GROUP BY f.repo_id""",
    "p6_repo_percentiles": f"""
        SELECT repo_id, p, n_chars FROM (
          SELECT repo_id, n_chars, row_number() OVER (PARTITION BY repo_id ORDER BY n_chars) AS rn, count(*) OVER (PARTITION BY repo_id) AS n
          FROM {_CHUNKS}), (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) AS q(p)
        WHERE rn = greatest(1, ceil(p * n))""",
}
