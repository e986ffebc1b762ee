"""Whole files from code chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


def file_texts(spark: SparkSession, root: str, *columns: str, where=None) -> DataFrame:
    """(file_id, file_path, columns..., text): each file's chunks in order of line_start, joined by line feeds.

    Repeated chunks count once; a null content is an empty one; rows without file_id are left out. ``where`` keeps chunks
    by their own columns before the shuffle. A group is one file, so no key grows with the corpus. Columns hold
    the least non-null value of the file.
    """
    rows = table(spark, root, "code_chunks").select("file_id", "file_path", "chunk_id", "line_start", "content", *columns)
    rows = rows.where(F.col("file_id").isNotNull())
    if where is not None:
        rows = rows.where(where)
    chunk = F.struct("line_start", "chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    files = rows.groupBy("file_id").agg(
        F.min("file_path").alias("file_path"), *[F.min(c).alias(c) for c in columns], F.array_sort(F.collect_set(chunk)).alias("chunks")
    )
    return files.select("file_id", "file_path", *columns, F.array_join(F.col("chunks.content"), "\n").alias("text"))
