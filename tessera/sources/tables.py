"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; Catalyst prunes columns and pushes filters into this scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def distinct_chunks(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    """One row per chunk_id with the named columns (repeated rows count once).

    Only created_at differs between repeats, so any row of a chunk_id stands for all of them. Rows without
    chunk_id are left out.
    """
    rows = table(spark, root, "code_chunks").select("chunk_id", *columns)
    return rows.where(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
