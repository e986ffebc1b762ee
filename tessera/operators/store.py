"""Merging, replacing and evicting rows of Parquet tables without a lakehouse format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of both, the one of greatest ``version`` per key; on equal versions the new one. Keys with nulls are keys of their own.

    One shuffle on the key, and partial aggregation before it, so many versions of one key meet as one row a task.
    """
    columns = old.columns
    tagged = old.select(*columns, F.lit(0).alias("_new")).unionByName(new.select(*columns, F.lit(1).alias("_new")))
    rest = [c for c in columns if c not in key]
    best = tagged.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("row"))
    return best.select(*[c if c in key else F.col(f"row.{c}").alias(c) for c in columns])


def replace_files(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` and the rows of ``old`` whose key is not in it: what re-ingesting some files leaves."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def append_missing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not in ``old``, one per key: an idempotent append."""
    return new.dropDuplicates(key).join(old.select(*key).distinct(), key, "left_anti")


def evict(df: DataFrame, size: str, used: str, key: str, keep: int) -> DataFrame:
    """The rows to evict so that at most ``keep`` of the total size stay: the longest unused ones, as few as suffice.

    Hours are ordered first (few rows); those before the one in which the limit falls go whole, and only the rows of that hour
    are ordered. Null sizes count as zero, null times as oldest.
    """
    hour = F.coalesce(F.date_trunc("hour", F.col(used).cast("timestamp")), F.lit("0001-01-01").cast("timestamp"))
    rows = df.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0))).withColumn("_hour", hour)
    hours = rows.groupBy("_hour").agg(F.sum("_size").alias("_of_hour"))
    total = hours.agg(F.sum("_of_hour").alias("t")).select("t").scalar()
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumn("_before", F.coalesce(F.sum("_of_hour").over(before), F.lit(0))).where(F.col("_before") < total - keep)
    dealt = rows.join(hours, "_hour")
    whole = F.col("_before") + F.col("_of_hour") < total - keep
    within = Window.partitionBy("_hour").orderBy(F.asc_nulls_first(used), key).rowsBetween(Window.unboundedPreceding, -1)
    last = dealt.where(~whole).withColumn("_upto", F.col("_before") + F.coalesce(F.sum("_size").over(within), F.lit(0)))
    return dealt.where(whole).select(*df.columns).unionByName(last.where(F.col("_upto") < total - keep).select(*df.columns))


def content_key(text: Column) -> Column:
    """SHA-256 of a text without byte-order mark and with line feeds only."""
    plain = F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")
    return F.sha2(plain, 256)
