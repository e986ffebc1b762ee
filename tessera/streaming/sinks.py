"""Streams into tables kept as Parquet folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.store import upsert


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The table's latest version, or None before the first write; readers keep the version they began with."""
    path = _latest(spark, folder)
    return spark.read.parquet(path) if path else None


def _system(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _latest(spark: SparkSession, folder: str) -> str | None:
    Path, system, path = _system(spark, folder)
    if not system.exists(path):
        return None
    done = [s.getPath() for s in system.listStatus(path) if s.isDirectory() and system.exists(Path(s.getPath(), "_SUCCESS"))]
    return max(map(str, done), default=None)


def merge(new: DataFrame, folder: str, key: list[str], version: str, batch: int) -> None:
    """Merge rows into the table: a new version is written beside the old one, and counts once its _SUCCESS is there.

    Writing the same batch again gives the same table, so a batch that is repeated after a failure does no harm.
    """
    spark = new.sparkSession
    old = current(spark, folder)
    merged = upsert(old if old is not None else new.limit(0), new, key, version)
    merged.write.parquet(f"{folder}/v{batch:012d}-{uuid.uuid4().hex[:8]}")


def upserts(stream: DataFrame, folder: str, key: list[str], version: str, checkpoint: str) -> StreamingQuery:
    """Start merging a stream into the table under ``folder``; runs until everything there is has been read."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch: merge(rows, folder, key, version, batch))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
