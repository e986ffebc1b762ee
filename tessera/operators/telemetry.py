"""Aggregates over request logs and chunk tables: totals, percentiles, series, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.skew import key_interpolated


def percent(part: Column, whole: Column, digits: int, empty: float = 0.0) -> Column:
    """100 * part / whole, rounded; ``empty`` where whole is zero."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(100.0 * part / whole, digits))


def since(df: DataFrame, time: str, days: int, of: DataFrame | None = None) -> DataFrame:
    """Rows of the last ``days`` days of the data: after its greatest time less the period.

    The latest time stands for now, so that results don't depend on the clock; it is that of ``of`` if given, such as the
    scan below a de-duplicated ``df``. Null times are left out.
    """
    latest = (df if of is None else of).agg((F.max(time) - F.expr(f"INTERVAL {days} DAYS")).alias("from")).select("from")
    return df.where(F.col(time) > latest.scalar())


def with_percentiles(stats: DataFrame, rows: DataFrame, key: str, value: str, points: Sequence[float], digits: int = 4) -> DataFrame:
    """``stats``, one row per ``key``, with exact, interpolated percentiles p50, p90, ... of ``value`` over ``rows``.

    Percentiles come from values with their frequencies, so no task holds the values of a key; null where a key has none.
    """
    found = key_interpolated(rows, key, value, points)
    wide = found.groupBy(F.col("key").alias("_key")).agg(*[F.round(F.max(F.when(F.col("p") == float(p), F.col("value"))), digits).alias(f"p{round(p * 100)}") for p in points])
    return stats.join(wide, stats[key].eqNullSafe(wide["_key"]), "left").drop("_key")


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows by ``order``, which must be total to be deterministic."""
    return df.orderBy(*order).limit(n)


def day_spine(df: DataFrame, day: str) -> DataFrame:
    """One row per calendar day between the first and last day of ``df``."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.where(F.col("a").isNotNull()).select(F.explode(F.sequence("a", "b")).alias(day))


def series(df: DataFrame, day: str, *values: Column) -> DataFrame:
    """Aggregates per calendar day; days without rows are there with nulls."""
    return day_spine(df, day).join(df.groupBy(day).agg(*values), day, "left")


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The latest n rows; alias of ``top`` that says what it is for."""
    return top(df, n, *order)


def buckets(df: DataFrame, by: str, value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative histogram: rows with value <= bound, per value of ``by`` and bound, and all of them under +Inf."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by).agg(
        *[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count(F.lit(1)).alias("all")
    )
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return counts.select(by, F.explode(F.array(*pairs)).alias("x")).select(by, "x.le", "x.n")


def busy_keys(df: DataFrame, key: str, time: str, limit: int, seconds: int) -> DataFrame:
    """Rows at which a key has had ``limit`` rows or more in the ``seconds`` before; 0 means no limit."""
    if limit == 0:
        return df.limit(0).withColumn("recent", F.lit(0).cast("long"))
    # a key's rows are dealt by stretches of the look-back's length, each with the rows of the stretch before it as context, so
    # that no task orders all rows of a key
    at = F.unix_micros(time)
    stretch = F.floor(at / (seconds * 1_000_000))
    own = df.select("*", at.alias("_at"), stretch.alias("_stretch"), F.lit(True).alias("_own"))
    both = own.unionByName(own.withColumn("_stretch", F.col("_stretch") + 1).withColumn("_own", F.lit(False)))
    window = Window.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(-seconds * 1_000_000, -1)
    counted = both.withColumn("recent", F.count(F.lit(1)).over(window)).where("_own")
    return counted.where(F.col("recent") >= limit).drop("_at", "_stretch", "_own")
