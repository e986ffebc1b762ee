"""Exact per-key results when a few keys hold most rows.

Method: value-frequency compression. Rows are first grouped by key *and* value, which Spark combines map-side, so a
hot key shrinks to its distinct (value, frequency) pairs spread over all tasks. Distinct counts, modes and percentiles
are then derived from the weighted values. No task ever holds all rows of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per power of two of the order-preserving log-linear bucketing.
SUB_BUCKETS = 64


def value_frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, freq) with one row per distinct pair; null values keep their own row, null keys too."""
    return df.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("freq"))


def _bucket(value: Column) -> Column:
    """A monotone bucket number: SUB_BUCKETS buckets per power of two, of small values too; zero is 0, negatives are mirrored."""
    size = F.abs(value.cast("double"))
    octave = F.floor(F.log2(F.when(size > 0, size))).cast("long")
    base = F.pow(F.lit(2.0), octave.cast("double"))
    fine = F.floor((size - base) / base * SUB_BUCKETS).cast("long")
    # octaves of doubles begin at -1074; a quotient that rounding takes to the next power stays monotone within a bucket
    magnitude = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), F.lit(1 << 40)).otherwise((octave + 1100) * SUB_BUCKETS + fine + 1)
    return F.when(value < 0, -magnitude).otherwise(magnitude)


def key_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: n_rows, n_values (non-null), n_distinct, mode (smallest of the most frequent) and total.

    Nulls in ``value`` count in n_rows only; a null key is a key of its own. An empty input gives no rows.
    """
    pairs = value_frequencies(df, key, value)
    real = F.col("value").isNotNull()
    return pairs.groupBy("key").agg(
        F.sum("freq").alias("n_rows"),
        F.coalesce(F.sum(F.when(real, F.col("freq"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.max_by(F.col("value"), F.struct(F.when(real, F.col("freq")).otherwise(F.lit(-1)), F.when(real, -F.col("value")))).alias("mode"),
        F.sum(F.col("value") * F.col("freq")).alias("total"),
    )


def key_percentiles(df: DataFrame, key: str, value: str, at: Sequence[float]) -> DataFrame:
    """(key, p, value): exact nearest-rank percentiles of a numeric column.

    A first pass places the ranks in monotone log-linear buckets (at most some thousands a key); only the
    distinct values of the buckets that hold a rank are then ordered. Nulls and NaN in ``value`` are left out; keys
    without a value give no rows; the null key is a key like others; ties need no rule since equal values are one.
    """
    points = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("long").alias("rank"), F.lit(0.0).alias("share")) for p in at])
    return _at_ranks(df, key, value, points).select("key", "p", "value")


def key_interpolated(df: DataFrame, key: str, value: str, at: Sequence[float]) -> DataFrame:
    """(key, p, value): exact percentiles interpolated between the two nearest ranks, as doubles; else like ``key_percentiles``."""
    pairs = []
    for p in at:
        place = F.lit(float(p)) * (F.col("n") - 1)
        low = F.floor(place)
        share = place - low
        pairs.append(F.struct(F.lit(float(p)).alias("p"), (low + 1).cast("long").alias("rank"), (1 - share).alias("share")))
        pairs.append(F.struct(F.lit(float(p)).alias("p"), F.least(low + 2, F.col("n")).cast("long").alias("rank"), share.alias("share")))
    found = _at_ranks(df, key, value, F.array(*pairs))
    return found.groupBy("key", "p").agg(F.sum(F.col("value").cast("double") * F.col("share")).alias("value"))


def _at_ranks(df: DataFrame, key: str, value: str, points: Column) -> DataFrame:
    """(key, p, share, value): the values at the ranks of ``points``, an array of (p, rank, share) over n, the number of a key's values."""
    usable = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    pairs = value_frequencies(df.where(usable), key, value).withColumn("bucket", _bucket(F.col("value")))
    by_key = Window.partitionBy("key")
    buckets = pairs.groupBy("key", "bucket").agg(F.sum("freq").alias("bucket_freq"))
    buckets = (
        buckets.withColumn("upto", F.sum("bucket_freq").over(by_key.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("n", F.sum("bucket_freq").over(by_key))
        .withColumn("below", F.col("upto") - F.col("bucket_freq"))
    )
    wanted = (
        buckets.withColumn("point", F.explode(points))
        .where((F.col("point.rank") > F.col("below")) & (F.col("point.rank") <= F.col("upto")))
        .groupBy("key", "bucket", "below")
        .agg(F.collect_list("point").alias("points"))
    )
    inside = pairs.alias("v").join(
        wanted.alias("w"), F.col("v.key").eqNullSafe(F.col("w.key")) & (F.col("v.bucket") == F.col("w.bucket"))
    )
    order = Window.partitionBy("v.key", "v.bucket").orderBy("v.value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.select(
        F.col("v.key").alias("key"),
        F.col("v.value").alias("value"),
        F.col("points"),
        (F.col("below") + F.sum("v.freq").over(order)).alias("last"),
        F.col("v.freq").alias("freq"),
    )
    return (
        ranked.withColumn("point", F.explode("points"))
        .where((F.col("point.rank") <= F.col("last")) & (F.col("point.rank") > F.col("last") - F.col("freq")))
        .select("key", F.col("point.p").alias("p"), F.col("point.share").alias("share"), "value")
    )


def heavy_keys(df: DataFrame, key: str, unit: str, share: float) -> DataFrame:
    """(key, n): the non-null keys holding at least ``share`` of all distinct units (units without key included)."""
    pairs = df.where(F.col(unit).isNotNull()).groupBy(key, unit).agg(F.count(F.lit(1)).alias("freq"))
    sizes = pairs.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total")).select("total")
    # one row against one number: a scalar subquery, not a join of two tables
    return sizes.where(F.col("key").isNotNull() & (F.col("n") >= F.lit(share) * total.scalar()))
