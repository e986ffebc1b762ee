"""Lexical, vector and hybrid top-k retrieval."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clamp01, cosine, distance
from tessera.session import spread


def usable_vector(v: Column, width: int = 64) -> Column:
    """Not null, ``width`` finite values, not all zero."""
    return (F.size(v) == width) & F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def nearest(df: DataFrame, key: str, vector: str, asked: Column, k: int, least: float) -> DataFrame:
    """The k rows most similar to a vector with cosine of at least ``least``, repeated keys once; ties by key.

    Rows are scored where they lie; only keys, scores and the columns besides vector are shuffled.
    """
    scored = df.where(usable_vector(F.col(vector))).withColumn("asked", asked).withColumn("similarity", F.round(cosine(F.col(vector), F.col("asked")), 6))
    return scored.where(F.col("similarity") >= least).drop("asked", vector).dropDuplicates([key]).orderBy(F.desc("similarity"), F.asc(key)).limit(k)


def lexical_score(text: Column, tokens: Sequence[str]) -> Column:
    """Sum of tf / (tf + 1) over the tokens, which are words of letters and digits: grows with coverage first, with repetition little."""
    low, score = F.lower(F.coalesce(text, F.lit(""))), F.lit(0.0)
    for t in tokens:
        tf = F.regexp_count(low, F.lit(rf"(?<![a-z0-9]){t}(?![a-z0-9])")).cast("double")
        score = score + (1 - 1 / (tf + 1))
    return score


def keyword(df: DataFrame, key: str, text: str, tokens: Sequence[str], k: int) -> DataFrame:
    """The k rows with the best lexical score above zero, repeated keys once; null texts never match."""
    first = F.lit(False)
    for t in tokens:
        first = first | F.contains(F.lower(F.col(text)), F.lit(t))
    scored = spread(df).where(first).withColumn("score", F.round(lexical_score(F.col(text), tokens), 6)).where("score > 0")
    return scored.drop(text).dropDuplicates([key]).orderBy(F.desc("score"), F.asc(key)).limit(k)


def hybrid(df: DataFrame, key: str, text: str, vector: str, asked: Column, tokens: Sequence[str], k: int, weight: float = 0.7) -> DataFrame:
    """weight * cosine + (1 - weight) * lexical share, over rows that have both a text and a vector."""
    scored = spread(df).where(usable_vector(F.col(vector)) & F.col(text).isNotNull()).withColumn("asked", asked)
    lexical = lexical_score(F.col(text), tokens) / max(1, len(tokens))
    score = F.round(weight * cosine(F.col(vector), F.col("asked")) + (1 - weight) * lexical, 6)
    return scored.withColumn("score", score).drop("asked", text, vector).dropDuplicates([key]).orderBy(F.desc("score"), F.asc(key)).limit(k)


def reranked(df: DataFrame, key: str, text: str, vector: str, asked: Column, tokens: Sequence[str], wide: int = 20, k: int = 5) -> DataFrame:
    """``wide`` nearest by Euclidean distance, rescored by 0.9 * closeness + 0.1 * share of tokens found, then k."""
    near = df.where(usable_vector(F.col(vector))).withColumn("asked", asked).select(key, distance(F.col(vector), F.col("asked")).alias("d"))
    near = near.dropDuplicates([key]).orderBy(F.asc("d"), F.asc(key)).limit(wide)
    # texts are fetched for the few that are left
    near = df.drop(vector).join(F.broadcast(near), key).dropDuplicates([key])
    matched = F.lit(0.0)
    for t in tokens:
        matched = matched + F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(t)).cast("double")
    score = clamp01(0.9 * clamp01(1 - F.col("d") / 2) + 0.1 * matched / max(1, len(tokens)))
    return near.withColumn("score", F.round(score, 6)).withColumn("preview", F.left(F.col(text), F.lit(120))).drop("d", text).orderBy(F.desc("score"), F.asc(key)).limit(k)
