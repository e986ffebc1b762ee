"""Structured Streaming forms of the event operators, by event time with a watermark.

Late rows beyond the watermark are dropped; everything else equals the batch operators of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.scan import should_index

#: File-system event types as the index names them (fixed values).
ACTIONS = {"create": "add", "update": "change", "delete": "unlink"}


def file_events(stream: DataFrame) -> DataFrame:
    """(path, action, ts, seq) of the events that concern the index: relative paths inside the root that are indexed."""
    action = F.when(F.col("type") == "create", "add").when(F.col("type") == "update", "change").when(F.col("type") == "delete", "unlink")
    inside = ~F.col("path").startswith("/") & ~F.col("path").startswith("../")
    return stream.select("path", action.alias("action"), "ts", "seq").where(inside & F.col("action").isNotNull() & should_index(F.col("path")))


def debounced(stream: DataFrame, key: str, action: str, time: str, seq: str, quiet: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, first, last, n, action): one row per burst of a key, with its last action, once the key has been quiet."""
    by = stream.withWatermark(time, late).groupBy(F.col(key), F.session_window(time, quiet))
    return by.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"), F.max_by(action, F.struct(time, seq)).alias("action")).drop("session_window")


def swept(stream: DataFrame, kind: str, time: str, least: int, window: str = "60 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n): sliding windows with at least ``least`` rows of a kind."""
    counts = stream.withWatermark(time, late).groupBy(F.window(time, window, slide), F.col(kind)).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= least).select(F.col("window.start").alias("start"), kind, "n")


def token_bucket(stream: DataFrame, key: str, time: str, cost: str, capacity: float = 1000.0, refill: float = 50.0) -> DataFrame:
    """(key, ts, ok, retry_ms): a bucket per key of ``capacity`` tokens, refilled by ``refill`` a second.

    State is two numbers a key. Rows of one micro-batch are paid in order of time; a row earlier than the last paid one
    refills nothing.
    """

    def pay(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for ts, price in zip(rows["ts"], rows["cost"], strict=True):
            at = ts.timestamp()
            tokens = min(capacity, tokens + max(0.0, at - (at if last is None else last)) * refill)
            last = at if last is None else max(last, at)
            if price <= tokens:
                tokens -= price
                out.append((group[0], ts, True, 0))
            else:
                out.append((group[0], ts, False, int(-(-(price - tokens) * 1000 // refill))))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=["key", "ts", "ok", "retry_ms"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(time).alias("ts"), F.col(cost).cast("double").alias("cost"))
    return rows.groupBy("key").applyInPandasWithState(pay, f"key {kind}, ts timestamp, ok boolean, retry_ms long", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def unchanged_skipped(stream: DataFrame, index: DataFrame, path: str, digest: str) -> DataFrame:
    """Events whose content differs from the index (path, sha256); the index is a static table, joined per micro-batch."""
    known = index.select(F.col("file_path").alias(path), F.col("sha256").alias(digest)).withColumn("_known", F.lit(True))
    return stream.join(known, [path, digest], "left").where(F.col("_known").isNull()).drop("_known")
