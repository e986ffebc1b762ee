"""State machines over ordered rows of each key."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, dict], tuple[object, dict]], schema: str) -> DataFrame:
    """Run ``step(state, row) -> (state, output row or None)`` along the rows of each key in order.

    Keys are shuffled and sorted by Spark (spilling where needed) and rows stream through: a task holds one state, never the
    rows of a key. Null keys are a key of their own.
    """
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if not begun or row[key] != at:
                    at, state, begun = row[key], start(), True
                state, result = step(state, row)
                if result is not None:
                    out.append(result)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(n, kinds[n]) for n in names]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = {f.name: f.type for f in to_arrow_schema(StructType.fromDDL(schema))}
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def cooled_down(df: DataFrame, key: str, micros: str, ident: str, gap: int) -> DataFrame:
    """The rows that pass a cool-down: the first of each key, and each that comes ``gap`` microseconds or more after the last passed.

    Rows come in order of time and ident and stream through; from one that passes the next is found by bisection, so the work
    of a key grows with what passes, not with its rows. Null times never pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, last = False, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            times = batch.column(1).to_numpy(zero_copy_only=False)
            codes = batch.column(0).dictionary_encode(null_encoding="encode")
            code, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            starts = np.flatnonzero(np.diff(code, prepend=-1))
            passed = []
            for a, b in zip(starts, np.append(starts[1:], len(code)), strict=True):
                name = names[code[a]]
                i = int(a)
                if begun and name == at:
                    i += int(np.searchsorted(times[a:b], last + gap))
                while i < b:
                    passed.append(i)
                    last = int(times[i])
                    i += 1 + int(np.searchsorted(times[i + 1 : b], last + gap))
                begun, at = True, name
            yield batch.select([key, ident]).take(pa.array(passed, pa.int64()))

    kinds = dict(df.dtypes)
    rows = df.where(F.col(micros).isNotNull()).select(key, F.col(micros).cast("long").alias(micros), ident)
    return rows.repartition(key).sortWithinPartitions(key, micros, ident).mapInArrow(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}")


def token_bucket(df: DataFrame, key: str, micros: str, ident: str, cost: str, capacity: float, refill: float) -> DataFrame:
    """(key, ident, ok, retry_ms): whether a bucket of ``capacity`` tokens, refilled by ``refill`` a second, pays each row's cost."""

    def step(state, row):
        tokens, last = state if state else (capacity, row[micros])
        tokens = min(capacity, tokens + max(0, row[micros] - last) / 1e6 * refill)
        if row[cost] <= tokens:
            return (tokens - row[cost], row[micros]), {key: row[key], ident: row[ident], "ok": True, "retry_ms": 0}
        wait = -(-(row[cost] - tokens) * 1000 // refill)
        return (tokens, row[micros]), {key: row[key], ident: row[ident], "ok": False, "retry_ms": int(wait)}

    kinds = dict(df.dtypes)
    return fold(df, key, [micros, ident], lambda: None, step, f"{key} {kinds[key]}, {ident} {kinds[ident]}, ok boolean, retry_ms long")
