"""Percentiles of very large numeric columns with bounded error and mergeable state (problem 3).

Method: deterministic buffer collapsing. Values fill sorted buffers of K values with weight 1. Whenever FAN buffers of
one level are there, they collapse into one buffer of the next level: their values, each standing for as many values
as its buffer weighs, are laid side by side in order, and K evenly spaced positions are selected. A collapse to weight w moves
any rank by at most w / 2, so each sketch carries a proven bound of its rank error. Sketches of partitions and days merge
by pooling their buffers level by level; tree scheduling keeps the depth, and with it the error, logarithmic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values of a full buffer, buffers that collapse at once: error about log_FAN(n / K) / (2 K) of n.
K, FAN = 1024, 8
#: Values a task holds before it passes its sketches on and begins new ones.
HELD = 4_000_000
#: Values that a group weighs besides its own.
SMALL = 64
#: Partitions whose sketches one task merges first; a second step merges what they give.
MERGE_WIDTH = 64

GROUP = ["dim", "key", "period", "metric"]
SKETCH = "dim string, key string, period string, metric string, n long, low double, high double, bound double, levels array<int>, buffers array<array<double>>"


class Sketch:
    """Mergeable sketch of one group; exact while it holds fewer than K * FAN values."""

    def __init__(self) -> None:
        self.n, self.bound, self.low, self.high = 0, 0.0, np.inf, -np.inf
        self.buffered = 0
        self.open: list[np.ndarray] = []
        self.waiting = 0
        self.levels: list[list[np.ndarray]] = []

    def add(self, values: np.ndarray) -> None:
        """Values without NaN, in any order."""
        if len(values):
            self.n += len(values)
            self.low, self.high = min(self.low, float(values.min())), max(self.high, float(values.max()))
            self._fill(values)

    def _fill(self, values: np.ndarray) -> None:
        self.open.append(values)
        self.waiting += len(values)
        if self.waiting >= K:
            every = np.concatenate(self.open)
            for k in range(0, len(every) - K + 1, K):
                self._put(0, np.sort(every[k : k + K]))
            self.open = [every[len(every) // K * K :]]
            self.waiting = len(self.open[0])

    def _put(self, level: int, buffer: np.ndarray) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(buffer)
        self.buffered += len(buffer)
        if len(self.levels[level]) == FAN:
            # all of one weight: position j of the K selected is the middle of the j-th stretch of FAN values
            together = np.sort(np.concatenate(self.levels[level]))
            self.levels[level] = []
            self.buffered -= len(together)
            middle = FAN // 2 - (len(self.levels) > level + 1 and len(self.levels[level + 1]) % 2)
            self.bound += FAN ** (level + 1) / 2
            self._put(level + 1, together[middle::FAN])

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.bound += other.bound
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        for level in range(len(other.levels) - 1, -1, -1):
            for buffer in other.levels[level]:
                self._put(level, buffer)
        for values in other.open:
            if len(values):
                self._fill(values)

    def row(self) -> tuple:
        """n, low, high, bound, levels, buffers; level -1 is the open buffer."""
        rest = np.sort(np.concatenate(self.open)) if self.open else np.zeros(0)
        parts = [(-1, rest)] * bool(len(rest)) + [(k, b) for k, level in enumerate(self.levels) for b in level]
        return self.n, self.low, self.high, self.bound, [k for k, _ in parts], [b for _, b in parts]

    @classmethod
    def of(cls, n, low, high, bound, levels, buffers) -> Sketch:
        sketch = cls()
        sketch.n, sketch.low, sketch.high, sketch.bound = int(n), low, high, float(bound)
        for level, buffer in zip(levels, buffers, strict=True):
            values = np.asarray(buffer, dtype=np.float64)
            if level < 0:
                sketch.open, sketch.waiting = [values], len(values)
            else:
                while len(sketch.levels) <= level:
                    sketch.levels.append([])
                sketch.levels[level].append(values)
        return sketch

    def at(self, points: Sequence[float]) -> list[float]:
        """Values at nearest rank; the least and greatest value are exact."""
        _, _, _, _, levels, buffers = self.row()
        values = np.concatenate(buffers)
        weights = np.concatenate([np.full(len(b), FAN ** max(0, k)) for k, b in zip(levels, buffers, strict=True)])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        ranks = [min(max(1, int(np.ceil(p * self.n))), self.n) for p in points]
        return [self.low if p <= 0 else self.high if p >= 1 else float(values[order[min(int(np.searchsorted(upto, r)), len(order) - 1)]]) for p, r in zip(points, ranks, strict=True)]


def sketches(df: DataFrame, dims: Sequence[str], metrics: Sequence[str], period: str) -> DataFrame:
    """One sketch per (dim, key, period, metric) and task; ``dims`` and ``period`` are string columns, ``metrics`` numeric ones.

    Nulls and NaN in a metric are left out; a null key or period is a group of its own (null); infinities are values. Groups
    without values have no sketch. Repeated rows count as often as they come: drop them first.
    """
    dims, metrics = list(dims), list(metrics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, Sketch] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            if groups:
                yield _batch([(*name, *s.row()) for name, s in groups.items()])
            groups.clear()

        for batch in batches:
            codes = [(d, batch.column(k).dictionary_encode(null_encoding="encode")) for k, d in enumerate(dims)]
            time = batch.column(len(dims) + len(metrics)).dictionary_encode(null_encoding="encode")
            when, periods = time.indices.to_numpy(), time.dictionary.to_pylist()
            for j, metric in enumerate(metrics):
                values = batch.column(len(dims) + j).cast(pa.float64()).to_numpy(zero_copy_only=False)
                good = np.flatnonzero(~np.isnan(values))
                for dim, code in codes:
                    index = code.indices.to_numpy()[good].astype(np.int64) * len(periods) + when[good]
                    order = np.argsort(index, kind="stable")
                    kinds, first = np.unique(index[order], return_index=True)
                    ends = [*first[1:], len(order)]
                    keys = code.dictionary.to_pylist()
                    for kind, a, b in zip(kinds, first, ends, strict=True):
                        name = (dim, keys[kind // len(periods)], periods[kind % len(periods)], metric)
                        if name not in groups:
                            groups[name] = Sketch()
                        sketch = groups[name]
                        held -= sketch.waiting + sketch.buffered
                        sketch.add(values[good[order[a:b]]])
                        # a group counts as some values more, so that many small groups are passed on as well
                        held += sketch.waiting + sketch.buffered + (SMALL if sketch.n == b - a else 0)
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    columns = [F.col(d).cast("string").alias(f"d{k}") for k, d in enumerate(dims)] + [F.col(m).cast("double").alias(f"m{k}") for k, m in enumerate(metrics)]
    columns.append(F.col(period).cast("string").alias("period"))
    return df.select(*columns).mapInArrow(run, SKETCH)


_STATE = ["n", "low", "high", "bound", "levels", "buffers"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Sketch rows (group..., state...) as one batch."""
    columns = list(zip(*rows, strict=True))
    inner = [b for buffers in columns[-1] for b in buffers]
    ends = lambda parts: np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = pa.array(np.concatenate(inner) if inner else np.zeros(0))
    buffers = pa.ListArray.from_arrays(ends(columns[-1]), pa.ListArray.from_arrays(ends(inner), values))
    kinds = [pa.string()] * len(GROUP) + [pa.int64()] + [pa.float64()] * 3 + [pa.list_(pa.int32())]
    return pa.record_batch([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=False)), buffers], names=[*GROUP, *_STATE])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Sketch]]:
    """(group, sketch) of each row."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*GROUP, *_STATE[:-1]]]
        outer = batch.column(batch.schema.get_field_index("buffers"))
        ends, lists = outer.offsets.to_numpy(), outer.values
        cuts, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
        for k, row in enumerate(zip(*columns, strict=True)):
            buffers = [values[cuts[j] : cuts[j + 1]] for j in range(ends[k], ends[k + 1])]
            yield row[: len(GROUP)], Sketch.of(*row[len(GROUP) :], buffers)


def merged(parts: DataFrame, width: int = MERGE_WIDTH) -> DataFrame:
    """One sketch per group from any number of sketches of each: those of ``width`` partitions together first, then the rest.

    Rows of a group come one after another and in a fixed order, so that a task holds one sketch at a time and a rerun
    gives the same result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, total, done = None, None, []
        for group, sketch in _rows(batches):
            if total is None or group != name:
                if total is not None:
                    done.append((*name, *total.row()))
                    if len(done) >= 1000:
                        yield _batch(done)
                        done = []
                name, total = group, Sketch()
            total.merge(sketch)
        if total is not None:
            done.append((*name, *total.row()))
            yield _batch(done)

    fixed = ["n", "low", "high", "bound", "levels", "buffers"]
    salted = parts.withColumn("salt", F.floor(F.spark_partition_id() / width))
    first = salted.repartition(*GROUP, "salt").sortWithinPartitions("salt", *GROUP, *fixed).drop("salt").mapInArrow(run, SKETCH)
    return first.repartition(*GROUP).sortWithinPartitions(*GROUP, *fixed).mapInArrow(run, SKETCH)


def ranks_within(df: DataFrame, dims: Sequence[str], metrics: Sequence[str], found: DataFrame) -> DataFrame:
    """(dim, key, metric, p, n, within): whether the rank of each percentile of ``found`` is within its proven error, counted over all rows.

    ``found`` is what ``percentiles`` gives over one period of all rows. Values are counted per group and value first, so no
    task holds all rows of a group.
    """
    pairs = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("key"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for d in dims for m in metrics]
    rows = df.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").where(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = rows.groupBy("dim", "key", "metric", "value").agg(F.count(F.lit(1)).alias("often"))
    points = found.select("dim", F.col("key").alias("of"), "metric", "p", "n", F.col("value").alias("at"), "rank_error")
    both = counts.join(points, (counts["dim"] == points["dim"]) & (counts["metric"] == points["metric"]) & counts["key"].eqNullSafe(points["of"]))
    sums = both.groupBy(points["dim"], points["metric"], "of", "p", "n", "rank_error").agg(
        F.sum(F.when(F.col("value") < F.col("at"), F.col("often")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("at"), F.col("often")).otherwise(0)).alias("upto"), F.sum("often").alias("counted")
    )
    rank, off = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))), F.col("rank_error") * F.col("n")
    within = (F.col("below") + 1 - off <= rank) & (rank <= F.col("upto") + off) & (F.col("counted") == F.col("n"))
    return sums.select("dim", F.col("of").alias("key"), "metric", "p", "n", within.alias("within"))


def percentiles(sketched: DataFrame, points: Sequence[float]) -> DataFrame:
    """(dim, key, period, metric, n, p, value, rank_error) from one sketch per group; rank_error is a proven bound as a share of n."""
    points = [float(p) for p in points]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (*group, sketch.n, p, value, sketch.bound / sketch.n)
                for group, sketch in _rows(iter([batch]))
                for p, value in zip(points, sketch.at(points), strict=True)
            ]
            if rows:
                kinds = [pa.string()] * len(GROUP) + [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*GROUP, "n", "p", "value", "rank_error"])

    return sketched.mapInArrow(run, "dim string, key string, period string, metric string, n long, p double, value double, rank_error double")
