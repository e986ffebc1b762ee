"""The k most similar vectors of every vector (problem 1).

Method: a permutation index. A sample of the vectors serves as pivots, one to VECTORS_PER_PIVOT vectors; each vector is
represented by its ORDER nearest pivots in order of nearness. It is posted in the inverted files of its first pivots and
asks the same files, as many as CANDIDATES has entries. Inside a file all postings, but those it meets in the file of a
nearer pivot as well, are ranked by the footrule distance of their pivot orders to that of the asking vector; only the
nearest by footrule are reranked by cosine, so that the cosines of a vector are bounded whatever the size of the
collection. Each file is one Spark group; long files are dealt over several groups that each query visits and that share
the candidates. Exact copies are one vector with many members, so a mass of copies is no hot file.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut

#: Vectors to a pivot, and the bound of the pivots (128 bytes each). Beyond it files grow, and with them the footrule work, not the cosines.
VECTORS_PER_PIVOT, MOST_PIVOTS = 32, 1 << 18
#: Pivots in a vector's order; sums of places of 15 pivots fit a byte.
ORDER = 15
#: Vectors reranked by cosine in the file of the nearest pivot, of the second, and so on.
CANDIDATES = (320, 192, 128, 96, 64, 48)
INDEXED = len(CANDIDATES)
#: Groups of pivots around other pivots in which a vector looks for its nearest.
NEAR_GROUPS = 10
#: Postings of a group; files expected to be longer are dealt over several groups.
GROUP = 4096
#: Vectors are normalised and kept as 16-bit fixed-point numbers.
SCALE = 32_767.0
#: A class with more than this share of all vectors is joined apart from the rest; there are at most as many such classes.
HOT_CLASSES = 4096


def _floats(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of fixed-point numbers from a binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.int16).reshape(-1, width).astype(np.float32) / np.float32(SCALE)


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a contiguous matrix."""
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    ends = np.arange(len(rows) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(rows.tobytes())])


def usable(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """(id, vec): one row per key whose vector has ``width`` finite values that are not all zero, as fixed-point numbers."""

    def quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = np.rint(x / np.linalg.norm(x, axis=1, keepdims=True) * SCALE).astype(np.int16)
                yield pa.record_batch([batch.column(0), _binary(x)], names=["id", "vec"])

    v = F.col(vector)
    good = F.col(key).isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(good).select(F.col(key).cast("string").alias("id"), v.alias("vector"))
    return rows.mapInArrow(quantise, "id string, vec binary").dropDuplicates(["id"])


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Exact copies as one class: (rep, vec, size, heads), heads being the k + 1 least ids and rep the least."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # only the k + 1 least ids that a batch has of a vector can be among its heads, which bounds what is gathered
        for batch in batches:
            ids, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seen: dict[bytes, int] = {}
            early = [False] * len(ids)
            for i in sorted(range(len(ids)), key=ids.__getitem__):
                seen[vecs[i]] = seen.get(vecs[i], 0) + 1
                early[i] = seen[vecs[i]] <= k + 1
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(early, pa.bool_())], names=["id", "vec", "early"])

    marked = rows.mapInArrow(mark, "id string, vec binary, early boolean")
    heads = F.slice(F.array_sort(F.collect_list(F.when(F.col("early"), F.col("id")))), 1, k + 1)
    classes = marked.groupBy("vec").agg(F.count(F.lit(1)).alias("size"), heads.alias("heads"))
    return classes.select(F.col("heads")[0].alias("rep"), "vec", "size", "heads")


class Pivots:
    """Pivots in groups around a few of them, so that a vector is compared with the pivots of the nearest groups only."""

    def __init__(self, vectors: np.ndarray):
        """vectors: fixed-point rows, in random order."""
        number = len(vectors)
        self.centres = _unit(vectors[: math.isqrt(max(0, number - 1)) + 1])
        owner = np.concatenate([(_unit(vectors[a : a + 4096]) @ self.centres.T).argmax(axis=1) for a in range(0, number, 4096)]) if number else np.zeros(0, dtype=np.int64)
        self.names = np.argsort(owner, kind="stable").astype(np.int32)
        self.members = vectors[self.names]
        self.first = np.searchsorted(owner[self.names], np.arange(len(self.centres) + 1))
        self.number = number

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """The numbers of the ORDER nearest pivots of each vector, nearest first."""
        depth, groups = min(ORDER, self.number), min(NEAR_GROUPS, len(self.centres))
        near = vectors @ self.centres.T
        of = np.argpartition(-near, groups - 1, axis=1)[:, :groups]
        best = np.full((len(vectors), groups * depth), -9.0, dtype=np.float32)
        name = np.zeros((len(vectors), groups * depth), dtype=np.int32)
        place = np.argsort(of.ravel(), kind="stable")
        ends = np.searchsorted(of.ravel()[place], np.arange(len(self.centres) + 1))
        for g in np.flatnonzero(np.diff(ends)):
            pairs = place[ends[g] : ends[g + 1]]
            row, slot = pairs // groups, pairs % groups
            score = vectors[row] @ _unit(self.members[self.first[g] : self.first[g + 1]]).T
            names = self.names[self.first[g] : self.first[g + 1]]
            top = np.argpartition(-score, depth - 1, axis=1)[:, :depth] if score.shape[1] > depth else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            column = slot[:, None] * depth + np.arange(top.shape[1])
            best[row[:, None], column] = np.take_along_axis(score, top, 1)
            name[row[:, None], column] = names[top]
        rank = np.argsort(-best, axis=1, kind="stable")[:, :depth]
        # few pivots: groups that are not looked at can leave places open, which the first pivot fills
        found = np.take_along_axis(name, rank, 1)
        return np.where(np.take_along_axis(best, rank, 1) > -9, found, found[:, :1])


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.float32) / np.float32(SCALE)


def footrule(asking: np.ndarray, posted: np.ndarray, file: int = 0) -> np.ndarray:
    """Footrule distances of pivot orders, up to a constant: a pivot missing from an order counts as behind its end.

    Over the pivots of both orders, the differences of places add up to a constant less twice the sum, over common pivots,
    of the order's length less the greater place. So the sum of the greater places ranks as the footrule does. 255 marks
    what the asking vectors meet in one of their first ``file`` files already.
    """
    depth = posted.shape[1]
    known, local = np.unique(posted, return_inverse=True)
    place = np.full((len(known) + 1, len(posted)), depth, dtype=np.uint8)
    # backwards, so that the first of repeated pivots counts
    for j in range(depth - 1, -1, -1):
        place[local.reshape(posted.shape)[:, j], np.arange(len(posted))] = j
    found = np.searchsorted(known, asking)
    found = np.where((found < len(known)) & (known[np.minimum(found, len(known) - 1)] == asking), found, len(known))
    total = np.zeros((len(asking), len(posted)), dtype=np.uint8)
    met = np.zeros(total.shape, dtype=bool)
    for j in range(depth):
        there = place[found[:, j]]
        if j < file:
            met |= there < INDEXED
        total += np.maximum(there, np.uint8(j))
    total[met] = 255
    return total


def similar(df: DataFrame, key: str, vector: str, k: int = 5, width: int = 64) -> DataFrame:
    """(id, neighbour, cosine): up to k most similar other rows of every usable row.

    Usable are rows with a key and ``width`` finite values that are not all zero; repeated keys count once. Exact
    copies are neighbours of cosine 1; among equals the least ids win. Fewer than two usable rows give no rows. Keys
    come out as strings. Recall is measured against brute force in the tests.
    """
    spark = df.sparkSession
    members = cut(usable(df, key, vector, width))
    classes = cut(distinct_vectors(members, k))
    number = classes.count()
    wanted = min(MOST_PIVOTS, max(16, math.ceil(number / VECTORS_PER_PIVOT)))
    # a sample drawn by hash, without a shuffle: the pivots, and as many vectors again to foresee the lengths of the files
    share = int(min(1.0, 2.2 * wanted / max(1, number)) * 1_000_000_000)
    order = F.xxhash64("rep")
    sample = classes.where(F.pmod(order, F.lit(1_000_000_000)) < share).select("vec", order.alias("order")).toArrow()
    fixed = np.frombuffer(b"".join(sample["vec"].to_pylist()), dtype=np.int16).reshape(-1, width)
    fixed = fixed[np.argsort(sample["order"].to_numpy(), kind="stable")] if len(fixed) else fixed
    pivots = Pivots(fixed[:wanted])
    if pivots.number:
        foreseen = np.concatenate([pivots.nearest(_unit(fixed[a : a + 4096]))[:, :INDEXED].ravel() for a in range(0, len(fixed), 4096)])
        posted = np.bincount(foreseen, minlength=pivots.number)
        parts = np.maximum(1, np.ceil(posted / len(fixed) * number / GROUP)).astype(np.int32)
    else:
        parts = np.zeros(0, dtype=np.int32)
    base = np.concatenate(([0], np.cumsum(parts)[:-1])) if len(parts) else parts
    shared = spark.sparkContext.broadcast((pivots, parts, base))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, parts, base = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pivots.nearest(_floats(batch.column(1), width))
            files = min(INDEXED, order.shape[1])
            row, file = np.repeat(np.arange(batch.num_rows), files), np.tile(np.arange(files), batch.num_rows)
            pivot = order[row, file].astype(np.int64)
            # a posting lies in one part of its file, a query visits all of them
            copies = parts[pivot]
            own = (row * 2_654_435_761 + pivot) % copies
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, file, pivot, own = (np.repeat(x, copies) for x in (row, file, pivot, own))
            take = pa.array(row)
            yield pa.record_batch(
                [
                    pa.array((base[pivot] + part).astype(np.int32)),
                    pa.array(parts[pivot].astype(np.int32)),
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    _binary(order).take(take),
                    batch.column(2).take(take),
                    pa.array(part == own),
                    pa.array(file.astype(np.int32)),
                ],
                names=["cell", "parts", "rep", "vec", "pivots", "copies", "posting", "file"],
            )

    def search(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("rep")
        vectors = _floats(group["vec"], width)
        order = np.frombuffer(b"".join(group["pivots"].to_pylist()), dtype=np.int32).reshape(len(vectors), -1)
        posting = np.flatnonzero(group["posting"].to_numpy())
        files = group["file"].to_numpy()
        ids, copies = group["rep"].combine_chunks(), group["copies"].to_numpy()
        parts = group["parts"][0].as_py()
        found_row, found_other, found_cosine = [], [], []
        asks = [(file, part[a : a + 128]) for file in range(INDEXED) if len(part := np.flatnonzero(files == file)) for a in range(0, len(part), 128)]
        for file, part in asks if len(posting) else ():
            # the parts of a long file share the candidates; a part may hold some more than its even share of the nearest
            even = CANDIDATES[file] / parts
            keep = min(len(posting), math.ceil(even + (2 * math.sqrt(even) if parts > 1 else 0)) + 1)
            distance = footrule(order[part], order[posting], file)
            near = np.argpartition(distance, keep - 1, axis=1)[:, :keep]
            score = np.matmul(vectors[posting[near]], vectors[part][:, :, None])[:, :, 0]
            score[(posting[near] == part[:, None]) | (np.take_along_axis(distance, near, 1) == 255)] = -2
            top = min(k, keep)
            best = np.argpartition(-score, top - 1, axis=1)[:, :top]
            good = np.take_along_axis(score, best, 1) > -2
            here, other = np.repeat(part, top)[good.ravel()], posting[np.take_along_axis(near, best, 1).ravel()[good.ravel()]]
            found_row.append(here)
            found_other.append(other)
            # in double precision, so that a pair has one value wherever it is met
            found_cosine.append((vectors[here].astype(np.float64) * vectors[other].astype(np.float64)).sum(axis=1))
        # a vector asks one file by one pivot, so all that it finds here is together
        here, other, cosine = (np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((found_row, np.int64), (found_other, np.int64), (found_cosine, np.float64)))
        starts = np.flatnonzero(np.diff(here, prepend=-1))
        near = pa.StructArray.from_arrays([pa.array(-cosine), ids.take(pa.array(other)), pa.array(copies[other] > 1)], names=["far", "rep", "many"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(here)).astype(np.int32)), near)
        return pa.table({"rep": ids.take(pa.array(here[starts])), "many": pa.array(copies[here[starts]] > 1), "near": lists})

    near_type = "array<struct<far: double, rep: string, many: boolean>>"
    posts = classes.select("rep", "vec", "size").mapInArrow(post, "cell int, parts int, rep string, vec binary, pivots binary, copies long, posting boolean, file int")
    found = posts.groupBy("cell").applyInArrow(search, f"rep string, many boolean, near {near_type}")
    best = found.groupBy("rep", "many").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))
    # read three times below; the search runs once
    return _members(cut(best), classes, members, k)


def _members(best: DataFrame, classes: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours of rows from neighbours of classes. Rows without copies near or of themselves go straight through.

    Rows with k copies or more have their neighbours among them.
    """
    best = best.withColumn("mixed", F.col("many") | F.exists("near", lambda x: x["many"]))
    plain = best.where(~F.col("mixed")).select(F.col("rep").alias("id"), F.explode("near").alias("n")).select("id", F.col("n.rep").alias("neighbour"), (-F.col("n.far")).alias("cosine"))
    copied = classes.where(F.col("size") > 1)
    # rows of classes with copies; a class that the index found no neighbour for is there as well. Classes with a large share of all
    # rows, at most HOT_CLASSES of them, are joined by broadcast, so that no key of the other join has more than that share
    hot = F.col("size") > classes.agg((F.sum("size") / HOT_CLASSES).alias("least")).select("least").scalar()
    of = copied.select("vec", "rep", "heads", "size", hot.alias("hot"))
    hottest, rest = of.where("hot").drop("hot"), of.where("NOT hot").drop("hot")

    def with_class(rows: DataFrame, on: str) -> DataFrame:
        few = F.broadcast(hottest)
        return rows.join(few, on).unionByName(rows.join(few.select(on), on, "left_anti").join(rest, on))

    of_class = with_class(members, "vec").select("id", "rep", "heads", "size")
    mixed = best.where(F.col("mixed"))
    seeker = mixed.where(~F.col("many")).select(F.col("rep").alias("id"), "rep").unionByName(of_class.where(F.col("size") <= k).select("id", "rep"))
    other = mixed.select("rep", F.explode("near").alias("n")).select("rep", "n.far", F.col("n.rep").alias("other"), F.col("n.many").alias("several"))
    # a neighbouring class stands for its least k + 1 members
    single = other.where(~F.col("several")).select("rep", "far", F.col("other").alias("neighbour"))
    near = other.where("several").select(F.col("rep").alias("seeking"), "far", F.col("other").alias("rep"))
    several = with_class(near, "rep").select(F.col("seeking").alias("rep"), "far", F.explode(F.slice("heads", 1, k)).alias("neighbour"))
    own = of_class.select("id", F.lit(-1.0).alias("far"), F.explode("heads").alias("neighbour")).where("id != neighbour")
    outside = seeker.join(_first(single.unionByName(several), "rep", k), "rep").select("id", "far", "neighbour")
    joined = _first(own.unionByName(outside), "id", k).select("id", "neighbour", (-F.col("far")).alias("cosine"))
    return plain.unionByName(joined)


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy("far", "neighbour")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b), a < b: pairs of which at least one is among the nearest of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
