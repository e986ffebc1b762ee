"""Filling fixed-capacity containers with whole texts (problem 8).

Method: lexical retrieval packing. Documents are dealt to shards by their weightiest word, so that those which retrieve
each other meet however many shards there are; each shard is an inverted index scored by BM25 with document frequencies of
the whole corpus. The largest unused document of a shard is the seed of a container, the unused documents that its words
retrieve fill the window in order of score, and what room is left takes the largest unused documents that still fit.
Words share a shard until it is full, and the documents of a word that fill several are spread over them, so shards hold a
bounded number of tokens and tasks stay equal at any size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import TOKENIZERS, TokenCounts, token_counts
from tessera.session import cut, spread

#: Terms are hashed into this many buckets, which bounds the table of document frequencies.
BUCKETS = 1 << 18
#: Tokens of a shard, on average.
SHARD_TOKENS = 2_000_000
#: BM25 parameters, and how many of the seed's words of greatest weight make the query.
K1, B, QUERY_TERMS = 1.2, 0.75, 16
#: How a text came into its container.
HOW = ("seed", "retrieved", "size", "split")


def _terms_of(word: str) -> tuple[int, ...]:
    """Term buckets of a word: itself in lower case; pairs of characters where a script has no spaces."""
    bare = word.strip().lower()
    if len(bare) < 3 and bare.isascii() or not any(c.isalnum() for c in bare):
        return ()
    parts = [bare[k : k + 2] for k in range(len(bare) - 1)] or [bare] if max(bare) >= "⺀" else [bare]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts)


def sized(df: DataFrame, key: str, text: str, name: str, folder: str) -> DataFrame:
    """(doc, n_tokens, terms, often): size in tokens, distinct term buckets and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = token_counts(folder, name)
        for batch in batches:
            for first, _, numbers in counts.blocks(batch.column(1), 512):
                term_of = _term_table(counts)
                found = [term_of(n) for n in numbers]
                yield pa.record_batch(
                    [
                        batch.column(0).slice(first, len(numbers)),
                        pa.array([int(counts.tokens[n].sum()) for n in numbers], pa.int64()),
                        pa.array([t for t, _ in found], pa.list_(pa.int32())),
                        pa.array([o for _, o in found], pa.list_(pa.int32())),
                    ],
                    names=["doc", "n_tokens", "terms", "often"],
                )

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, f"doc {kind}, n_tokens long, terms array<int>, often array<int>")


def _term_table(counts: TokenCounts):
    """Looks up the terms of words by number; words of several terms are few and taken one by one."""
    one = counts.per_word("term", lambda w: (t := _terms_of(w)) and (t[0] if len(t) == 1 else -2) or (0 if t else -1), np.int64)

    def terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = one[words]
        several = [t for w in words[found == -2] for t in _terms_of(counts.book.words[w])]
        every = np.concatenate([found[found >= 0], np.array(several, dtype=np.int64)])
        kinds, often = np.unique(every, return_counts=True)
        return kinds.astype(np.int32), often.astype(np.int32)

    return terms


class _Unused:
    """Items in order of size; finds the largest unused one that fits."""

    def __init__(self, sizes: np.ndarray):
        self.order = np.argsort(sizes, kind="stable")
        self.sorted = sizes[self.order]
        self.rank = np.empty(len(sizes), dtype=np.int64)
        self.rank[self.order] = np.arange(len(sizes))
        self.below = list(range(-1, len(sizes)))  # below[k + 1]: k itself, or the next lower that may be unused
        self.used = np.zeros(len(sizes), dtype=bool)

    def take(self, item: int) -> None:
        self.used[item] = True
        k = int(self.rank[item]) + 1
        self.below[k] = k - 2

    def largest(self, room: int) -> int:
        """-1 if none fits."""
        k = int(np.searchsorted(self.sorted, room, side="right"))
        path = []
        while (at := self.below[k]) != k - 1 and k:
            path.append(k)
            k = at + 1
        for p in path:
            self.below[p] = k - 1
        return int(self.order[k - 1]) if k else -1


def pack_shard(sizes: np.ndarray, terms: np.ndarray, often: np.ndarray, owner: np.ndarray, idf: np.ndarray, average: float, capacity: int, how: np.ndarray | None = None) -> np.ndarray:
    """The container number of every item; terms, often and owner are the postings, in any order. ``how`` is filled with places in HOW.

    Every item has at most ``capacity`` tokens. Deterministic: equal scores go by item number.
    """
    weight = _weights(sizes, terms, often, owner, idf, average)
    how = np.zeros(len(sizes), dtype=np.int8) if how is None else how
    by_term = np.lexsort((owner, terms))
    term, post_owner, post_weight = terms[by_term], owner[by_term], weight[by_term]
    by_owner = np.lexsort((-weight, owner))
    first_of = np.searchsorted(owner[by_owner], np.arange(len(sizes) + 1))
    unused, container = _Unused(sizes), np.full(len(sizes), -1, dtype=np.int64)
    number = 0
    while (seed := unused.largest(capacity)) >= 0:
        unused.take(seed)
        container[seed] = number
        room = capacity - int(sizes[seed])
        asked = terms[by_owner[first_of[seed] : first_of[seed + 1]][:QUERY_TERMS]]
        if room and len(asked):
            spans = [np.arange(a, b) for a, b in zip(np.searchsorted(term, asked), np.searchsorted(term, asked, side="right"), strict=True)]
            hits = np.concatenate(spans)
            hits = hits[~unused.used[post_owner[hits]]]
            hits = hits[sizes[post_owner[hits]] <= room]
            if len(hits):
                items, place = np.unique(post_owner[hits], return_inverse=True)
                score = np.bincount(place, weights=post_weight[hits])
                for item in items[np.lexsort((items, -score))]:
                    if sizes[item] <= room:
                        unused.take(int(item))
                        container[item], how[item] = number, 1
                        room -= int(sizes[item])
                        if not room:
                            break
        while room and (item := unused.largest(room)) >= 0:
            unused.take(item)
            container[item], how[item] = number, 2
            room -= int(sizes[item])
        number += 1
        if room == 0 and sizes[unused.order[0]] == 0 and not unused.used[unused.order[0]]:
            # texts without tokens go wherever a container is, full or not
            while (item := unused.largest(0)) >= 0:
                unused.take(item)
                container[item], how[item] = number - 1, 2
    return container


def _weights(sizes: np.ndarray, terms: np.ndarray, often: np.ndarray, owner: np.ndarray, idf: np.ndarray, average: float) -> np.ndarray:
    """BM25 weights of postings."""
    return idf[terms] * often * (K1 + 1) / (often + K1 * (1 - B + B * np.maximum(sizes, 1)[owner] / average))


def weightiest(sizes: np.ndarray, terms: np.ndarray, often: np.ndarray, owner: np.ndarray, idf: np.ndarray, common: np.ndarray, average: float) -> np.ndarray:
    """The term of greatest weight of each text, of those that other texts have as well if there are any; BUCKETS for texts without terms."""
    weight = _weights(sizes, terms, often, owner, idf, average)
    order = np.lexsort((terms, -weight, ~common[terms], owner))
    first = np.searchsorted(owner[order], np.arange(len(sizes)))
    has = np.bincount(owner, minlength=len(sizes)) > 0
    out = np.full(len(sizes), BUCKETS, dtype=np.int32)
    out[has] = terms[order[first[has]]]
    return out


SCHEMA = "profile string, container string, doc {}, part int, token_start long, n_tokens long, how string"


def pack(df: DataFrame, key: str, text: str, profiles: Sequence[tuple[str, int]], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(profile, container, key, part, token_start, n_tokens, how): every text in a container, for each (profile, capacity).

    A text over the capacity is split into parts of exactly the capacity, each a container of its own, and a
    remainder that is packed like a text; no other text is split. Null and empty texts have no tokens and go into any
    container. Rows with a repeated key count once. An empty table gives no rows.
    """
    docs = cut(sized(df, key, text, name, folder))
    total, number = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    average = max(1.0, total / max(1, number))
    # at most BUCKETS rows, however large the corpus
    frequency = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).toPandas()
    n = np.zeros(BUCKETS)
    n[frequency["term"].to_numpy(dtype=np.int64)] = frequency["n"].to_numpy(dtype=np.float64)
    idf = np.log1p((number - n + 0.5) / (n + 0.5)).astype(np.float32)
    spark = df.sparkSession
    shared, common = spark.sparkContext.broadcast(idf), spark.sparkContext.broadcast(n > 1)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            often = batch.column(3).flatten().to_numpy().astype(np.float32)
            key = weightiest(batch.column(1).to_numpy(), lists.flatten().to_numpy(), often, owner, shared.value, common.value, average)
            yield pa.record_batch([*batch.columns, pa.array(key)], names=["doc", "n_tokens", "terms", "often", "key"])

    kind = df.schema[key].dataType.simpleString()
    with_key = docs.mapInArrow(keyed, f"doc {kind}, n_tokens long, terms array<int>, often array<int>, key int")
    # at most BUCKETS + 1 rows: which shards the texts of a word go to, in order of the words
    loads = with_key.groupBy("key").agg(F.sum(F.col("n_tokens") + 1).alias("load")).toPandas().sort_values("key")
    load = loads["load"].to_numpy(dtype=np.int64)
    loads["first"] = (np.cumsum(load) - load) // SHARD_TOKENS
    loads["span"] = np.maximum(1, -(-load // SHARD_TOKENS))
    places = spark.createDataFrame(loads[["key", "first", "span"]].astype(np.int64), "key long, first long, span long")

    def run(group: pa.Table) -> pa.Table:
        shard = group.column("shard")[0].as_py()
        group = group.sort_by([("doc", "ascending")])
        keys = group.column("doc").to_pylist()
        keep = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        group = group.take(keep).combine_chunks()
        doc = group.column("doc").combine_chunks()
        whole = group.column("n_tokens").to_numpy()
        lists = group.column("terms").combine_chunks()
        owner = np.repeat(np.arange(len(whole)), np.diff(lists.offsets.to_numpy()))
        terms = lists.flatten().to_numpy()
        often = group.column("often").combine_chunks().flatten().to_numpy().astype(np.float32)
        out = []
        for profile, capacity in profiles:
            full = np.where(whole > capacity, whole // capacity, 0)
            rest = whole - full * capacity
            item = np.flatnonzero((rest > 0) | (full == 0))  # what is packed; the other texts end with a full part
            of_doc = np.full(len(whole), -1)
            of_doc[item] = np.arange(len(item))
            ours = of_doc[owner] >= 0
            how = np.zeros(len(item), dtype=np.int8)
            container = pack_shard(rest[item], terms[ours], often[ours], of_doc[owner[ours]], shared.value, average, capacity, how)
            split = np.repeat(np.arange(len(whole)), full)
            part = np.arange(len(split)) - np.repeat(np.cumsum(full) - full, full)
            rows = np.concatenate([item, split])
            names = [f"{profile}-{shard}-{c}" for c in container] + [f"{profile}-{shard}-s{k}" for k in range(len(split))]
            parts = np.concatenate([full[item], part])
            out.append(
                pa.table(
                    {
                        "profile": pa.array([profile] * len(rows), pa.string()),
                        "container": pa.array(names, pa.string()),
                        "doc": doc.take(pa.array(rows)),
                        "part": pa.array(parts, pa.int32()),
                        "token_start": pa.array(parts * capacity, pa.int64()),
                        "n_tokens": pa.array(np.concatenate([rest[item], np.full(len(split), capacity)]), pa.int64()),
                        "how": pa.array([HOW[h] for h in how] + ["split"] * len(split), pa.string()),
                    }
                )
            )
        return pa.concat_tables(out)

    shard = (F.col("first") + F.pmod(F.xxhash64("doc"), F.col("span"))).cast("int")
    rows = with_key.join(F.broadcast(places), "key").select("doc", "n_tokens", "terms", "often", shard.alias("shard"))
    return rows.groupBy("shard").applyInArrow(run, SCHEMA.format(kind)).withColumnRenamed("doc", key)
