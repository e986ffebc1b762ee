"""Encoding of a corpus with a public byte-level tokenizer (problem 7).

Method: DuckDB recursive queries inside each Spark partition. All distinct words of a block of documents become
token-position rows; each step joins neighbouring positions with the merge table and contracts pairs of every word, until
no word has a pair left. The recursion is keyed by word and position: only the last state is held, only what a step
changes is written, and a word without a pair leaves it. An ordered aggregation gives each word's ids, and documents are
assembled from their words. Nothing is shuffled, no document leaves its partition, and memory is bounded by the block
size and the worker's word book.

A step contracts what repeated contraction of the leftmost pair of least rank would contract next, whatever else it did
in between. A token comes from one merge, and merges that use it have greater ranks (checked when the table is read), so
a contraction only makes pairs of at least the least rank that uses its token. Below the least such rank of a word's
pairs, its sequence is that of the pairs that are there: of overlapping pairs the one of lesser rank goes first, of equal
ones the left. Hence every such pair whose overlapping pairs come later is contracted at once, and in a run of equal pairs
every second one from the left.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import TOKENIZERS, WordBook
from tessera.session import spread

#: Characters of text that are encoded together.
BLOCK_CHARS = 24_000_000

CONTRACT = """
WITH RECURSIVE state(word, pos, token) USING KEY (word, pos) AS (
    SELECT word, pos, token FROM start
    UNION
    SELECT word, unnest([pos, next_pos]) AS pos, unnest([merged, -1]) AS token
    FROM (
        SELECT *, max(CASE WHEN opens THEN place * 2 + free END) OVER (PARTITION BY word ORDER BY pos) AS run
        FROM (
            SELECT *, row_number() OVER w AS place, min(uses) OVER (PARTITION BY word) AS until,
                NOT coalesce(lag(next_pos) OVER w = pos AND lag(rank) OVER w = rank, false) AS opens,
                (NOT coalesce(lag(next_pos) OVER w = pos AND lag(rank) OVER w < rank, false))::INT AS free,
                NOT coalesce(lead(pos) OVER w = next_pos AND lead(rank) OVER w < rank, false) AS last_free
            FROM (
                SELECT s.word, s.pos, s.next_pos, m.rank, m.merged, m.uses
                FROM (
                    SELECT word, pos, token, lead(token) OVER o AS following, lead(pos) OVER o AS next_pos
                    FROM recurring.state WHERE token >= 0 AND word IN (SELECT word FROM state)
                    WINDOW o AS (PARTITION BY word ORDER BY pos)
                ) s JOIN merges m ON m.a = s.token AND m.b = s.following
            )
            WINDOW w AS (PARTITION BY word ORDER BY pos)
        )
    )
    WHERE rank < until AND run & 1 = 1 AND (place - (run >> 1)) % 2 = 0 AND last_free
)
SELECT word, list(token ORDER BY pos) AS ids FROM state WHERE token >= 0 GROUP BY word ORDER BY word
"""

#: The merge table with the least rank of a merge that uses what each merge gives.
MERGES = """
CREATE TABLE merges AS SELECT m.*, coalesce(u.uses, 1000000000) AS uses FROM pairs m LEFT JOIN
    (SELECT token, min(rank) AS uses FROM (SELECT a AS token, rank FROM pairs UNION ALL SELECT b, rank FROM pairs) GROUP BY token) u ON u.token = m.merged
"""


class ByteEncoder:
    """Word ids by merge rank; one per Python worker."""

    def __init__(self, folder: str, name: str):
        import duckdb

        with open(f"{folder}/{name}.json", encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        letters = _byte_letters()
        self.byte_id = np.array([vocabulary[letters[b]] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table(
            {
                "a": pa.array([vocabulary[a] for a, _ in pairs], pa.int32()),
                "b": pa.array([vocabulary[b] for _, b in pairs], pa.int32()),
                "rank": pa.array(range(len(pairs)), pa.int64()),
                "merged": pa.array([vocabulary[a + b] for a, b in pairs], pa.int32()),
            }
        )
        self.db.register("pairs", table)
        self.db.execute(MERGES)
        if self.db.sql("SELECT count(*) > count(DISTINCT merged) OR bool_or(uses <= rank) FROM merges").fetchall()[0][0]:
            raise ValueError(f"{name}: a token of several merges, or used by an earlier one")
        self.book = WordBook()
        self._reset()

    def _reset(self) -> None:
        self.book.clear()
        self.pool = np.zeros(0, dtype=np.int32)
        self.length = np.zeros(0, dtype=np.int64)
        self.start = np.zeros(0, dtype=np.int64)

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words by contraction; a single word may be long, since positions are rows."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        offset = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        start = pa.table(  # noqa: F841 - DuckDB reads it by name
            {
                "word": word,
                "pos": (np.arange(len(word)) - offset[word]).astype(np.int64),
                "token": self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)],
            }
        )
        out = self.db.sql(CONTRACT).to_arrow_table()["ids"].combine_chunks()
        values, ends = out.values.to_numpy(), out.offsets.to_numpy()
        return [values[ends[k] : ends[k + 1]] for k in range(len(words))]

    def learn(self) -> None:
        """Give ids to the words that have none yet."""
        new = [w.encode("utf-8", "surrogatepass") for w in self.book.words[len(self.length) :]]
        if not new:
            return
        parts = [x.astype(np.int32) for x in self._contract(new)]
        added = np.array([len(p) for p in parts], dtype=np.int64)
        first = len(self.pool) + np.concatenate(([0], np.cumsum(added)[:-1]))
        self.pool = np.concatenate([self.pool, *parts])
        self.length = np.concatenate([self.length, added])
        self.start = np.concatenate([self.start, first])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the n + 1 offsets; null and empty texts have no ids."""
        if self.book.full():
            self._reset()
        numbers = [self.book.numbers(t) if t else np.zeros(0, dtype=np.int32) for t in texts]
        self.learn()
        sizes = np.array([self.length[n].sum() for n in numbers], dtype=np.int64)
        words = np.concatenate(numbers) if numbers else np.zeros(0, dtype=np.int32)
        lengths = self.length[words]
        where = np.repeat(self.start[words] - np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(words) else lengths, lengths)
        ids = self.pool[where + np.arange(len(where))] if len(where) else np.zeros(0, dtype=np.int32)
        return ids, np.concatenate(([0], np.cumsum(sizes)))


_ENCODERS: dict[tuple[str, str], ByteEncoder] = {}


def encoder(folder: str, name: str) -> ByteEncoder:
    """The worker's encoder; kept between tasks of one Python worker."""
    if (folder, name) not in _ENCODERS:
        _ENCODERS[folder, name] = ByteEncoder(folder, name)
    return _ENCODERS[folder, name]


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encode_corpus(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids array<int>), one row per input row, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are ordinary text; lone surrogates cannot occur
    in Spark strings. Other columns of ``df`` are dropped; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(folder, name)

        def emit(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            texts = [t for b in block for t in b.column(1).to_pylist()]
            keys = pa.chunked_array([b.column(0) for b in block]).combine_chunks()
            ids, ends = tool.encode(texts)
            if ends[-1] < 2**31:
                yield pa.record_batch([keys, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))], names=["key", "ids"])
            else:  # more ids than one batch can point at: one batch a document
                for k in range(len(texts)):
                    yield pa.record_batch([keys.slice(k, 1), pa.array([ids[ends[k] : ends[k + 1]]], pa.list_(pa.int32()))], names=["key", "ids"])

        block, chars = [], 0
        for batch in batches:
            block.append(batch)
            chars += batch.column(1).nbytes
            if chars > BLOCK_CHARS:
                yield from emit(block)
                block, chars = [], 0
        if block:
            yield from emit(block)

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return spread(rows).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


DECODE = """
SELECT doc, string_agg(letters, '' ORDER BY pos) AS letters
FROM (SELECT doc, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM docs) JOIN vocabulary USING (id) GROUP BY doc
"""


def decode_corpus(df: DataFrame, key: str, ids: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) from (key, ids): the inverse of ``encode_corpus``; null and empty lists give an empty text.

    Bytes that are no valid UTF-8 come out as U+FFFD, ids outside the vocabulary are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with open(f"{folder}/{name}.json", encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in _byte_letters().items()}
        db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        letters_of = pa.table({"id": pa.array(vocabulary.values(), pa.int32()), "letters": pa.array(vocabulary.keys())})
        db.execute("CREATE TABLE vocabulary AS SELECT * FROM letters_of")
        for batch in batches:
            docs = pa.table({"doc": pa.array(range(batch.num_rows), pa.int32()), "ids": batch.column(1)})
            db.register("docs", docs)
            texts = [""] * batch.num_rows
            for doc, letters in db.execute(DECODE).fetchall():
                texts[doc] = bytes(b for c in letters for b in ([byte_of[c]] if c in byte_of else c.encode())).decode("utf-8", "replace")
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
