"""Generated, minified, vendored and data files among source files (problem 2).

Method: a linear support-vector classifier on hashed character n-grams and path components. Files that give themselves
away (a generator's or licence's header, a vendor directory, a minifier's suffix, tables of literals) label a bounded
sample; such files are learned as they are, and two in three also with their giveaway lines masked, so that the
classifier must recognise the text as well. Repositories, not files, are split into training and validation. What a file shares with
other repositories enters as one more component; since the classifier is linear, its share of the score is added by a
join of numbers, and texts are never shuffled for it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.models import kept
from tessera.session import cut

#: Buckets of n-grams and of components; lengths of the n-grams in bytes.
GRAM_BUCKETS, PART_BUCKETS, GRAMS = 1 << 16, 1 << 13, (4, 6)
#: Files of the training sample, about; drawn by a hash of file_id from all files.
SAMPLE_FILES = 6000
#: Runs of this many code lines are compared between repositories; what part of a file's runs others have counts in so many steps.
LINES, STEPS = 3, 8
ROUNDS, EPOCHS, COSTS, HELD_OUT = 4, 10, (1.0, 4.0), 5
#: In each round, unlabelled files above the first score are left out, those above the second count as unwritten.
DOUBTFUL, SURE = -0.7, 0.2

# What tools and licences write into a file's head, directories and names that say where a file comes from.
_HEAD = re.compile(
    r"(?i)generated by|code generated|@generated|auto-?generated|autogenerated|automatically generated|generated with|not modify by hand"
    r"|manual edits|changes will be lost|vendored copy|copied from \S+ \(release|- upstream:|spdx-license|@license|the \S+ contributors|redistribution and use"
)
_DIRS = frozenset("node_modules vendor third_party thirdparty site-packages bower_components __generated__ autogen generated-sources gen deps external".split())
_NAMES = re.compile(r"(?i)\.min\.m?js$|[._-]lock\.(json|yaml|toml)$|-lock\.|\.lock$|^npm-shrinkwrap\.json$|^go\.sum$|_pb2\.\w+$|\.pb\.\w+$|\.g\.\w+$|\.generated\.\w+$|^[\w-]+\.[0-9a-f]{8}\.js$")
_COMMENT = re.compile(r"\s*(?://|#|/\*|\*|<!--|--|\"\"\")")
_LITERAL = re.compile(r"(?:[-+]?(?:0x[0-9a-fA-F]+|\d[\d.eE+-]*)|\"[^\"\n]*\"|'[^'\n]*')(?:\s*:\s*(?:\"[^\"\n]*\"|[-\d.]+))?\s*,\s*")


def masked(text: str) -> str:
    """``text`` without the comment lines of its head that give its origin away."""
    lines = text.split("\n")
    head = [line for line in lines[:12] if not (_COMMENT.match(line) and _HEAD.search(line))]
    return "\n".join(head + lines[12:])


def gives_away(path: str, text: str) -> bool:
    """Whether path or text say openly that nobody wrote the file by hand; labels the training sample."""
    parts = path.split("/")
    if _DIRS.intersection(parts[:-1]) or _NAMES.search(parts[-1]):
        return True
    head = "\n".join(line for line in text.split("\n")[:12] if _COMMENT.match(line))
    if _HEAD.search(head):
        return True
    if len(text) > 4000 and sum(m.end() - m.start() for m in _LITERAL.finditer(text)) > 0.75 * len(text):
        return True
    return len(text) > 800 and parts[-1].endswith((".js", ".mjs")) and len(text) > 300 * (text.count("\n") + 1)


def _digits_alike(text: str) -> bytes:
    return re.sub(rb"[1-9]", b"0", text.encode("utf-8", "surrogatepass"))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of the character n-grams of a whole text, of length one."""
    raw = np.frombuffer(_digits_alike(text), dtype=np.uint8).astype(np.uint32)
    found = []
    for n in GRAMS:
        if len(raw) >= n:
            code = np.full(len(raw) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) ^ raw[k : len(raw) - n + 1 + k]
            code ^= code >> np.uint32(15)
            code *= np.uint32(0x85EBCA6B)
            found.append(code >> np.uint32(16))
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32)
    counts = np.bincount(np.concatenate(found), minlength=GRAM_BUCKETS)
    buckets = np.flatnonzero(counts)
    values = np.sqrt(counts[buckets]).astype(np.float32)
    return buckets, values / np.linalg.norm(values)


#: Letters among the first 128 characters; the last entry stands for all others.
_IS_LETTER = np.array([chr(k).isalpha() for k in range(128)] + [True])


def _bucket(part: str) -> int:
    return GRAM_BUCKETS + zlib.crc32(part.encode("utf-8", "surrogatepass")) % PART_BUCKETS


def components(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of directories, parts of the name and the shape of the text."""
    *dirs, name = path.split("/")
    lines = text.count("\n") + 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = float((_IS_LETTER[np.minimum(codes, 128)]).mean()) if len(codes) else 0.0
    parts = [f"dir:{re.sub(r'[0-9]+', '0', d)}" for d in dirs]
    parts += [f"name:{re.sub(r'[0-9]+', '0', p)}" for p in re.split(r"[._-]", name)[1:]] + [f"end:{name[name.find('.') :]}" if "." in name else "end:"]
    digits = float(((codes >= 48) & (codes <= 57)).mean()) if len(codes) else 0.0
    alike = [line for line in re.sub(r"[0-9]+", "0", text).split("\n") if len(line) > 8]
    repeats = 1 - len(set(alike)) / len(alike) if len(alike) > 4 else 0.0
    parts += [f"digits:{int(digits * 20)}", f"repeats:{int(repeats * 8)}"]
    parts += [f"long:{min(12, int(np.log2(len(text) / lines + 1)))}", f"size:{int(np.log2(len(text) + 1))}", f"letters:{int(letters * 10)}"]
    # masked texts have no giveaway
    parts += ["head"] * any(_COMMENT.match(line) and _HEAD.search(line) for line in text.split("\n", 12)[:12])
    buckets = np.array(sorted({_bucket(p) for p in parts}), dtype=np.int64)
    values = np.full(len(buckets), 0.25, dtype=np.float32)
    values[buckets == _bucket("head")] = 4.0
    return buckets, values


def _shared_part(shared: int) -> int:
    return _bucket(f"shared:{shared}")


SHARED_VALUE = np.float32(0.5)


def features(path: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """All components of a file but what it shares with other repositories."""
    a, b = grams(text), components(path, text)
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])


@dataclass
class LinearModel:
    """weights and bias; quality holds accuracy, precision and recall on held-out repositories."""

    weights: np.ndarray
    bias: float
    quality: dict[str, float] = field(default_factory=dict)

    def score(self, buckets: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[buckets] @ values) + self.bias


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, cost: float, epochs: int = EPOCHS, seed: int = 7) -> LinearModel:
    """Linear support-vector machine with squared hinge loss, by dual coordinate descent."""
    weights, bias = np.zeros(GRAM_BUCKETS + PART_BUCKETS, dtype=np.float64), 0.0
    sign = np.where(labels, 1.0, -1.0)
    share = max(1, int(labels.sum())) / max(1, len(labels))
    costs = np.where(labels, cost * min(4.0, 0.5 / share), cost)
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for _, v in rows]) + 0.5 / costs
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            buckets, values = rows[i]
            slope = sign[i] * (weights[buckets] @ values + bias) - 1 + alpha[i] * 0.5 / costs[i]
            new = max(0.0, alpha[i] - slope / square[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[buckets] += step * values
                bias += step
                alpha[i] = new
    return LinearModel(weights, bias)


def train(sample: pd.DataFrame) -> LinearModel:
    """From columns file_path, text, repo_id, shared, body; deterministic.

    Files of one body are labelled alike. Most files whose origin doesn't show have no label, so in each further round unlabelled
    files that the classifier doubts are left out, and those it is sure of count as unwritten.
    """
    sample = sample.reset_index(drop=True)
    label = np.array([gives_away(p, t) for p, t in zip(sample["file_path"], sample["text"], strict=True)], dtype=bool)
    of_body: dict[str, bool] = {}
    for body, known in zip(sample["body"], label, strict=True):
        if body:
            of_body[body] = of_body.get(body, False) or bool(known)
    label |= np.array([of_body.get(b, False) for b in sample["body"]], dtype=bool)
    rows, owner = [], []
    for k, (path, text, shared) in enumerate(zip(sample["file_path"], sample["text"], sample["shared"], strict=True)):
        bare = masked(text)
        # two in three are learned masked as well: the text must tell by itself, and the head by itself
        for version in [text, bare] if bare != text and zlib.crc32(path.encode()) % 3 else [text]:
            buckets, values = features(path, version)
            rows.append((np.append(buckets, _shared_part(int(shared))).astype(np.int32), np.append(values, SHARED_VALUE)))
            owner.append(k)
    owner = np.array(owner, dtype=np.int64)
    held = np.array([zlib.crc32(str(r).encode()) % HELD_OUT == 0 for r in sample["repo_id"]], dtype=bool)[owner]
    truth, keep = label[owner], np.ones(len(rows), dtype=bool)

    def fitted_to(labels: np.ndarray, mask: np.ndarray, cost: float) -> LinearModel:
        return fit_svm([rows[k] for k in np.flatnonzero(mask)], labels[mask], cost)

    model, best = LinearModel(np.zeros(GRAM_BUCKETS + PART_BUCKETS), -1.0), (-1.0, COSTS[0], {})
    if not truth.any() or truth.all():
        return model if not truth.any() else LinearModel(model.weights, 1.0)
    for cost in COSTS if held.any() and truth[~held].any() else ():
        trial = fitted_to(truth, ~held, cost)
        said = np.array([trial.score(*rows[k]) > 0 for k in np.flatnonzero(held)])
        right = truth[held]
        hits = int((said & right).sum())
        quality = {"accuracy": float((said == right).mean()), "precision": hits / max(1, int(said.sum())), "recall": hits / max(1, int(right.sum())), "n": float(len(right))}
        if quality["accuracy"] > best[0]:
            best = (quality["accuracy"], cost, quality)
    seen = truth.copy()
    for _ in range(ROUNDS):
        model = fitted_to(seen, keep, best[1])
        scores = np.array([model.score(*row) for row in rows])
        seen = truth | (scores > SURE)
        keep = seen | (scores < DOUBTFUL)
    model = fitted_to(seen, keep, best[1])
    model.quality = best[2]
    return model


def with_hashes(files: DataFrame) -> DataFrame:
    """Adds hashes: those of the distinct runs of LINES code lines; comments, imports and short lines don't count."""
    line = "transform(split(text, '\\n'), x -> trim(BOTH ' \\t\\r{}();,' FROM x))"
    code = F.expr(f"filter({line}, x -> length(x) >= 12 AND NOT x RLIKE '^(//|#|[*]|/[*]|import |from |use strict|package )' AND NOT contains(x, 'require('))")
    with_code = files.withColumn("code", code)
    runs = F.expr(f"CASE WHEN size(code) >= {LINES} THEN transform(sequence(0, size(code) - {LINES}), i -> xxhash64({', '.join(f'code[i + {k}]' for k in range(LINES))})) ELSE array() END")
    return with_code.withColumn("hashes", F.array_distinct(runs)).drop("code")


def shared_hashes(files: DataFrame) -> DataFrame:
    """(file_id, shared): what part of a file's hashes, all of them counted, occurs in another repository as well, in STEPS steps; absent where none."""
    each = files.select("file_id", F.xxhash64(F.coalesce("repo_id", F.lit(""))).alias("repo"), F.size("hashes").alias("of"), F.explode("hashes").alias("hash"))
    common = each.groupBy("hash").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a != b").select("hash")
    # a run that a large part of all files has is dealt over several tasks by AQE; what is joined are two numbers a run
    hits = each.join(common, "hash").groupBy("file_id", "of").agg(F.count(F.lit(1)).alias("n"))
    return hits.select("file_id", F.round(F.col("n") * STEPS / F.col("of")).cast("int").alias("shared"))


def _fitted(files: DataFrame, shared: DataFrame) -> LinearModel:
    """The classifier from about SAMPLE_FILES of the files."""
    number = files.count()
    drawn = F.pmod(F.xxhash64("file_id"), F.lit(1_000_000)) < F.lit(int(min(1.0, SAMPLE_FILES / max(1, number)) * 1_000_000))
    body = F.array_join(F.slice(F.array_sort("hashes").cast("array<string>"), 1, 4), " ").alias("body")
    sample = files.where(drawn).select("file_id", "file_path", "repo_id", "text", body).toPandas().sort_values("file_id")
    known = shared.where(drawn).toPandas()
    sample = sample.merge(known, on="file_id", how="left").fillna({"shared": 0})
    return train(sample)


def scored(files: DataFrame) -> tuple[DataFrame, LinearModel]:
    """(file_id, file_path, score), unwritten where score > 0; from file_id, file_path, repo_id and text.

    Null texts and paths count as empty; an empty file gets the score of its path and shape. Every file is scored by
    its whole text. The classifier is fitted on about SAMPLE_FILES of the files, or taken from the folder for models.
    """
    files = files.select("file_id", F.coalesce("file_path", F.lit("")).alias("file_path"), "repo_id", F.coalesce("text", F.lit("")).alias("text"))
    files = cut(with_hashes(files))
    shared = cut(shared_hashes(files))
    model = kept(files.sparkSession, "handwritten", lambda: _fitted(files, shared))
    weights = files.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, bias = weights.value
        for batch in batches:
            scores = []
            for path, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                buckets, values = features(path, text.as_py())
                scores.append(float(weight[buckets] @ values) + bias)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["file_id", "file_path", "score"])

    own = files.select("file_id", "file_path", "text").mapInArrow(run, "file_id string, file_path string, score double")
    part = [float(model.weights[_shared_part(k)] * SHARED_VALUE) for k in range(STEPS + 1)]
    extra = F.element_at(F.array(*[F.lit(p) for p in part]), F.coalesce("shared", F.lit(0)) + 1)
    return own.join(shared, "file_id", "left").select("file_id", "file_path", (F.col("score") + extra).alias("score")), model
