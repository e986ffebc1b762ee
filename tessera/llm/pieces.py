"""Cutting oversized texts into pieces (problem 9).

Method: content-defined chunking. A rolling hash over the last words marks landmarks that depend on the text around
them only. Each cut is the first landmark between the least and the greatest size of a piece, moved to the nearest
natural boundary in that range; so an edit moves the cuts of neighbouring pieces only, and the cuts after the next
landmark stay. All of it runs where the document lies: no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import TOKENIZERS, TokenCounts, token_counts
from tessera.session import spread

#: Words under the rolling hash, and its multiplier.
WINDOW, MULTIPLIER = 12, np.uint64(0x9E3779B97F4A7C15)
#: A piece has at least this share of the greatest size; landmarks come about three times in the rest.
LEAST_SHARE, LANDMARKS = 0.5, 3
KINDS = ("inside", "word", "sentence", "line", "paragraph")


def _lines(word: str) -> int:
    return min(word.count("\n"), 2) if word.isspace() else 0


def _ends_sentence(word: str) -> bool:
    return word[-1:] in ".!?;:。！？；" and not word.isspace()


def _wide_stop(word: str) -> bool:
    return word[-1:] in "。！？；"


def boundaries(counts: TokenCounts, words: np.ndarray) -> np.ndarray:
    """The kind (index in KINDS) of a cut before each word."""
    lines = counts.per_word("lines", _lines, np.int8)[words]
    ends = counts.per_word("ends", _ends_sentence, bool)[words]
    wide = counts.per_word("wide", _wide_stop, bool)[words]
    space = counts.per_word("space", lambda w: w[:1].isspace(), bool)[words]
    kind = np.zeros(len(words), dtype=np.int8)
    kind[space] = 1
    kind[1:][(ends[:-1] & space[1:]) | wide[:-1]] = 2
    line = lines[:-1] > 0
    kind[1:][line] = 3
    paragraph = lines[:-1] > 1
    paragraph[1:] |= line[1:] & (lines[:-2] > 0)
    kind[1:][paragraph] = 4
    # within a run of line ends the cut belongs behind the last of them
    kind[:-1][(lines[:-1] > 0) & (kind[:-1] >= 3)] = 1
    return kind


def rolling_hash(base: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW words before each word, from the hash of each; equal wherever these words are equal."""
    total = np.zeros(len(base), dtype=np.uint64)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for back in range(1, WINDOW + 1):
            factor = factor * MULTIPLIER + np.uint64(1)
            if back < len(base):
                total[back:] += base[:-back] * factor
        total ^= total >> np.uint64(29)
        total *= MULTIPLIER
    return total >> np.uint64(32)


def landmarks(base: np.ndarray, tokens: np.ndarray, within: int) -> np.ndarray:
    """The words before which a landmark lies, about LANDMARKS in ``within`` tokens.

    The chance of a place grows with the tokens of the word before it, so landmarks are as dense in texts of long words and
    of short ones, while each is decided by the words under the hash alone, whatever the rest of the text is.
    """
    chance = tokens[:-1].astype(np.uint64) * np.uint64((LANDMARKS << 32) // max(1, within))
    return 1 + np.flatnonzero(rolling_hash(base)[1:] < chance)


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def _units(counts: TokenCounts, word: str) -> tuple[list[int], list[int], list[int]]:
    """(tokens, characters, hash) of the smallest parts of a word that begin with a token and a character: mostly one token each."""
    tokens, chars, hashes, raw, held = [], [], [], b"", 0
    for token in counts.encoding.encode_ordinary(word):
        raw += counts.encoding.decode_single_token_bytes(token)
        held += 1
        try:
            part = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        tokens.append(held)
        chars.append(len(part))
        hashes.append(zlib.crc32(raw))
        raw, held = b"", 0
    return tokens, chars, hashes


def _inner_start(counts: TokenCounts, word: str, tokens: int) -> int:
    """Characters of ``word`` before its last ``tokens`` tokens, at a character."""
    encoding = counts.encoding
    ids = encoding.encode_ordinary(word)
    raw = word.encode("utf-8", "surrogatepass")
    at = sum(len(encoding.decode_single_token_bytes(t)) for t in ids[: len(ids) - tokens])
    while at and at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return len(raw[:at].decode("utf-8", "surrogatepass"))


def cut_document(counts: TokenCounts, text: str, words: np.ndarray, size: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(token_start, token_end, char_start, char_end, kind of the end) of each piece.

    Tokens are those of the whole text. A piece begins ``overlap`` tokens before the end of the one before; where that
    would split a character, at the character's first token. Words with more tokens than the range of a cut are taken
    apart into their tokens. A piece that begins or ends inside a word is counted anew by its own text, and made shorter
    until it has ``size`` tokens at most.
    """
    body = max(1, size - overlap)
    least = max(1, int(body * LEAST_SHARE))
    tokens = counts.tokens[words]
    length = counts.per_word("chars", len, np.int64)[words]
    base = counts.per_word("hash", _hash, np.uint64)[words]
    kind = boundaries(counts, words)
    whole = np.ones(len(words), dtype=bool)
    large = np.flatnonzero(tokens > max(1, body - least))
    if len(large):
        parts = [_units(counts, counts.book.words[words[k]]) for k in large]
        times = np.ones(len(words), dtype=np.int64)
        times[large] = [len(p[0]) for p in parts]
        first = np.cumsum(times) - times
        apart = np.concatenate([first[k] + np.arange(times[k]) for k in large])
        tokens, length, base = (np.repeat(x, times) for x in (tokens, length, base))
        for column, of in enumerate((tokens, length, base)):
            of[apart] = np.concatenate([p[column] for p in parts])
        spread = np.zeros(len(tokens), dtype=np.int8)
        spread[first] = kind
        kind, whole, owner = spread, np.ones(len(tokens), dtype=bool), np.repeat(words, times)
        whole[apart] = False
    else:
        owner = words
    upto = np.concatenate(([0], np.cumsum(tokens)))
    chars = np.concatenate(([0], np.cumsum(length)))
    inside_word = np.append(kind == 0, False)
    marks = landmarks(base, tokens, body - least)
    pieces: list[tuple[int, int, int, int, int]] = []
    start_token, start_char, begin, room, partial = 0, 0, 0, size, False
    while begin < len(tokens):
        if upto[-1] - upto[begin] <= room:
            end = len(tokens)
        else:
            low = int(np.searchsorted(upto, upto[begin] + min(least, room)))
            high = max(begin + 1, int(np.searchsorted(upto, upto[begin] + room, side="right")) - 1)
            low = min(max(low, begin + 1), high)
            k = int(np.searchsorted(marks, low))
            mark = int(marks[k]) if k < len(marks) and marks[k] <= high else high
            inside = kind[low : high + 1]
            for wanted in (2, 1, 0):
                places = np.flatnonzero(inside >= wanted)
                if len(places):
                    break
            end = low + int(places[np.argmin(np.abs(places + low - mark))])
        if (partial or inside_word[end]) and room > 1 and end > begin + 1:
            over = len(counts.encoding.encode_ordinary(text[start_char : chars[end]])) - size
            if over > 0:
                room = max(1, min(room, int(upto[end] - upto[begin])) - over)
                continue
        pieces.append((start_token, int(upto[end]), start_char, int(chars[end]), int(kind[end]) if end < len(tokens) else 4))
        begin, back = end, min(overlap, int(upto[end]))
        start_token = int(upto[end]) - back
        first = int(np.searchsorted(upto, start_token, side="right")) - 1
        inner = int(upto[first + 1] - start_token) if first < end else 0
        start_char, partial = int(chars[first]), first < len(tokens) and kind[first] == 0 and first > 0
        if inner and inner < tokens[first]:
            partial = True
            if whole[first]:
                start_char += _inner_start(counts, counts.book.words[owner[first]], inner)
        room = max(1, size - back)
    return pieces


SCHEMA = "doc {}, profile string, piece_no int, token_start int, token_end int, char_start int, char_end int, boundary string, text string"


def cut_oversized(df: DataFrame, key: str, text: str, profiles: Sequence[tuple[str, int, int]], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Pieces of every text with more than ``size`` tokens, for each (profile, size, overlap).

    Texts that fit, and null, empty and blank ones, give no rows. A cut goes to the end of a paragraph, line or
    sentence if there is one in range, else to a word's start, else between signs of a word. Sizes are token counts of the
    text. Overlaps of half the size or more are refused. Repeated rows give repeated pieces.
    """
    for profile, size, overlap in profiles:
        if size < 1 or overlap < 0 or 2 * overlap >= size:
            raise ValueError(f"{profile}: overlap {overlap} does not fit pieces of {size}")
    smallest = min((size for _, size, _ in profiles), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = token_counts(folder, name)
        for batch in batches:
            for first, texts, numbers in counts.blocks(batch.column(1), 256):
                keys = batch.column(0).slice(first, len(texts)).to_pylist()
                rows: list[tuple] = []
                for doc, whole, words in zip(keys, texts, numbers, strict=True):
                    total = int(counts.tokens[words].sum())
                    for profile, size, overlap in profiles:
                        if total > size:
                            for no, (a, b, c, d, kind) in enumerate(cut_document(counts, whole, words, size, overlap)):
                                rows.append((doc, profile, no, a, b, c, d, KINDS[kind], whole[c:d]))
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [batch.schema.field(0).type, pa.string(), *[pa.int32()] * 5, pa.string(), pa.string()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc", "profile", "piece_no", "token_start", "token_end", "char_start", "char_end", "boundary", "text"])

    # a token has at least one byte, so shorter texts cannot be oversized
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.octet_length("text") > smallest)
    return spread(rows).mapInArrow(run, SCHEMA.format(df.schema[key].dataType.simpleString())).withColumnRenamed("doc", key)
