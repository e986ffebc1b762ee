"""Texts as sequences of pre-tokenizer words, each distinct word handled once per worker.

A byte-level tokenizer cuts a text into words (letters, digits, signs, white space) and never merges across them. A
text is therefore cut cheaply into runs of white space plus following characters, each distinct run is cut into words
once, and documents become arrays of word numbers. What belongs to a word (ids, number of tokens, kind of boundary)
is kept in arrays by word number, so that per-document work is array look-ups.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

#: Where the public vocabulary files lie; every operator takes it as a parameter.
TOKENIZERS = "/opt/tokenizers"

# The characters with the Unicode property White_Space, and the word pattern of the public byte-level vocabularies.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

_RUN = re.compile(rf"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
_WORD = regex.compile(WORD_PATTERN)

#: Longer runs are cut anew each time instead of being remembered.
MAX_KEPT_RUN = 96


def read_ranks(folder: str, name: str) -> dict[bytes, int]:
    """Token bytes to id of a .tiktoken vocabulary file."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class WordBook:
    """Distinct words seen by one worker, numbered in order of appearance; full beyond ``limit`` words or ``most`` characters."""

    def __init__(self, limit: int = 400_000, most: int = 40_000_000):
        self.limit, self.most = limit, most
        self.clear()

    def clear(self) -> None:
        self.words: list[str] = []
        self.number: dict[str, int] = {}
        self.runs: dict[str, tuple[int, ...]] = {}
        self.chars = 0

    def full(self) -> bool:
        return len(self.words) > self.limit or len(self.runs) > 2 * self.limit or self.chars > self.most

    def _cut(self, run: str) -> tuple[int, ...]:
        number, words = self.number, self.words
        found = []
        for word in _WORD.findall(run):
            k = number.get(word)
            if k is None:
                k = number[word] = len(words)
                words.append(word)
                self.chars += len(word)
            found.append(k)
        return tuple(found)

    def numbers(self, text: str) -> np.ndarray:
        """The words of ``text`` as numbers; an empty text gives an empty array."""
        runs = _RUN.findall(text)
        known = self.runs
        for run in set(runs).difference(known):
            if len(run) <= MAX_KEPT_RUN:
                known[run] = self._cut(run)
        try:
            parts = [known[run] for run in runs]
        except KeyError:
            parts = [known.get(run) or self._cut(run) for run in runs]
        return np.fromiter(chain.from_iterable(parts), dtype=np.int32)


class TokenCounts:
    """Word numbers with the number of tokens, and what problems 8 and 9 ask of a word; one per Python worker."""

    def __init__(self, folder: str, name: str):
        import tiktoken

        self.encoding = tiktoken.Encoding(name, pat_str=WORD_PATTERN, mergeable_ranks=read_ranks(folder, name), special_tokens={})
        self.book = WordBook()
        self.forget()

    def forget(self) -> None:
        self.book.clear()
        self.tokens = np.zeros(0, dtype=np.int64)
        self.extra: dict[str, np.ndarray] = {}

    def numbers(self, text: str | None) -> np.ndarray:
        return self.book.numbers(text) if text else np.zeros(0, dtype=np.int32)

    def blocks(self, column: pa.Array, most: int) -> Iterator[tuple[int, list[str | None], list[np.ndarray]]]:
        """(row, texts, their words as numbers) of blocks of at most ``most`` texts that begin at a row; their tokens are counted.

        A block ends where the book is full, and the book is cleared between blocks only: numbers hold within their block.
        """
        for row in range(0, len(column), most):
            texts, first, found = column.slice(row, most).to_pylist(), 0, []
            for k, text in enumerate(texts, 1):
                if not found and self.book.full():
                    self.forget()
                found.append(self.numbers(text))
                if k == len(texts) or self.book.full():
                    self.learn()
                    yield row + first, texts[first:k], found
                    first, found = k, []

    def learn(self) -> None:
        """Count the tokens of words not counted yet."""
        new = self.book.words[len(self.tokens) :]
        if new:
            counts = [len(self.encoding.encode_ordinary(w)) for w in new]
            self.tokens = np.concatenate([self.tokens, np.array(counts, dtype=np.int64)])

    def per_word(self, name: str, function, dtype) -> np.ndarray:
        """function(word) for every known word, kept under ``name``."""
        known = self.extra.get(name, np.zeros(0, dtype=dtype))
        new = self.book.words[len(known) :]
        if new:
            known = np.concatenate([known, np.array([function(w) for w in new], dtype=dtype)])
            self.extra[name] = known
        return known


_COUNTS: dict[tuple[str, str], TokenCounts] = {}


def token_counts(folder: str, name: str) -> TokenCounts:
    """The worker's counter; kept between tasks of one Python worker."""
    if (folder, name) not in _COUNTS:
        _COUNTS[folder, name] = TokenCounts(folder, name)
    return _COUNTS[folder, name]
