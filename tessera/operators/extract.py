"""Tables from source text: imports, symbols, overlapping windows, stand-in vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import language_of

#: Patterns of import targets by language; the first group is the target (fixed values).
IMPORTS = {
    "typescript": (r"(?m)^\s*(?:import|export)\b[^'\";]*?\bfrom\s+['\"]([^'\"\n]+)['\"]", r"\brequire\(['\"]([^'\"\n]+)['\"]\)"),
    "javascript": (r"(?m)^\s*(?:import|export)\b[^'\";]*?\bfrom\s+['\"]([^'\"\n]+)['\"]", r"\brequire\(['\"]([^'\"\n]+)['\"]\)"),
    "python": (r"(?m)^from\s+(\.*[\w.]*)\s+import\b", r"(?m)^import\s+([\w.]+)"),
    "go": (r"(?m)^\t\"([\w./-]+)\"\r?$", r"(?m)^import\s+\"([\w./-]+)\""),
    "java": (r"(?m)^import\s+(?:static\s+)?([\w.]+(?:\.\*)?);",),
}
#: Patterns of definitions by language: (kind, pattern whose first group is the name).
SYMBOLS = {
    "typescript": (("class", r"(?m)^(?:export\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"(?m)^(?:export\s+)?interface\s+(\w+)"), ("function", r"(?m)^(?:export\s+)?(?:async\s+)?function\s+(\w+)"), ("type", r"(?m)^(?:export\s+)?type\s+(\w+)")),
    "javascript": (("class", r"(?m)^(?:export\s+)?class\s+(\w+)"), ("function", r"(?m)^(?:export\s+)?(?:async\s+)?function\s+(\w+)")),
    "python": (("class", r"(?m)^class\s+(\w+)"), ("function", r"(?m)^(?:async\s+)?def\s+(\w+)")),
    "go": (("function", r"(?m)^func\s+(\w+)"), ("class", r"(?m)^type\s+(\w+)\s+struct"), ("method", r"(?m)^func\s+\([^)\n]*\)\s+(\w+)")),
    "java": (("class", r"(?m)^(?:public\s+|final\s+|abstract\s+)*class\s+(\w+)"), ("interface", r"(?m)^(?:public\s+)?interface\s+(\w+)")),
}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def imports_of(files: DataFrame) -> DataFrame:
    """(file_id, target): distinct import targets of each file, as written; files in other languages have none.

    Built-in functions only. Comments and strings that look like imports at the beginning of a line count as well.
    """
    language, found = language_of(F.col("file_path")), F.array().cast("array<string>")
    for name, patterns in IMPORTS.items():
        every = F.concat(*[_all(F.col("text"), p) for p in patterns]) if len(patterns) > 1 else _all(F.col("text"), patterns[0])
        found = F.when(language == name, every).otherwise(found)
    return files.select("file_id", F.explode(F.array_distinct(found)).alias("target"))


def symbols_of(files: DataFrame) -> DataFrame:
    """(file_id, kind, name): distinct top-level definitions of each file."""
    language, found = language_of(F.col("file_path")), F.array().cast("array<struct<kind: string, name: string>>")
    for name, patterns in SYMBOLS.items():
        parts = [F.transform(_all(F.col("text"), p), _named(kind)) for kind, p in patterns]
        found = F.when(language == name, F.concat(*parts)).otherwise(found)
    return files.select("file_id", F.explode(F.array_distinct(found)).alias("s")).select("file_id", "s.kind", "s.name")


def _named(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))


def line_windows(text: str, target: int, overlap: int) -> list[tuple[int, int]]:
    """(first, last) lines of windows of about ``target`` characters, each beginning ``overlap`` characters before the end of the last.

    A window ends early at a blank line beyond 60 % of the target, and never inside a line.
    """
    lines = text.split("\n")
    out, first = [], 0
    while first < len(lines):
        size, last, blank = 0, first, -1
        while last < len(lines) and (size + len(lines[last]) + 1 <= target or last == first):
            size += len(lines[last]) + 1
            if last > first and not lines[last].strip() and size >= 0.6 * target:
                blank = last
                break
            last += 1
        end = blank if blank > first else last - 1
        if out and end <= out[-1][1]:  # the overlap alone fills the window
            first = out[-1][1] + 1
            continue
        out.append((first, end))
        if end >= len(lines) - 1:
            break
        back, begin = 0, end + 1
        while begin - 1 > first and back + len(lines[begin - 1]) + 1 <= overlap:
            begin -= 1
            back += len(lines[begin]) + 1
        first = begin
    return out


def windows(files: DataFrame, target: int = 2000, overlap: int = 200) -> DataFrame:
    """(file_id, window_no, line_start, line_end, content): overlapping windows of each file; blank texts and texts with NUL have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, file_id in enumerate(batch.column(0).to_pylist()):
                text = batch.column(1)[k].as_py() or ""
                if text.strip() and "\0" not in text:
                    lines = text.split("\n")
                    rows += [(file_id, no, a + 1, b + 1, "\n".join(lines[a : b + 1])) for no, (a, b) in enumerate(line_windows(text, target, overlap))]
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = [batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file_id", "window_no", "line_start", "line_end", "content"])

    return files.select("file_id", "text").mapInArrow(run, "file_id string, window_no int, line_start int, line_end int, content string")


def stand_in_vector(text: Column, width: int = 64) -> Column:
    """A deterministic vector for tests without a model: bytes of SHA-256 over text and counter, scaled to -1..1; null for null."""
    blocks = F.concat(*[F.sha2(F.concat(text, F.lit(f":{k}")), 256) for k in range(-(-width // 32))])
    digits = F.slice(F.regexp_extract_all(blocks, F.lit("(..)"), F.lit(1)), 1, width)
    return F.transform(digits, lambda d: F.conv(d, 16, 10).cast("double") / 127.5 - 1)
