"""Definitions, calls and inheritance of source files: a small scanner per language inside Arrow batches, one row a file.

A scanner passes over comments and literals, follows brackets (or indentation in Python) and notes what opens each of
them, so that a definition has its enclosing class and its last line, and a call its nearest enclosing function. What
comes out are arrays of a file; everything else (ids, joins, resolution) is done by Spark on the exploded rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "vue": "javascript", "py": "python", "go": "go", "java": "java", "kt": "kotlin", "kts": "kotlin", "rs": "rust", "php": "php"}

_C_TOKEN = re.compile(
    r"(?P<skip>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\[\s\S])*`?|\d[\w.]*)|(?P<word>[^\W\d][\w$]*|[$][\w$]*)|(?P<sign>=>|[^\s\w])"
)
_REGEX = re.compile(r"/(?![/*])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_PY_SKIP = re.compile(r"#[^\n]*|[rbufRBUF]{0,2}(?:\"\"\"[\s\S]*?(?:\"\"\"|\Z)|'''[\s\S]*?(?:'''|\Z)|\"(?:[^\"\\\n]|\\[\s\S])*\"?|'(?:[^'\\\n]|\\[\s\S])*'?)")
_PY_LINE = re.compile(r"([ \t]*)(?:(?:async[ \t]+)?(def)|(class))[ \t]+(\w+)")
_PY_CALL = re.compile(r"((?:\b\w+\.)*)\b(\w+)[ \t]*\(")
_SCRIPT = re.compile(r"<script[^>]*>([\s\S]*?)</script>", re.I)

# Words that stand before a bracket without being a name, for all languages with braces and for single ones.
_BRACES = frozenset("if for while switch catch return function new await typeof instanceof delete void yield throw else do try case in of super import with".split())
_NO_NAME = {
    "typescript": _BRACES, "javascript": _BRACES, "java": _BRACES | {"synchronized", "assert"}, "go": _BRACES | frozenset("func defer go select chan map range".split()),
    "kotlin": _BRACES | {"when", "fun", "is"}, "rust": _BRACES | {"match", "fn", "loop"}, "php": _BRACES | {"foreach", "elseif", "echo", "array", "isset", "match", "fn"},
    "python": frozenset("if elif for while return and or not in is lambda assert with yield await del raise except import from def class else".split()),
}
#: Words that open a class, and words that open a function, where neither is spelt as in the languages above.
_TYPES = {"kotlin": ("class", "interface", "object"), "rust": ("struct", "enum", "trait", "impl"), "php": ("class", "interface", "trait")}
_FUNCTIONS = {"kotlin": "fun", "rust": "fn", "php": "function"}
_OPENS, _CLOSES = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}


def script_of(text: str) -> str:
    """The script part of a component file, on its own lines; the text itself if it has none."""
    found = _SCRIPT.search(text)
    return "\n" * text.count("\n", 0, found.start(1)) + found.group(1) if found else text


class _Found:
    """What a scanner finds: symbols (kind, name, qualified, exported, first, last), calls (caller, callee, qualified, line), bases (name, base, relation)."""

    def __init__(self) -> None:
        self.symbols: list[list] = []
        self.calls: list[tuple] = []
        self.bases: list[tuple] = []

    def define(self, kind: str, name: str, owner: str | None, exported: bool, line: int) -> list:
        self.symbols.append([kind, name, f"{owner}.{name}" if owner else name, exported, line, line])
        return self.symbols[-1]


def _c_tokens(text: str) -> list[tuple[str, int]]:
    """Words and signs with their lines; literals are one empty word each."""
    out, line, at, pos = [], 1, 0, 0
    while m := _C_TOKEN.search(text, pos):
        start, pos = m.start(), m.end()
        line += text.count("\n", at, start)
        at, value = start, m.group()
        if m.lastgroup == "skip":
            if value[0] not in "/":
                out.append(("", line))
            continue
        if value == "/" and (not out or out[-1][0] in tuple("=(,:[!&|?{;") or out[-1][0] in ("return", "=>")):
            literal = _REGEX.match(text, start)
            if literal:
                out.append(("", line))
                pos = literal.end()
                continue
        out.append((value, line))
    return out


def _pairs(tokens: list[tuple[str, int]]) -> dict[int, int]:
    """Closing token of each opening one; what doesn't match is left out."""
    out, stack = {}, []
    for k, (value, _) in enumerate(tokens):
        if value in _OPENS:
            stack.append(k)
        elif value in _CLOSES:
            while stack and tokens[stack[-1]][0] != _CLOSES[value] and _CLOSES[value] == "{":
                stack.pop()
            if stack and tokens[stack[-1]][0] == _CLOSES[value]:
                out[stack.pop()] = k
    return out


def _body(tokens: list[tuple[str, int]], k: int) -> int | None:
    """The next brace from token k on, before the statement ends."""
    while k < len(tokens) and tokens[k][0] not in (";", "}", "="):
        if tokens[k][0] == "{":
            return k
        k += 1
    return None


def scan_braces(text: str, language: str) -> _Found:
    """Languages with braces."""
    found, tokens = _Found(), _c_tokens(text)
    value = lambda k: tokens[k][0] if 0 <= k < len(tokens) else ""
    closing = _pairs(tokens)
    script, no_name = language in ("typescript", "javascript"), _NO_NAME[language]
    opened: dict[int, tuple[str, str, list | None]] = {}  # brace -> (what, qualified name, symbol)
    stack: list[tuple[int, tuple[str, str, list | None] | None]] = []
    listed: set[str] = set()
    names: set[int] = set()

    def opens(brace: int | None, what: str, name: str, symbol: list | None) -> None:
        if brace is not None:
            opened[brace] = (what, name, symbol)
            if symbol and brace in closing:
                symbol[5] = tokens[closing[brace]][1]

    def exported(k: int, name: str) -> bool:
        head = [value(j) for j in range(max(0, k - 5), k)]
        head = head[max((j + 1 for j, w in enumerate(head) if w in (";", "}", "{", ")")), default=0) :]
        return "export" in head if script else name[:1].isupper() if language == "go" else "private" not in head

    def bases(k: int, name: str) -> None:
        relation, depth = None, 0
        while k < len(tokens) and value(k) not in ("{", ";"):
            w = value(k)
            depth += (w == "<") - (w == ">")
            if depth == 0 and w in ("extends", "implements"):
                relation = w
            elif depth == 0 and relation and w[:1].isalpha() and value(k + 1) != ".":
                found.bases.append((name, w, relation))
            k += 1

    for k, (w, line) in enumerate(tokens):
        if w in ("(", "["):
            stack.append((k, None))
        elif w == "{":
            stack.append((k, opened.get(k)))
        elif w in _CLOSES:
            while stack and closing.get(stack[-1][0], k) != k:
                stack.pop()
            if stack:
                stack.pop()
        if not w or not (w[0].isalpha() or w[0] in "_$") or k in names:
            continue
        inside = stack[-1][1] if stack else None
        top, in_class = not stack, bool(inside and inside[0] == "class")
        after = value(k + 1)
        if language in _TYPES:
            if w in _TYPES[language] and after[:1].isalpha() and (top or in_class):
                symbol = found.define({"struct": "class", "object": "class", "impl": "impl", "trait": "interface"}.get(w, w), after, None, "pub" in (value(k - 1), value(k - 4)) or language != "rust", line)
                names.add(k + 1)
                if w == "impl":
                    found.symbols.pop()
                    if value(k + 2) == "for":
                        found.bases.append((value(k + 3), after, "implements"))
                        after = value(k + 3)
                elif language == "kotlin":
                    head = next((j for j in range(k + 2, min(k + 80, len(tokens))) if value(j) in ("{", ":") and not any(a < j < b for a, b in closing.items() if a >= k)), k)
                    if value(head) == ":":
                        found.bases += [(after, value(j), "extends") for j in range(head + 1, _body(tokens, head) or head + 2) if value(j)[:1].isupper() and value(j - 1) in (":", ",")]
                else:
                    bases(k + 2, after)
                opens(_body(tokens, k + 2), "class", after, symbol)
                continue
            if w == _FUNCTIONS[language] and after[:1].isalpha() and value(k + 2) in ("(", "<") and (top or in_class):
                owner = inside[1] if in_class else None
                symbol = found.define("method" if owner else "function", after, owner, "private" not in (value(k - 1), value(k - 2)) and (language != "rust" or "pub" in (value(k - 1), value(k - 4))), line)
                names.add(k + 1)
                parameters = next((j for j in range(k + 2, min(k + 40, len(tokens))) if value(j) == "("), k + 2)
                opens(_body(tokens, closing.get(parameters, parameters) + 1), "function", symbol[2], symbol)
                continue
        if w in ("class", "interface", "enum") and value(k - 1) != "." and after[:1].isalpha() and (top or in_class or not script):
            if language != "go" and value(k + 2) in ("{", "<", "extends", "implements", "("):
                symbol = found.define(w, after, None, exported(k, after), line)
                names.add(k + 1)
                bases(k + 2, after)
                opens(_body(tokens, k + 2), "class", after, symbol)
        elif language == "go" and top and w == "type" and value(k + 2) in ("struct", "interface"):
            symbol = found.define("class" if value(k + 2) == "struct" else "interface", after, None, exported(k, after), line)
            names.add(k + 1)
            opens(_body(tokens, k + 2), "type", after, symbol)
        elif language == "go" and top and w == "func":
            at, owner = k + 1, None
            if after == "(" and k + 1 in closing:
                at = closing[k + 1] + 1
                receiver = [value(j) for j in range(k + 2, closing[k + 1]) if value(j)[:1].isalpha()]
                owner = receiver[min(1, len(receiver) - 1)] if receiver else None
            name = value(at)
            if name and value(at + 1) in ("(", "["):
                symbol = found.define("method" if owner else "function", name, owner, exported(k, name), line)
                names.add(at)
                parameters = at + 1 if value(at + 1) == "(" else closing.get(at + 1, at) + 1
                end = closing.get(parameters, parameters) + 1
                opens(_body(tokens, closing[end] + 1 if value(end) == "(" and end in closing else end), "function", symbol[2], symbol)
        elif script and top and w == "type" and after[:1].isalpha() and value(k + 2) in ("=", "<"):
            symbol = found.define("type", after, None, exported(k, after), line)
            end = k + 2
            while end < len(tokens) and value(end) != ";" and not (tokens[end][1] > line and value(end) in ("export", "const", "function", "class", "import", "interface", "type", "@")):
                end = closing.get(end, end) + 1
            symbol[5] = tokens[min(end, len(tokens) - 1)][1] if value(end) == ";" else tokens[end - 1][1]
        elif script and w == "function":
            at = k + 2 if after == "*" else k + 1
            name = value(at) if value(at)[:1].isalpha() or value(at)[:1] in ("_", "$") else ""
            symbol = found.define("function", name, None, exported(k, name), line) if name and top else None
            names.add(at)
            parameters = next((j for j in range(at, min(at + 40, len(tokens))) if value(j) == "("), at)
            opens(_body(tokens, closing.get(parameters, parameters) + 1), "function", name or "anonymous", symbol)
        elif script and w in ("const", "let", "var") and (after[:1].isalpha() or after[:1] in ("_", "$")):
            at = k + 2
            while at < min(k + 60, len(tokens)) and value(at) not in ("=", ";", ",", "of", "in"):
                at = closing.get(at, at) + 1
            at += 1 + (value(at + 1) == "async")
            end = closing.get(at, at) + 1
            if value(at) != "function" and value(end) == ":":
                while end < len(tokens) and value(end) not in ("=>", ";", "{", "="):
                    end = closing.get(end, end) + 1
            if value(at - 1) in ("=", "async") and (value(at) == "function" or value(end) == "=>"):
                symbol = found.define("const", after, None, exported(k, after), line) if top else None
                if value(at) != "function":
                    opens(end + 1 if value(end + 1) == "{" else None, "function", after, symbol)
                    if symbol and value(end + 1) != "{":
                        symbol[5] = tokens[min(end + 1, len(tokens) - 1)][1]
                else:
                    parameters = next((j for j in range(at, min(at + 40, len(tokens))) if value(j) == "("), at)
                    opens(_body(tokens, closing.get(parameters, parameters) + 1), "function", after, symbol)
                    names.add(at)
        elif script and top and w in ("export", "exports"):
            brace = next((j for j in range(k + 1, min(k + 4, len(tokens))) if value(j) == "{"), None)
            if brace in closing and value(brace - 1) in ("export", "=", "default"):
                listed.update(value(j) for j in range(brace, closing[brace]))
        elif in_class and language != "go" and w not in no_name and value(k - 1) not in (".", "@", "=", "new", ":", "|", "&") and (after == "(" or after == "<" and script):
            at = k + 1
            if after == "<":
                at = next((j for j in range(k + 2, min(k + 40, len(tokens))) if value(j) in ("(", "=", ";", "{")), k + 1)
            if value(at) != "(":
                continue
            end = closing.get(at, at) + 1
            if value(end) in ("{", ":", "throws", ";") and (value(end) != ";" or language == "java" or script):
                owner = inside[1]
                kind = "constructor" if w == "constructor" or language == "java" and w == owner else "method"
                symbol = found.define(kind, w, owner, not script and exported(k, w), line)
                names.add(k)
                opens(_body(tokens, end), "function", symbol[2], symbol)
        elif after == "(" and w not in no_name and value(k - 1) not in ("new", "function", "@", "func"):
            caller = next((s[1] for _, s in reversed(stack) if s and s[0] == "function"), None)
            if caller:
                owner = value(k - 2) if value(k - 1) == "." else None
                enclosing = next((s[1] for _, s in reversed(stack) if s and s[0] == "class"), None)
                owner = enclosing if owner == "this" and enclosing else owner
                found.calls.append((caller, w, f"{owner}.{w}" if owner else w, line))
    for symbol in found.symbols:
        symbol[3] = symbol[3] or symbol[1] in listed
    return found


def scan_python(text: str) -> _Found:
    """Python, by indentation."""
    found = _Found()
    plain = _PY_SKIP.sub(lambda m: '""' * (m.group()[0] != "#") + "\n" * m.group().count("\n"), text)
    stack: list[tuple[int, str, str, list | None]] = []  # indent, what, qualified name, symbol
    depth, last, header = 0, 0, ""
    for number, line in enumerate(plain.split("\n"), 1):
        if not line.strip():
            continue
        if depth == 0:
            indent = len(line[: len(line) - len(line.lstrip())].expandtabs(8))
            while stack and stack[-1][0] >= indent:
                *_, symbol = stack.pop()
                if symbol:
                    symbol[5] = last
            m = _PY_LINE.match(line)
            if m:
                name, kind = m.group(4), "class" if m.group(3) else "function"
                owner = stack[-1] if stack else None
                symbol = None
                if kind == "class" and not owner:
                    symbol = found.define("class", name, None, not name.startswith("_"), number)
                elif kind == "function" and (not owner or owner[1] == "class"):
                    symbol = found.define("method" if owner else "function", name, owner[2] if owner else None, not name.startswith("_"), number)
                qualified = f"{owner[2]}.{name}" if owner and owner[1] == "class" else name
                stack.append((indent, kind, qualified, symbol))
                header = name if kind == "class" else ""
        calls = line
        if depth == 0 and (m := _PY_LINE.match(line)):
            calls = line[m.end() :]
            if header and "(" in calls[:3]:
                inner = calls[calls.index("(") + 1 :].split(")")[0]
                found.bases += [(header, b.strip().split(".")[-1], "extends") for b in inner.split(",") if re.fullmatch(r"[\w.]+", b.strip())]
        caller = next((s[2] for s in reversed(stack) if s[1] == "function"), None)
        for m in _PY_CALL.finditer(calls) if caller else ():
            if m.group(2) not in _NO_NAME["python"]:
                owner = m.group(1).rstrip(".").split(".")[-1]
                enclosing = next((s[2] for s in reversed(stack) if s[1] == "class"), None)
                owner = enclosing if owner in ("self", "cls") and enclosing and m.group(1).count(".") == 1 else owner
                found.calls.append((caller, m.group(2), f"{owner}.{m.group(2)}" if owner else m.group(2), number))
        depth = max(0, depth + sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}"))
        last = number
    for *_, symbol in stack:
        if symbol:
            symbol[5] = last
    return found


def scan(path: str, text: str) -> _Found:
    """Structure of a file by the extension of its path; nothing for other languages."""
    language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    text = text.replace("\r\n", "\n").removeprefix("﻿")
    if language is None or "\0" in text:
        return _Found()
    if path.lower().endswith(".vue"):
        text = script_of(text)
    return scan_python(text) if language == "python" else scan_braces(text, language)


_SYMBOL = pa.struct([("kind", pa.string()), ("name", pa.string()), ("qualified", pa.string()), ("exported", pa.bool_()), ("first", pa.int32()), ("last", pa.int32())])
_CALL = pa.struct([("caller", pa.string()), ("callee", pa.string()), ("qualified", pa.string()), ("line", pa.int32())])
_BASE = pa.struct([("name", pa.string()), ("base", pa.string()), ("relation", pa.string())])
_SCHEMA = (
    "file_id string, file_path string, symbols array<struct<kind:string,name:string,qualified:string,exported:boolean,first:int,last:int>>,"
    " calls array<struct<caller:string,callee:string,qualified:string,line:int>>, bases array<struct<name:string,base:string,relation:string>>"
)


def structure(files: DataFrame) -> DataFrame:
    """(file_id, file_path, symbols, calls, bases) of each file with file_path and text.

    Null paths and texts, other languages, and texts with a NUL give empty arrays. Damaged files give what was found up
    to the damage and behind it; lines count from 1. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(p or "", t or "") for p, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            rows = lambda part, kind: pa.array([[dict(zip((f.name for f in kind), row, strict=True)) for row in getattr(f, part)] for f in found], pa.list_(kind))
            yield pa.record_batch([batch.column(0), batch.column(1), rows("symbols", _SYMBOL), rows("calls", _CALL), rows("bases", _BASE)], names=["file_id", "file_path", "symbols", "calls", "bases"])

    known = F.lower(F.substring_index("file_path", ".", -1)).isin(*LANGUAGES)
    return files.where(known).select("file_id", "file_path", "text").mapInArrow(run, _SCHEMA)


def definitions(found: DataFrame) -> DataFrame:
    """(file_id, file_path, kind, name, qualified, exported, first, last): one row per definition, those of one name and kind once per file."""
    rows = found.select("file_id", "file_path", F.explode("symbols").alias("s")).select("file_id", "file_path", "s.*")
    return rows.dropDuplicates(["file_id", "kind", "qualified", "first"])
