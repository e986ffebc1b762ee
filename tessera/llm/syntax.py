"""Source files that do not parse (problem 5).

Method: a lexer per language feeds a pushdown stack. The lexer finds unterminated literals, illegal characters and
merge-conflict markers (outside strings and comments); the stack finds unbalanced delimiters and premature ends, and
remembers in each frame what a colon may mean there. Rules on neighbouring tokens find text of another language and
cuts in the middle; for Python, rules on logical lines and a stack of indents find missing blocks and colons. JSON needs
no more. Python files that pass are held against the parser Python brings along as well.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Language by extension: what a file's text is held against.
EXTENSIONS = {"ts": "typescript", "js": "javascript", "mjs": "javascript", "py": "python", "go": "go", "java": "java", "json": "json"}

_CLOSES = {")": "(", "]": "[", "}": "{"}
_MARKER = re.compile(r"(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|$)")


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_NAME = r"[^\W\d][\w$]*"


def _lexer(strings: str, words: str, suffix: str, signs: str, extra: str = "") -> re.Pattern:
    return re.compile(
        rf"[ \t\r\f\x0b\xa0﻿]*(?:(?P<line>\n)|(?P<note>//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<open>/\*)|{extra}{strings}"
        rf"|(?P<num>(?<![\w$]){_NUMBER}{suffix})|(?P<word>{words})|(?P<sign>{signs})|(?P<end>\Z)|(?P<bad>.))"
    )


_TEXT = r"(?P<text>\"(?:[^\"\\\n]|\\[\s\S])*+\"|'(?:[^'\\\n]|\\[\s\S])*+')"
_C_SIGNS = r">>>=|>>>|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|->|::|:=|<-|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&\^=|&\^|&=|\|=|\^=|<<|\*\*|[-+*/%&|^!~<>=?:;,.()\[\]{}@]"

LEXERS = {
    "javascript": _lexer(_TEXT, rf"[#]?(?:[$]|{_NAME})[\w$]*", "n?", _C_SIGNS, r"(?P<tick>`)|"),
    "java": _lexer(r"(?P<text>\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)[^'\n]{0,5}')", rf"(?:[$]|{_NAME})[\w$]*", "[lLfFdD]?", _C_SIGNS),
    "go": _lexer(r"(?P<text>\"(?:[^\"\\\n]|\\.)*+\"|`[^`]*`|'(?:[^'\\\n]|\\.)[^'\n]{0,8}')", _NAME, "i?", _C_SIGNS),
}
LEXERS["typescript"] = LEXERS["javascript"]
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*+(`|\$\{|\Z)")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/[a-z]*")

# Reserved words of each language that may stand before an operand, and words that act as operators.
_JS_RESERVED = _words(
    "await break case catch class const continue debugger default delete do else export extends finally for function if import in"
    " instanceof let new return super switch this throw try typeof var void while with yield async static get set of from as"
)
_TS_RESERVED = _JS_RESERVED | _words(
    "abstract accessor any asserts declare enum global implements infer interface is keyof module namespace out override private protected"
    " public readonly require satisfies type unique never unknown"
)
_JAVA_RESERVED = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float"
    " for goto if implements import instanceof int interface long native new non-sealed package permits private protected public record return"
    " sealed short static strictfp super switch synchronized this throw throws transient try var void volatile while yield when"
)
_GO_RESERVED = _words(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return"
    " select struct switch type var"
)
RESERVED = {"javascript": _JS_RESERVED, "typescript": _TS_RESERVED, "java": _JAVA_RESERVED, "go": _GO_RESERVED}
_INFIX = {
    "javascript": _words("in instanceof of as from with"),
    "typescript": _words("in instanceof of as from with is satisfies extends implements"),
    "java": _words("instanceof throws implements extends permits when"),
    "go": frozenset(),
}
_VALUES = _words("this super true false null undefined nil")
# What may begin a declaration outside all brackets.
_TOP = {
    "java": _words("package import public private protected static final abstract class interface enum record sealed strictfp @ ; non module open"),
    "go": _words("package import func var const type ;"),
}
_BINARY = _words("/ % == != === !== <= >= && || += -= *= /= %= = ?? ** << >>> ?.")
_GO_BLANK = _words("break continue fallthrough return ++ -- ) ] }")


class _Fault(Exception):
    def __init__(self, kind: str, at: int):
        self.kind, self.at = kind, at


def _curly(text: str, language: str) -> None:
    """Raise _Fault at the first fault of a text in a language of the C family."""
    lexer, reserved, infix = LEXERS[language], RESERVED[language], _INFIX[language]
    script, java, go = language in ("javascript", "typescript"), language == "java", language == "go"
    plain, typed = language == "javascript", language == "typescript"
    top = _TOP.get(language)
    stack: list[list] = []  # [bracket, place, open ternaries, open cases, what stands before it]
    frame = ["", 0, 0, 0, ""]
    kind, last, before, fresh = "", "", "", True  # kind: of the last token; fresh: a line has ended since
    begins = True  # at the beginning of a declaration outside brackets
    run = 0  # names in a row
    called = ""  # what stood before the bracket just closed
    constant, asserts = False, False  # behind const, behind assert
    first = True  # whether the last operand is the first of its line
    pos, size = 0, len(text)
    match = lexer.match
    while True:
        m = match(text, pos)
        what, start, pos = m.lastgroup, m.start(m.lastgroup), m.end()
        if what == "line":
            if go and not stack and (kind in ("word", "num", "text") or last in _GO_BLANK):
                begins = True
            fresh = True
            if text[pos : pos + 1] in ("<", "=", ">", "|") and _MARKER.match(text, pos):
                raise _Fault("merge conflict marker", pos)
            continue
        if what == "note":
            fresh = fresh or "\n" in m.group("note")
            continue
        if what == "end":
            if stack:
                raise _Fault("premature end", frame[1])
            if script and last in _BINARY or java and not begins and kind:
                raise _Fault("premature end", size)
            return
        if what == "open":
            raise _Fault("unterminated comment", start)
        if what == "bad":
            raise _Fault("unterminated literal" if text[start] in "\"'`" else "illegal character", start)
        token = m.group(what)
        value = kind in ("num", "text") or kind == "word" and (last not in reserved or last in _VALUES)
        if top and not stack and begins:
            if token not in top:
                raise _Fault("not a declaration", start)
            if go and not kind and token != "package":
                raise _Fault("no package clause", start)
        if begins and not stack:
            begins = False
        same = java or not fresh
        if what == "tick":
            what = "text"
            if value and kind != "word" and same:
                raise _Fault("operator missing", start)
            t = _TEMPLATE.match(text, pos)
            pos = t.end()
            if not t.group(1):
                raise _Fault("unterminated literal", start)
            if t.group(1) == "${":
                stack.append(frame)
                frame = ["`", start, 0, 0, ""]
                kind, before, last, fresh, run = "sign", last, "${", False, 0
                continue
        if what == "sign":
            run = run if token == "." else 0
            if token == "/" or token == "/=":
                if script and not (value or last in (")", "]", "}")):
                    r = _REGEX.match(text, start)
                    if not r:
                        raise _Fault("unterminated literal", start)
                    pos, what, token = r.end(), "text", "/re/"
            if what == "sign":
                if token in "([{":
                    if java and token == "{" and kind == "num":
                        raise _Fault("operator missing", start)
                    stack.append(frame)
                    frame = [token, start, 0, 0, last if kind == "word" and before not in ("@", "new") else "" if kind else "^"]
                elif token in ")]}":
                    if kind == "sign" and (last in _BINARY and not (typed and last in ("=", "?.")) or last == "." and not go):
                        raise _Fault("operand missing", start)
                    if token == "}" and frame[0] == "`":
                        frame = stack.pop()
                        t = _TEMPLATE.match(text, pos)
                        pos = t.end()
                        if not t.group(1):
                            raise _Fault("unterminated literal", start)
                        if t.group(1) == "${":
                            stack.append(frame)
                            frame = ["`", start, 0, 0, ""]
                            token = "${"
                            kind, before, last, fresh, run = "sign", last, token, False, 0
                            continue
                        kind, before, last, fresh, run = "text", last, "``", False, 0
                        continue
                    if frame[0] != _CLOSES[token]:
                        raise _Fault("unbalanced delimiter", start)
                    if frame[2] and not typed and not java:
                        raise _Fault("ternary without colon", start)
                    called = frame[4] if token == ")" else ""
                    frame = stack.pop()
                    if not stack and token == "}" and java:
                        begins = True
                elif token == ";":
                    if last in _BINARY and kind == "sign":
                        raise _Fault("operand missing", start)
                    if frame[0] == "[":
                        raise _Fault("unbalanced delimiter", start)
                    if not stack:
                        begins = True
                    frame[2] = 0
                elif token == "?":
                    if go:
                        raise _Fault("illegal character", start)
                    frame[2] += 1
                elif token == ":":
                    if script and frame[4] == "^" and kind != "word":
                        raise _Fault("colon out of place", start)
                    if frame[2]:
                        frame[2] -= 1
                    elif frame[3]:
                        frame[3] -= 1
                    elif plain:
                        if frame[0] != "{" and frame[0] != "" or not (kind in ("word", "num", "text") or last == "]"):
                            raise _Fault("colon out of place", start)
                        if frame[0] == "" and not (kind == "word" and (before in ("", ";", "}") or begins)):
                            raise _Fault("colon out of place", start)
                        if frame[0] == "{" and last != "]" and before not in ("{", ",", ";", "}", ")") and not first:
                            raise _Fault("colon out of place", start)
                    elif java:
                        label = kind == "word" and before in (";", "{", "}", ":", ")")
                        if not (frame[0] == "(" and frame[4] == "for" or label or asserts):
                            raise _Fault("colon out of place", start)
                        asserts = False
                    elif go and (frame[0] == "(" or not stack):
                        raise _Fault("colon out of place", start)
                elif token == "@":
                    if plain or go or last == "@":
                        raise _Fault("illegal character", start)
                elif token in _BINARY:
                    if kind == "sign" and (last in _BINARY or last in ("(", "[", ",", ";", "{") and token not in ("<<", "<", "=")) or not kind:
                        if not (go and token == "="):
                            raise _Fault("operand missing", start)
                elif token in ("`", "'", '"'):
                    raise _Fault("unterminated literal", start)
                elif not go and token == ":=" or token == "<-" and java:
                    raise _Fault("illegal character", start)
                if token == "," and kind == "sign" and (last in _BINARY or last == "."):
                    raise _Fault("operand missing", start)
                kind, before, last, fresh = "sign", last, token, False
                continue
        # an operand or a reserved word
        first = fresh
        if what == "word":
            free = token not in reserved
            if kind == "num" and same and token not in infix or kind == "text" and same and token not in infix and not (go and last[:1] == "`"):
                if not (script and last == "/re/" and fresh):
                    raise _Fault("operator missing", start)
            if script and not fresh and free and value and last not in reserved and token not in infix:
                raise _Fault("operator missing", start)
            if script and not fresh and free and last == "]" and plain and token not in infix:
                raise _Fault("operator missing", start)
            if script and not fresh and last == ")" and called and called not in reserved and free and token not in infix:
                raise _Fault("operator missing", start)
            if java and last == ")" and called and called not in reserved and token not in infix and token != "default":
                raise _Fault("operator missing", start)
            run = run + 1 if free and kind == "word" and last not in reserved and (java or not fresh) else int(free)
            if (java or go) and run > 2:
                raise _Fault("operator missing", start)
            if token in ("case", "default") and not (token == "default" and (last in ("export", "as", "{", ",", ".") and script or java and last != "{" and last != ";" and last != "}" and last != ":")):
                frame[3] += 1
                if java:
                    frame[3] = 1
            elif plain and token in ("export", "import") and stack and last != ".":
                if text[pos : pos + 1] not in (":", "(", ",", "}", "."):
                    raise _Fault("declaration out of place", start)
            if plain and token == "const":
                constant = True
            elif plain and constant and last == "const" and not text[pos : pos + 40].lstrip().startswith(("=", "of ", "in ")):
                raise _Fault("no initial value", start)
            else:
                constant = False
            asserts = java and (token == "assert" or asserts and last != ";")
            if java and frame[3] and last == "->":
                frame[3] = 0
        else:
            if value and same and not (go and what == "text") and not (script and last == "]"):
                if not (kind == "word" and script and token == "/re/"):
                    raise _Fault("operator missing", start)
            if not java and kind == "text" and what == "num" and not fresh:
                raise _Fault("operator missing", start)
            if last == ")" and called and called not in reserved and what != "text" and same and not go:
                raise _Fault("operator missing", start)
            run = 0
        if frame[3] and last == "->":
            frame[3] = 0
        kind, before, last, fresh = what, last, token if what != "text" else token[:1] + token[:2], False


_PY = re.compile(
    r"(?P<note>#[^\n]*)|(?P<text>(?i:[rbuft]{0,2})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*+\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*+'))"
    r"|(?P<bad>[\"'$?`!](?!=))|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<line>\n)|(?P<rest>[^#\"'()\[\]{}\n$?`!]+|!=)"
)


# Words of Python that are no operands, words that open a block, and signs that no statement begins with.
_PY_WORDS = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type print exec _")
_PY_OPENERS = _words("if elif else for while try except finally with def class")
_PY_NO_START = re.compile(r"(?://|@@|[%/=<>|&^,;:.)\]}](?!\.\.))")
_PY_ADJACENT = re.compile(r"(?<![\w.])([^\W\d]\w*)[ \t]+(?=([^\W\d]\w*))")
_PY_NUMBERED = re.compile(r"[-+]?\d[\w.]*[ \t]*(?::(?!=)|[^\W\d])")


def _statements(text: str) -> None:
    """Rules of Python's logical lines, with a stack of indents: blocks where they are due, no signs or words that cannot stand side by side."""
    indents, due, depth, joined = [0], False, 0, False
    plain = _PY.sub(lambda m: m.group() if m.lastgroup != "text" and m.lastgroup != "note" else '""' * (m.lastgroup == "text") + "\\\n" * m.group().count("\n"), text)
    at, header = 0, ""
    for line in plain.split("\n"):
        body = line.strip(" \t\r\f")
        if body and not joined and depth == 0:
            indent = len(line[: len(line) - len(line.lstrip(" \t\f"))].expandtabs(8))
            if due and indent <= indents[-1]:
                raise _Fault("missing block", at)
            if not due and indent > indents[-1]:
                raise _Fault("unexpected indent", at)
            if due:
                indents.append(indent)
            while indent < indents[-1]:
                indents.pop()
            if indent != indents[-1]:
                raise _Fault("unmatched dedent", at)
            if _PY_NO_START.match(body) or _PY_NUMBERED.match(body):
                raise _Fault("invalid statement", at)
            due, header = False, ""
            words = re.match(r"(?:async[ \t]+)?([^\W\d]\w*)", body)
            if words and words.group(1) in _PY_OPENERS:
                header = words.group(1)
        for m in _PY_ADJACENT.finditer(body):
            if m.group(1) not in _PY_WORDS and m.group(2) not in _PY_WORDS:
                raise _Fault("operator missing", at)
        if not body.isascii() and any(not (c.isascii() or c.isidentifier() or ("a" + c).isidentifier()) for c in body):
            raise _Fault("illegal character", at)
        joined = body.endswith("\\")
        depth = max(0, depth + sum(body.count(c) for c in "([{") - sum(body.count(c) for c in ")]}"))
        if body and depth == 0 and not joined:
            if body.endswith(":"):
                due = True
            elif header and not body.startswith((")", "]", "}")):
                flat, before = body, ""
                while flat != before:
                    flat, before = re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "", flat), flat
                if ":" not in flat:
                    raise _Fault("missing colon", at)
            header = header if joined or depth else ""
        at += len(line) + 1
    if due:
        raise _Fault("premature end", len(text))


def _python(text: str) -> None:
    stack: list[tuple[str, int]] = []
    if _MARKER.match(text):
        raise _Fault("merge conflict marker", 0)
    for m in _PY.finditer(text):
        what = m.lastgroup
        if what == "open":
            stack.append((m.group(), m.start()))
        elif what == "close":
            if not stack or stack.pop()[0] != _CLOSES[m.group()]:
                raise _Fault("unbalanced delimiter", m.start())
        elif what == "bad":
            raise _Fault("unterminated literal" if m.group() in "\"'" else "illegal character", m.start())
        elif what == "line" and text[m.end() : m.end() + 1] in ("<", "=", ">", "|") and _MARKER.match(text, m.end()):
            raise _Fault("merge conflict marker", m.end())
    if stack:
        raise _Fault("premature end", stack[-1][1])
    _statements(text)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
    except SyntaxError as fault:
        lines = text.split("\n")
        raise _Fault("invalid statement", sum(len(x) + 1 for x in lines[: max(0, (fault.lineno or 1) - 1)])) from None
    except (ValueError, RecursionError, MemoryError):
        raise _Fault("invalid statement", 0) from None


_JSON = re.compile(
    r'[ \t\r\n]*(?:(?P<text>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*+")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))'
    r"|(?P<name>true|false|null)\b|(?P<sign>[\[\]{}:,])|(?P<end>\Z)|(?P<bad>.))"
)


def _json(text: str) -> None:
    stack: list[tuple[str, int]] = []
    state, pos = "value", 0  # value, first (value or end), key, firstkey, colon, after
    while True:
        m = _JSON.match(text, pos)
        what, start, pos = m.lastgroup, m.start(m.lastgroup), m.end()
        if what == "bad":
            if _MARKER.match(text, start):
                raise _Fault("merge conflict marker", start)
            raise _Fault("unterminated literal" if text[start] == '"' else "illegal character", start)
        if what == "end":
            if stack or state != "after":
                raise _Fault("premature end", start)
            return
        token = m.group(what)
        if what in ("text", "num", "name"):
            if state in ("value", "first"):
                state = "after"
            elif state in ("key", "firstkey") and what == "text":
                state = "colon"
            else:
                raise _Fault("delimiter missing", start)
        elif token in "[{":
            if state not in ("value", "first"):
                raise _Fault("delimiter missing", start)
            stack.append((token, start))
            state = "first" if token == "[" else "firstkey"
        elif token in "]}":
            if not stack or stack[-1][0] != _CLOSES[token] or state not in ("after", "first" if token == "]" else "firstkey"):
                raise _Fault("unbalanced delimiter", start)
            stack.pop()
            state = "after"
        elif token == ":" and state == "colon":
            state = "value"
        elif token == "," and state == "after" and stack:
            state = "value" if stack[-1][0] == "[" else "key"
        else:
            raise _Fault("delimiter missing", start)


def fault_of(path: str | None, text: str | None) -> tuple[str, int] | None:
    """(kind, line) of the first fault; None if the text is valid or the extension is none of EXTENSIONS.

    A byte-order mark and CR LF are no faults; an empty or comment-only source file is valid, an empty JSON file is not.
    """
    language = EXTENSIONS.get((path or "").rpartition(".")[2])
    if language is None:
        return None
    text = (text or "").removeprefix("﻿")
    try:
        if language == "python":
            _python(text)
        elif language == "json":
            _json(text)
        else:
            if _MARKER.match(text):
                raise _Fault("merge conflict marker", 0)
            if text.startswith("#!"):
                text = "//" + text[2:]
            _curly(text, language)
    except _Fault as fault:
        return fault.kind, text.count("\n", 0, fault.at) + 1
    return None


def parse_faults(files: DataFrame) -> DataFrame:
    """Adds valid (boolean), fault (string) and fault_line to files with file_path and text; text is dropped.

    Files whose extension names no language here get valid = null. A null text counts as empty, a null path as none.
    All other columns are kept; none may be named fault, fault_line or valid.
    """
    keep = [c for c in files.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts = batch.column("file_path").to_pylist(), batch.column("text")
            found, known = [], []
            for k, path in enumerate(paths):
                known.append((path or "").rpartition(".")[2] in EXTENSIONS)
                found.append(fault_of(path, texts[k].as_py()) if known[-1] else None)
            columns = [batch.column(c) for c in keep] + [
                pa.array([(f is None) if k else None for f, k in zip(found, known, strict=True)], pa.bool_()),
                pa.array([f and f[0] for f in found], pa.string()),
                pa.array([f and f[1] for f in found], pa.int32()),
            ]
            yield pa.record_batch(columns, names=[*keep, "valid", "fault", "fault_line"])

    kinds = ", ".join(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep)
    return files.select(*keep, "text").mapInArrow(run, f"{kinds}, valid boolean, fault string, fault_line int")


def fault_rates(checked: DataFrame, *by: str) -> DataFrame:
    """Files, faulty files and their share per value of the columns ``by`` (null is a value of its own)."""
    return checked.where(F.col("valid").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum((~F.col("valid")).cast("long")).alias("n_invalid"),
        F.round(F.avg((~F.col("valid")).cast("double")), 6).alias("invalid_rate"),
    )
