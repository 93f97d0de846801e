"""Structural metrics of source files by a tolerant scanner: functions, classes, imports, calls, complexity, nesting.

The scanner never rejects a file: strings and comments are blanked first, then Python is read by indentation, JavaScript,
TypeScript and Go by braces.  Other languages get an empty structure with complexity 1.  One Arrow UDF a file, no shuffle.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FUNCTION = "struct<name:string,line_start:int,line_end:int,params:int,length:int,has_docstring:boolean>"
CLASS = "struct<name:string,line_start:int,line_end:int,methods:int,has_docstring:boolean>"
STRUCTURE = f"struct<functions:array<{FUNCTION}>,classes:array<{CLASS}>,imports:array<string>,calls:array<string>,lines_of_code:int,complexity:int,max_nesting:int,comment_ratio:double,avg_function_length:double,max_function_length:int>"

_TEXTS = {
    "python": re.compile(r"(#[^\n]*)|([rbfuRBFU]{0,2}(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?))", re.S),
    "c": re.compile(r"(//[^\n]*|/\*.*?(?:\*/|\Z))|(\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z))", re.S),
}
_WORDS = re.compile(r"\w+")
_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
#: Words before a parenthesis that are no call.
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "and", "or", "not", "in", "def", "class", "print_function", "with", "elif", "except", "lambda", "assert", "await", "typeof", "new", "func"}


def _blank(code: str, family: str) -> tuple[str, int]:
    """The code with comments removed and strings replaced by \"\"s, line ends kept; and the number of comments."""
    comments = 0

    def put(m: re.Match) -> str:
        nonlocal comments
        comments += m[1] is not None
        return "\n" * m[0].count("\n") if m[1] is not None else '""' + "\n" * m[0].count("\n")

    return _TEXTS[family].sub(put, code), comments


def _empty(code: str) -> dict:
    return {"functions": [], "classes": [], "imports": [], "calls": [], "lines_of_code": 0 if not code.strip() else code.count("\n") + 1, "complexity": 1, "max_nesting": 0, "comment_ratio": 0.0}


def _params(text: str, self_stars: bool) -> int:
    """Top-level parameters of a parenthesised list; for Python those with a leading star and no annotation don't count."""
    depth, parts, start = 0, [], 0
    for i, c in enumerate(text):
        depth += (c in "([{<") - (c in ")]}>" and text[max(0, i - 1)] not in "=-")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    parts = [p.strip() for p in [*parts, text[start:]]]
    return sum(1 for p in parts if p and p != "/" and not (self_stars and p.startswith("*") and ":" not in p))


def _closing(text: str, at: int, opening: str = "(", closing: str = ")") -> int:
    """The place of the bracket that closes the one at `at`, or the end."""
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == opening) - (text[i] == closing)
        if depth == 0:
            return i
    return len(text)


_STARTS = re.compile(r"\s*(?:async\s+)?(if|for|while|with|try|def|class)\b")
_FOLLOWS = re.compile(r"\s*(elif|else|except|finally|case)\b")
_NAMED = re.compile(r"\s*(?:async\s+)?(?:def|class)\s+(\w+)")
_IMPORT = re.compile(r"\s*(import|from)\s")
_AND_OR = re.compile(r"\b(?:and|or)\b")
_ELSE = re.compile(r"\belse\b")
_COMPREHENSION = re.compile(r"\[[^\[\]]*\bfor\b[^\[\]]*\]")
_HEADED = re.compile(r"\b(def|class)\s+$")
#: Lines up to this length are remembered, with what they hold: those of code come again and again.
_SHORT = 200


class _Line(NamedTuple):
    """What a line of Python holds, whatever stands around it; begun: where it may begin a statement."""

    indent: int
    word: str | None
    name: str
    follows: bool
    imports: bool
    branches_begun: int
    branches: int
    calls: tuple[str, ...]
    opened: int


def _line(line: str) -> _Line | None:
    """The facts of a blanked line; None for an empty one."""
    bare = line.lstrip()
    if not bare:
        return None
    started, named = _STARTS.match(line), _NAMED.match(line)
    first = _WORDS.search(line)
    second = _WORDS.search(line, first.end()) if first else None
    lead = first[0] if first else ""
    branches = (len(_AND_OR.findall(line)) if "and" in line or "or" in line else 0) + (len(_COMPREHENSION.findall(line)) if "[" in line and "for" in line else 0)
    begun = branches + (lead in ("if", "elif", "for", "while", "except", "with") or lead == "async" and second is not None and second[0] in ("for", "with"))
    if "else" in line and _ELSE.search(line):
        ifs = _WORDS.findall(line).count("if")
        branches += ifs
        begun += 0 if lead == "else" else ifs - (lead == "if")
    calls = tuple(m[1] for m in _CALL.finditer(line) if m[1] not in _NO_CALL and not _HEADED.search(line[: m.start()])) if "(" in line else ()
    opened = sum(line.count(c) for c in "([{") - sum(line.count(c) for c in ")]}")
    return _Line(len(line) - len(bare), started[1] if started else None, named[1] if named else "<anonymous>", bool(_FOLLOWS.match(line)), bool(_IMPORT.match(line)), begun, branches, calls, opened)


_known_line = lru_cache(maxsize=16_384)(_line)


def _python(code: str) -> dict:
    out = _empty(code)
    text, comments = _blank(code, "python")
    lines, raw = text.split("\n"), code.split("\n")
    open_ = 0  # brackets open at a line's start: a continued line starts no statement
    blocks: list[dict] = []  # open blocks: indent, nesting depth, and what they become
    done: list[dict] = []
    last = 0
    for no, line in enumerate(lines, 1):
        at = _known_line(line) if len(line) <= _SHORT else _line(line)
        if at is None:
            continue
        if open_ == 0:
            indent = at.indent
            while blocks and (indent < blocks[-1]["indent"] or indent == blocks[-1]["indent"] and not (at.follows and blocks[-1]["word"] not in ("def", "class"))):
                done.append(blocks.pop() | {"end": last})
            if at.word:
                depth = (blocks[-1]["depth"] if blocks else 0) + 1
                out["max_nesting"] = max(out["max_nesting"], depth)
                blocks.append({"indent": indent, "depth": depth, "word": at.word, "name": at.name, "start": no, "in": blocks[-1]["word"] if blocks else "", "level": blocks[-1] if blocks else None, "methods": 0})
                if at.word == "def" and blocks[-1]["level"] is not None and blocks[-1]["in"] == "class":
                    blocks[-1]["level"]["methods"] += 1
            if at.imports:
                out["imports"].append(raw[no - 1].strip())
        out["complexity"] += at.branches if open_ else at.branches_begun
        out["calls"] += at.calls
        open_ = max(0, open_ + at.opened)
        last = no
    done += [b | {"end": last} for b in reversed(blocks)]
    for b in sorted(done, key=lambda b: b["start"]):
        if b["word"] not in ("def", "class"):
            continue
        # A docstring: the first line after the header starts with a quote.
        header = next((k for k in range(b["start"] - 1, b["end"]) if lines[k].rstrip().endswith(":")), b["start"] - 1)
        body = next((raw[k].strip() for k in range(header + 1, b["end"]) if raw[k].strip()), "")
        doc = bool(re.match(r"[rRuUbB]?[\"']", body))
        row = {"name": b["name"], "line_start": b["start"], "line_end": b["end"], "has_docstring": doc}
        if b["word"] == "class":
            out["classes"].append(row | {"methods": b["methods"]})
        else:
            joined = "\n".join(lines[b["start"] - 1 : b["end"]])
            at = joined.find("(")
            out["functions"].append(row | {"params": _params(joined[at + 1 : _closing(joined, at)], True) if at >= 0 else 0, "length": b["end"] - b["start"] + 1})
    return _finish(out, text, comments)


_ARROW = r"(?:\b(?:const|let|var)\s+(\w+)\s*(?::[^=\n]*)?=\s*)?(?:async\s+)?(?:\(([^()]*)\)|(\b\w+))\s*(?::\s*[\w<>\[\]., ]+)?=>"
_FUNCTION_HEADS = r"\b(?:async\s+)?function\s*\*?\s*(\w+)\s*\(|%s|^\s*(?:(?:public|private|protected|static|async|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|function\b|return\b)(\w+)\s*\([^()]*\)\s*(?::\s*[\w<>\[\]., ]+)?\{"
_JS_FUNCTION = re.compile(_FUNCTION_HEADS % _ARROW, re.M)
#: The same for texts without an arrow, where that part can't match but is tried at every word.
_JS_PLAIN = re.compile(_FUNCTION_HEADS % "(?!)()()()", re.M)
_GO_FUNCTION = re.compile(r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", re.M)
_NESTING = {"javascript": r"\b(?:if|for|while|do|try)\b|=>|\bfunction\b(?=\s*\*?\s*\w+\s*\()|\bclass\b", "go": r"\b(?:if|for|select|switch)\b|^func\b"}
_BRANCHES = {"javascript": r"\b(?:if|for|while|do|catch|case|default)\b(?!\s*:)|\bcase\b|&&|\|\||\?(?![.?:])", "typescript": r"\b(?:if|for|while|do|catch|case|default)\b(?!\s*:)|&&|\|\||\?(?![?:])|\?\.", "go": r"\b(?:if|for|switch|select|range)\b|&&|\|\|"}


def _braced(code: str, language: str) -> dict:
    out = _empty(code)
    text, comments = _blank(code, "c")
    go = language == "go"
    breaks = [m.start() for m in re.finditer("\n", text)]
    line_of = lambda at: bisect.bisect_left(breaks, at) + 1
    out["complexity"] += len(re.findall(_BRANCHES[language], text))
    # Nesting: each keyword opens a level that ends with the block after it, or with the statement if it has none.
    levels: list[tuple[bool, int]] = []  # (counted, of a brace) for open braces
    waiting = parens = 0
    for m in re.finditer(_NESTING["go" if go else "javascript"] + r"|[{};()]", text, re.M):
        if m[0] == "{":
            levels.append((waiting > 0, waiting))
            waiting = 0
        elif m[0] == "}":
            if levels:
                levels.pop()
            waiting = 0
        elif m[0] in "()":
            parens = max(0, parens + (1 if m[0] == "(" else -1))
        elif m[0] == ";":
            waiting = waiting if parens else 0  # a for header's semicolons end no statement
        else:
            waiting += 1
            out["max_nesting"] = max(out["max_nesting"], sum(n for _, n in levels) + waiting)
    for m in (_GO_FUNCTION if go else _JS_FUNCTION if "=>" in text else _JS_PLAIN).finditer(text):
        name = next((g for g in (m.groups() if go else (m[1], m[2], m[5])) if g), "<anonymous>")
        body = text.find("{", m.end() - 1)
        arrow = not go and "=>" in m[0]
        if arrow and not re.match(r"\s*\{", text[m.end() :]):
            end = text.find("\n", m.end())
            end = len(text) - 1 if end < 0 else end - 1
        else:
            end = _closing(text, body, "{", "}") if body >= 0 else len(text) - 1
        lead = m.start() + len(m[0]) - len(m[0].lstrip())
        inner = m[3] if arrow and m[3] is not None else m[4] if arrow else text[text.find("(", m.end() - 1 if go or m[1] else lead) + 1 : _closing(text, text.find("(", m.end() - 1 if go or m[1] else lead))]
        start, stop = line_of(lead), line_of(max(lead, end))
        out["functions"].append({"name": name, "line_start": start, "line_end": stop, "params": _params(inner or "", False), "length": stop - start + 1, "has_docstring": False})
    named = sorted(f["line_start"] for f in out["functions"] if f["name"] != "<anonymous>")
    for m in re.finditer(r"^type\s+(\w+)" if go else r"\bclass\s+(\w+)", text, re.M):
        body = text.find("{", m.end())
        end = _closing(text, body, "{", "}") if body >= 0 else m.end()
        methods = 0 if go else bisect.bisect_right(named, line_of(end)) - bisect.bisect_right(named, line_of(m.start()))
        out["classes"].append({"name": m[1], "line_start": line_of(m.start()), "line_end": line_of(end), "methods": methods, "has_docstring": False})
    pattern = r"^import\s*(?:\([^)]*\)|[^\n]*)" if go else r"^import\b[^\n]*"
    out["imports"] = [m[0].strip() for m in re.finditer(pattern, code, re.M)]
    out["calls"] = [m[1] for m in _CALL.finditer(text) if m[1] not in _NO_CALL and not re.search(r"\b(function|func)\s+$", text[: m.start()])]
    return _finish(out, text, comments)


def _finish(out: dict, text: str, comments: int) -> dict:
    tokens = len(re.findall(r"\w+|[^\w\s]", text)) + comments
    out["comment_ratio"] = comments / tokens if tokens else 0.0
    return out


def scan(code: str | None, language: str | None) -> dict:
    """The structure of one file."""
    code = code or ""
    out = _python(code) if language == "python" else _braced(code, language) if language in ("javascript", "typescript", "go") else _empty(code)
    lengths = [f["length"] for f in out["functions"]]
    return out | {"avg_function_length": sum(lengths) / len(lengths) if lengths else 0.0, "max_function_length": max(lengths, default=0)}


def _fields() -> list[pa.Field]:
    function = pa.struct([("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("params", pa.int32()), ("length", pa.int32()), ("has_docstring", pa.bool_())])
    klass = pa.struct([("name", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("methods", pa.int32()), ("has_docstring", pa.bool_())])
    texts = pa.list_(pa.string())
    fields = [("functions", pa.list_(function)), ("classes", pa.list_(klass)), ("imports", texts), ("calls", texts), ("lines_of_code", pa.int32()), ("complexity", pa.int32()), ("max_nesting", pa.int32()), ("comment_ratio", pa.float64()), ("avg_function_length", pa.float64()), ("max_function_length", pa.int32())]
    return [pa.field(*f) for f in fields]


def in_slices(run: Callable[..., list], kind: pa.DataType, *columns: pa.Array, size: int = 64) -> pa.Array:
    """An Arrow column of what `run` makes of lists of the columns' values: only `size` rows at a time are Python objects."""
    n = len(columns[0])
    parts = [pa.array(run(*(c.slice(at, size).to_pylist() for c in columns)), kind) for at in range(0, n, size)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def with_structure(files: DataFrame) -> DataFrame:
    """files with column `structure`."""

    kind = pa.struct(_fields())

    def structure_of(code: pa.Array, language: pa.Array) -> pa.Array:
        return in_slices(lambda codes, languages: [scan(c, k) for c, k in zip(codes, languages, strict=True)], kind, code, language)

    return files.withColumn("structure", F.arrow_udf(structure_of, STRUCTURE)("code", "language"))


def summary_text(structure: Column, imports: int = 10) -> Column:
    """A structure as text for a model: its metrics, functions, classes, and its first `imports` imports."""
    s = structure
    metric = lambda label, value, unit="": F.concat(F.lit(f"{label}: "), value.cast("string"), F.lit(unit))
    doc = lambda x: F.when(x["has_docstring"], "has docstring").otherwise("NO docstring")
    lines = [
        metric("Lines of code", s["lines_of_code"]), metric("Functions", F.size(s["functions"])), metric("Classes", F.size(s["classes"])),
        metric("Cyclomatic complexity", s["complexity"]), metric("Max nesting depth", s["max_nesting"]),
        metric("Average function length", F.round(s["avg_function_length"], 1), " lines"), metric("Max function length", s["max_function_length"], " lines"),
        F.concat(F.lit("Comment ratio: "), F.format_string("%.1f%%", s["comment_ratio"] * 100)), metric("Imports", F.size(s["imports"])),
    ]
    functions = F.transform(s["functions"], lambda f: F.format_string("  - %s(params=%d) lines %d-%d (%d lines, %s)", f["name"], f["params"], f["line_start"], f["line_end"], f["length"], doc(f)))
    classes = F.transform(s["classes"], lambda c: F.format_string("  - %s lines %d-%d (%d methods, %s)", c["name"], c["line_start"], c["line_end"], c["methods"], doc(c)))
    listed = lambda title, rows: F.when(F.size(rows) > 0, F.concat(F.lit(f"\n{title}:\n"), F.array_join(rows, "\n")))
    names = F.when(F.size(s["imports"]) > 0, F.concat(F.lit("\nImports: "), F.array_join(F.slice(s["imports"], 1, imports), ", ")))
    return F.concat_ws("\n", *lines, listed("Functions", functions), listed("Classes", classes), names)
