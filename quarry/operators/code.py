"""Symbols and structure of source files, one Arrow-batched function per file.

Python is parsed by its own grammar; other languages by line rules that know
the usual heads of definitions and close blocks by braces or indentation.
Coverage: Python in full for definitions, calls and imports; the rule languages
for definitions only (see LINE_RULES).  Files of other languages, over the size
limit, or that do not parse give null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import paths

MAX_BYTES = 262_144
MAX_ERRORS = 10

#: (pattern with a group `name`, type) for the heads of definitions; blocks end by braces unless the language indents.
_NAME = r"(?P<name>[A-Za-z_$][\w$]*)"
_C_LIKE = [
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+{_NAME}", "class"),
    (rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*{_NAME}\s*[<(]", "function"),
    (rf"^\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)", "function"),
    (rf"^\s+(?:(?:public|private|protected|static|async|readonly|get|set|override)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|new\b){_NAME}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::\s*[^{{;]+)?\{{\s*$", "method"),
]
_TYPED = [
    (rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+{_NAME}", "interface"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_NAME}\s*(?:<[^=]*>)?\s*=", "type"),
    (rf"^\s*(?:export\s+)?(?:declare\s+)?(?:const\s+)?enum\s+{_NAME}", "enum"),
]
LINE_RULES: dict[str, list[tuple[str, str]]] = {
    "javascript": _C_LIKE,
    "typescript": [*_TYPED, *_C_LIKE],
    "tsx": [*_TYPED, *_C_LIKE],
    "go": [(rf"^func\s+\([^)]*\)\s*{_NAME}\s*\(", "method"), (rf"^func\s+{_NAME}\s*[\[(]", "function"), (rf"^type\s+{_NAME}\s", "type")],
    "rust": [
        (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+{_NAME}", "function"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+{_NAME}", "struct"),
        (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+{_NAME}", "enum"), (rf"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+{_NAME}", "trait"), (rf"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?{_NAME}", "impl"), (rf"^\s*(?:pub\s+)?mod\s+{_NAME}", "module"),
    ],
    "java": [
        (rf"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*class\s+{_NAME}", "class"), (rf"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+{_NAME}", "interface"), (rf"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+{_NAME}", "enum"),
        (rf"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s+{_NAME}\s*\(", "method"),
    ],
    "c": [(rf"^\s*(?:typedef\s+)?struct\s+{_NAME}\s*\{{", "struct"), (rf"^\s*enum\s+{_NAME}\s*\{{", "enum"), (rf"^#define\s+{_NAME}", "macro"), (rf"^(?!\s|return\b|else\b)[\w*\s]+?\b{_NAME}\s*\([^;]*\)\s*\{{?\s*$", "function")],
    "ruby": [(r"^\s*def\s+(?:self\.)?(?P<name>[A-Za-z_]\w*[?!=]?)", "method"), (rf"^\s*class\s+{_NAME}", "class"), (rf"^\s*module\s+{_NAME}", "module")],
    "php": [(rf"^\s*(?:abstract\s+|final\s+)?class\s+{_NAME}", "class"), (rf"^\s*interface\s+{_NAME}", "interface"), (rf"^\s*trait\s+{_NAME}", "trait"), (rf"^\s+(?:(?:public|private|protected|static)\s+)+function\s+{_NAME}", "method"), (rf"^function\s+{_NAME}", "function")],
    "kotlin": [(rf"^\s*(?:\w+\s+)*class\s+{_NAME}", "class"), (rf"^\s*(?:\w+\s+)*object\s+{_NAME}", "object"), (rf"^\s*(?:\w+\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?{_NAME}\s*\(", "function")],
    "swift": [(rf"^\s*(?:\w+\s+)*(?:class|struct|enum)\s+{_NAME}", "class"), (rf"^\s*(?:\w+\s+)*protocol\s+{_NAME}", "protocol"), (rf"^\s*(?:\w+\s+)*func\s+{_NAME}", "function")],
    "bash": [(rf"^\s*(?:function\s+)?{_NAME}\s*\(\)\s*\{{?", "function"), (r"^(?:export\s+)?(?P<name>[A-Za-z_]\w*)=", "variable")],
    "sql": [(r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)", "table"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?view\s+(?P<name>[\w.\"]+)", "view"), (r"(?i)^\s*create\s+(?:or\s+replace\s+)?function\s+(?P<name>[\w.\"]+)", "function"), (r"(?i)^\s*create\s+(?:unique\s+)?index\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"]+)", "index")],
    "css": [(r"^\s*\.(?P<name>[\w-]+)[^{;]*\{", "class"), (r"^\s*#(?P<name>[\w-]+)[^{;]*\{", "id"), (r"^\s*@keyframes\s+(?P<name>[\w-]+)", "keyframes"), (r"^(?P<name>[a-z][\w-]*)\s*[^{;:]*\{", "tag")],
    "json": [(r"^\s*\"(?P<name>[^\"]+)\"\s*:", "property")],
    "yaml": [(r"^\s*(?:-\s+)?(?P<name>[\w.-]+)\s*:(?:\s|$)", "property")],
    "markdown": [(r"^#{1,6}\s+(?P<name>.*?)\s*#*\s*$", "section")],
}
LINE_RULES["cpp"] = [(rf"^\s*(?:template\s*<[^>]*>\s*)?class\s+{_NAME}", "class"), (rf"^\s*namespace\s+{_NAME}", "namespace"), *LINE_RULES["c"]]
LINE_RULES["csharp"] = [(rf"^\s*namespace\s+(?P<name>[\w.]+)", "module"), (LINE_RULES["java"][0][0], "class"), (LINE_RULES["java"][1][0], "interface"), (LINE_RULES["java"][3][0], "method")]
_ONE_LINE = {"json", "yaml", "markdown"}


def languages() -> list[str]:
    return ["python", *LINE_RULES]


def _python(source: str) -> list[tuple] | None:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: list[tuple] = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            out.append((node.name, "def", kind, first if node.decorator_list else node.lineno, node.end_lineno, node.col_offset + (6 if kind == "class" else 4)))
        elif isinstance(node, ast.Call):
            f = node.func
            if isinstance(f, ast.Name):
                out.append((f.id, "ref", "call", f.lineno, node.end_lineno, f.col_offset))
            elif isinstance(f, ast.Attribute):
                out.append((f.attr, "ref", "call", f.end_lineno, node.end_lineno, f.end_col_offset - len(f.attr)))
        elif isinstance(node, ast.Import):
            out += [(a.name, "ref", "module", a.lineno, node.end_lineno, a.col_offset) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.module:
                out.append((node.module, "ref", "module", node.lineno, node.end_lineno, node.col_offset + 5))
            out += [(a.name, "ref", "import", a.lineno, node.end_lineno, a.col_offset) for a in node.names]
        elif isinstance(node, ast.Attribute):
            out.append((node.attr, "ref", "property", node.end_lineno, node.end_lineno, node.end_col_offset - len(node.attr)))
    return out


@lru_cache(maxsize=64)
def _compiled(language: str) -> list[tuple[re.Pattern, str]]:
    return [(re.compile(p), t) for p, t in LINE_RULES[language]]


def _block_end(lines: list[str], i: int, language: str) -> int:
    """The last line (from 0) of the block whose head is line i."""
    if language in _ONE_LINE:
        return i
    if language == "ruby":
        indent = len(lines[i]) - len(lines[i].lstrip())
        return next((k for k in range(i + 1, len(lines)) if lines[k].strip() == "end" and len(lines[k]) - len(lines[k].lstrip()) <= indent), i)
    depth = seen = 0
    for k in range(i, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$", "", lines[k])
        depth += bare.count("{") - bare.count("}")
        seen |= "{" in bare
        if seen and depth <= 0:
            return k
        if not seen and (bare.rstrip().endswith(";") or k > i + 5):
            return k if bare.rstrip().endswith(";") else i
    return len(lines) - 1 if seen else i


def _by_rules(source: str, language: str) -> list[tuple]:
    lines, out = source.split("\n"), []
    for i, line in enumerate(lines):
        for pattern, kind in _compiled(language):
            m = pattern.match(line)
            if m:
                out.append((m["name"], "def", kind, i + 1, _block_end(lines, i, language) + 1, m.start("name")))
                break
    return out


@lru_cache(maxsize=100)
def extract(source: str, language: str | None) -> tuple | None:
    """Symbols (name, kind, type, line, end_line, column), without repeats of (name, kind, line), by line."""
    if language not in languages() or len(source.encode()) > MAX_BYTES:
        return None
    found = _python(source) if language == "python" else _by_rules(source, language)
    if found is None:
        return None
    first: dict[tuple, tuple] = {}
    for s in found:
        first.setdefault((s[0], s[1], s[3]), s)
    return tuple(sorted(first.values(), key=lambda s: s[3]))


def _fingerprint(source: str, start: int, end: int) -> list[str] | None:
    """Node types in pre-order of the Python nodes that begin on lines start..end (from 1)."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out: list[str] = []

    def walk(node: ast.AST) -> None:
        if start <= getattr(node, "lineno", 0) <= end:
            out.append(type(node).__name__)
        for child in ast.iter_child_nodes(node):
            walk(child)

    walk(tree)
    return out


def _errors(source: str, language: str | None) -> list[tuple] | None:
    """(line, column, message) of Python syntax errors, at most MAX_ERRORS; null for other languages.

    After an error the line is blanked and the rest parsed again."""
    if language != "python":
        return None
    lines, out = source.split("\n"), []
    while len(out) < MAX_ERRORS:
        try:
            ast.parse("\n".join(lines))
            break
        except (ValueError, RecursionError) as e:
            if not isinstance(e, SyntaxError):
                break
        except SyntaxError as e:
            at = min(max(1, e.lineno or 1), len(lines))
            if any(at == o[0] for o in out):
                break
            out.append((at, max(0, (e.offset or 1) - 1), e.msg))
            lines[at - 1] = re.match(r"\s*", lines[at - 1])[0] + "pass"
    return out


# Anchors of Python nodes with their priorities.
PYTHON_ANCHORS = {
    "Return": ("return", 400), "Raise": ("throw", 380), "If": ("if", 320), "For": ("loop", 260), "AsyncFor": ("loop", 260), "While": ("loop", 250),
    "Try": ("try", 280), "ExceptHandler": ("catch", 270), "With": ("with", 220), "AsyncWith": ("with", 220), "Await": ("await", 180), "Call": ("call", 140),
}


def _anchors(source: str, language: str | None) -> list[tuple] | None:
    """(start, end, kind, priority), lines from 0, of the Python nodes that mark a block's flow."""
    if language != "python":
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    out = []
    awaited = {id(n.value) for n in ast.walk(tree) if isinstance(n, ast.Await)}
    for node in ast.walk(tree):
        rule = PYTHON_ANCHORS.get(type(node).__name__)
        if rule and not (isinstance(node, ast.Call) and id(node) in awaited):
            start, end = node.lineno - 1, node.end_lineno - 1
            out.append((start, end if end <= start + 1 else start, *rule))
    return out


def _structure(source: str, language: str | None, name: str) -> tuple | None:
    """(params, return kind, parent kind, decorators, modifiers) of the first Python definition of a name."""
    if language != "python":
        return None
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return None
    parent = {id(c): n for n in ast.walk(tree) for c in ast.iter_child_nodes(n)}
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) and node.name == name:
            args = [] if isinstance(node, ast.ClassDef) else [a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)]
            returns = None if isinstance(node, ast.ClassDef) or node.returns is None else ast.unparse(node.returns)
            above = parent.get(id(node))
            kind = "class" if isinstance(above, ast.ClassDef) else "function" if isinstance(above, ast.FunctionDef | ast.AsyncFunctionDef) else "module"
            return args, returns, kind, [ast.unparse(d) for d in node.decorator_list], ["async"] if isinstance(node, ast.AsyncFunctionDef) else []
    return None


def symbols(files: DataFrame) -> DataFrame:
    """file_id, name, kind, type, line, end_line, column of files (file_id, path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *s) for i, p, c in zip(frame["file_id"], frame["language"], frame["content"], strict=True) if isinstance(c, str) for s in (extract(c, p) or ())]
            yield pd.DataFrame(rows, columns=["file_id", "name", "kind", "type", "line", "end_line", "column"])

    given = files.select("file_id", paths.parse_language(F.col("path")).alias("language"), "content")
    return given.mapInPandas(run, f"file_id {dict(given.dtypes)['file_id']}, name string, kind string, type string, line int, end_line int, column int")


def definitions(files: DataFrame) -> DataFrame:
    return symbols(files).where("kind = 'def'")


def blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, anchors) of files, lines from 0, as symbols.assign_anchors takes them."""
    defs = definitions(files)
    b = defs.select("file_id", F.concat_ws(":", "name", "line").alias("block"), "type", "name", (F.col("line") - 1).alias("start"), (F.col("end_line") - 1).alias("end"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *a) for i, p, c in zip(frame["file_id"], frame["language"], frame["content"], strict=True) if isinstance(c, str) for a in (_anchors(c, p) or ())]
            yield pd.DataFrame(rows, columns=["file_id", "start", "end", "kind", "priority"])

    given = files.select("file_id", paths.parse_language(F.col("path")).alias("language"), "content")
    return b, given.mapInPandas(run, f"file_id {dict(given.dtypes)['file_id']}, start int, end int, kind string, priority int")


@F.pandas_udf(T.ArrayType(T.StringType()))
def fingerprint(source: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """Node types in order of the Python nodes that begin on lines start..end (from 1); null where it does not parse."""
    return pd.Series([None if s is None else _fingerprint(s, a, b) for s, a, b in zip(source, start, end, strict=True)], dtype=object)


def syntax_errors(files: DataFrame) -> DataFrame:
    """file_id, line, column, message."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *e) for i, p, c in zip(frame["file_id"], frame["language"], frame["content"], strict=True) if isinstance(c, str) for e in (_errors(c, p) or ())]
            yield pd.DataFrame(rows, columns=["file_id", "line", "column", "message"])

    given = files.select("file_id", paths.parse_language(F.col("path")).alias("language"), "content")
    return given.mapInPandas(run, f"file_id {dict(given.dtypes)['file_id']}, line int, column int, message string")


def structure(files: DataFrame, name: str) -> DataFrame:
    """file_id, params, return_kind, parent_kind, decorators, modifiers of a definition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, *s) for i, p, c in zip(frame["file_id"], frame["language"], frame["content"], strict=True) if isinstance(c, str) and (s := _structure(c, p, name))]
            yield pd.DataFrame(rows, columns=["file_id", "params", "return_kind", "parent_kind", "decorators", "modifiers"])

    given = files.select("file_id", paths.parse_language(F.col("path")).alias("language"), "content")
    return given.mapInPandas(run, f"file_id {dict(given.dtypes)['file_id']}, params array<string>, return_kind string, parent_kind string, decorators array<string>, modifiers array<string>")
