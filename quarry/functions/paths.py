"""Paths, languages and content types."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by extension, for chunks, for parsing and for display.
CHUNK_LANGUAGES = {
    ".ts": "typescript", ".tsx": "tsx", ".js": "javascript", ".jsx": "jsx",
    ".py": "python", ".rs": "rust", ".go": "go", ".java": "java",
    ".c": "c", ".cpp": "cpp", ".h": "c", ".hpp": "cpp",
    ".rb": "ruby", ".php": "php", ".swift": "swift", ".kt": "kotlin",
    ".cs": "csharp", ".scala": "scala", ".lua": "lua", ".zig": "zig",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".md": "markdown", ".json": "json", ".yaml": "yaml", ".yml": "yaml",
    ".toml": "toml", ".html": "html", ".css": "css", ".sql": "sql",
}
PARSE_LANGUAGES = {
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx",
    ".py": "python", ".pyi": "python", ".sh": "bash", ".bash": "bash", ".zsh": "bash",
    ".go": "go", ".rs": "rust", ".java": "java", ".c": "c", ".h": "c",
    ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp", ".hh": "cpp", ".hxx": "cpp",
    ".cs": "csharp", ".kt": "kotlin", ".kts": "kotlin", ".php": "php",
    ".rb": "ruby", ".rake": "ruby", ".gemspec": "ruby", ".swift": "swift",
    ".css": "css", ".scss": "css", ".json": "json", ".jsonc": "json",
    ".yaml": "yaml", ".yml": "yaml", ".sql": "sql", ".md": "markdown", ".mdx": "markdown",
}
SHOWN_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "go": "go", "rs": "rust", "c": "c", "cpp": "cpp", "cc": "cpp", "h": "c", "hpp": "cpp",
    "cs": "csharp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin", "scala": "scala",
    "sh": "shell", "bash": "shell", "zsh": "shell", "sql": "sql", "yml": "yaml", "yaml": "yaml",
    "json": "json", "toml": "toml", "md": "markdown",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """From the last dot of the file name, lower-cased; empty without one, or where the name only begins with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]*)$", 1))


def last_dot(path: Column) -> Column:
    """What follows the last dot of the whole path, dot included; without a dot its last character."""
    dot = F.length(path) - F.length(F.substring_index(path, ".", -1))
    return F.lower(F.when(F.contains(path, F.lit(".")), F.substring(path, dot, F.length(path))).otherwise(F.right(path, F.lit(1))))


def chunk_language(path: Column) -> Column:
    return F.coalesce(_lookup(last_dot(path), CHUNK_LANGUAGES), F.lit("unknown"))


def parse_language(path: Column) -> Column:
    return _lookup(extension(path), PARSE_LANGUAGES)


def shown_language(path: Column) -> Column:
    return F.coalesce(_lookup(F.substring(extension(path), 2, 100), SHOWN_LANGUAGES), F.lit("text"))


def content_type(language: Column) -> Column:
    return F.when(language == "markdown", "markdown").when(language.isin("text", "rst", "asciidoc"), "text").otherwise("code")


def shown_content_type(path: Column, code: tuple[str, ...], config: tuple[str, ...]) -> Column:
    ext = F.substring(extension(path), 2, 100)
    return F.when(ext == "md", "markdown").when(ext.isin(*code), "code").when(ext.isin(*config), "config").otherwise("text")


def relative(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)


def within(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def is_supported(path: str) -> bool:
    return posixpath.splitext(path)[1].lower() in PARSE_LANGUAGES


def supported_extensions() -> list[str]:
    return list(PARSE_LANGUAGES)


def normalize(path: str, home: str = "~") -> str:
    """Trimmed, one quote off each end, ~ expanded, separators collapsed, dots resolved (POSIX)."""
    p = re.sub(r"^[\"']|[\"']$", "", path.strip())
    if p == "~" or p.startswith("~/"):
        p = home + p[1:]
    return posixpath.normpath(re.sub("/+", "/", p)) if p else p


def size_text(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} GB"


def pluralize(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit("s")), F.concat(word, F.lit("es"))).when(F.endswith(word, F.lit("y")), F.regexp_replace(word, "y$", "ies")).otherwise(F.concat(word, F.lit("s")))
