"""Settings of ingestion and search, with precedence overrides > environment > file > defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

# The defaults of the retrieval service whose results are to be matched.
WARNING = "⚠️ This is a retrieved code snippet. Verify against the source before using."
CODE_EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "java", "go", "rs", "c", "cpp", "cc", "h", "hpp", "cs", "rb", "php", "swift", "kt", "scala", "sh", "bash", "zsh", "sql")
CONFIG_EXTENSIONS = ("json", "yaml", "yml", "toml", "ini", "cfg", "conf", "env", "xml")


@dataclass(frozen=True)
class Config:
    semantic_weight: float = 0.6
    lexical_weight: float = 0.4
    hybrid_enabled: bool = True
    default_limit: int = 10
    max_limit: int = 50
    min_score: float = 0.05
    lexical_candidates: int = 40
    rerank_candidates: int = 40
    rerank_top: int = 15
    rerank_enabled: bool = True
    max_per_file: int = 3
    symbol_enabled: bool = True
    symbol_exact_limit: int = 20
    symbol_fuzzy_limit: int = 10
    distance: str = "<=>"
    code_aware: bool = True
    code_warning: str = WARNING
    chunk_chars: int = 750
    overlap_chars: int = 200
    max_file_bytes: int = 204_800
    vector_dim: int = 1024
    embed_batch: int = 48
    embed_per_minute: int = 200
    k1: float = 1.5
    b: float = 0.75

    def __post_init__(self) -> None:
        if abs(self.semantic_weight + self.lexical_weight - 1) > 0.001:
            raise ValueError("semantic and lexical weights must sum to 1")
        if self.distance not in ("<=>", "<#>", "<->"):
            raise ValueError(f"unknown distance {self.distance!r}")

    def limit(self, requested: int | None) -> int:
        """The requested number of results, 0 or None meaning the default, at most max_limit."""
        if requested is not None and requested < 0:
            raise ValueError("a limit cannot be negative")
        return min(requested or self.default_limit, self.max_limit)


def read_env_file(text: str) -> dict[str, str]:
    """KEY=VALUE lines; # starts a comment line; one pair of quotes around a value goes."""
    out = {}
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = (x.strip() for x in line.split("=", 1))
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out[key] = value
    return out


def load(overrides: Mapping[str, object] | None = None, env: Mapping[str, str] | None = None, file_text: str = "") -> Config:
    """Keys are field names in upper case."""
    env, listed = os.environ if env is None else env, read_env_file(file_text)
    found: dict[str, object] = {}
    for f in fields(Config):
        raw = env.get(f.name.upper(), listed.get(f.name.upper()))
        if raw is not None:
            kind = type(f.default)
            found[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
    return replace(Config(), **(found | dict(overrides or {})))
