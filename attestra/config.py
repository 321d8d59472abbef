"""Options of an analysis, with a fast and a thorough profile."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

_YES = {"1", "true", "yes", "on"}


@dataclass(frozen=True)
class Options:
    copy_threshold: float = 0.75
    deep_semantic_threshold: float = 0.82
    deep_rerank_threshold: float = 0.65
    deep_rerank_alone: float = 0.75
    rerank_from: float = 0.55
    ai_threshold: float = 0.55
    ai_least_chars: int = 100
    chunk_size: int = 1000
    chunk_overlap: int = 50
    semantic_top_k: int = 2
    semantic_least: float | None = None
    enable_ai: bool = False
    enable_reranker: bool = False
    max_chunks: int = 60
    encode_batch_size: int = 16
    #: Whether each text has an idf of its own with the corpus, as when it is analysed alone; otherwise all texts share one.
    own_idf: bool = True


def profile(fast: bool = True, **changes) -> Options:
    """The fast profile, or the thorough one, with changes."""
    base = Options() if fast else Options(chunk_size=500, semantic_top_k=5, enable_ai=True, enable_reranker=True, max_chunks=200, encode_batch_size=8)
    return replace(base, **changes)


def read_env(path: str) -> dict[str, str]:
    """Settings of a file of NAME=value lines: blank lines, comments and lines without = are skipped, one layer of quotes is taken off."""
    out: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        name, value = (x.strip() for x in line.split("=", 1))
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        out.setdefault(name, value)
    return out


def from_env(env_file: str | None = None) -> Options:
    """Options from the environment, which wins over the file; FAST_MODE (on unless told otherwise) chooses the profile."""
    env = (read_env(env_file) if env_file else {}) | dict(os.environ)
    flag = lambda v: v.strip().lower() in _YES
    changes = {}
    base = profile(flag(env.get("FAST_MODE", "1")))
    for f in fields(Options):
        raw = env.get(f.name.upper())
        if raw is None:
            continue
        now = getattr(base, f.name)
        changes[f.name] = flag(raw) if isinstance(now, bool) else type(now)(raw) if now is not None else float(raw)
    return replace(base, **changes)
