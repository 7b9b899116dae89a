"""Settings of the engine: defaults, a file that overrides them, and limits that no value passes."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields
from pathlib import Path

# Each setting's default, and the least and the greatest it may be (none: no limit).
LIMITS: dict[str, tuple] = {
    "transcript_days": (90, 1, None),
    "chunk_size": (1800, 400, None),
    "chunk_overlap": (200, 0, None),
    "candidate_limit": (50, 10, 200),
    "rrf_k": (60, 1, None),
    "max_file_bytes": (2_000_000, 1024, None),
    "reconcile_min_ratio": (0.5, 0.0, 1.0),
    "rerank_documents": (20, 1, 20),
    "rerank_batch": (8, 1, 64),
    "rerank_passage": (700, 100, None),
    "result_limit": (8, 1, 20),
    "page_limit": (20, 1, 50),
    "ann_min_chunks": (100_000, 1_000, None),
    "ann_latency_ms": (750.0, 1.0, None),
    "min_messages": (8, 1, None),
    "min_characters": (12_000, 1_000, None),
    "max_messages_per_unit": (12, 1, None),
    "max_characters_per_unit": (24_000, 1_000, None),
    "gap_minutes": (30, 1, None),
    "pilot_per_source": (10, 1, None),
    "latency_threshold_ms": (1_500.0, 1.0, None),
}
BACKENDS = ("auto", "exact", "ann")


def within(name: str, value: object) -> float | int:
    """A value of a setting, moved to its nearest limit."""
    default, least, most = LIMITS[name]
    number = type(default)(value)
    number = number if least is None else max(least, number)
    return number if most is None else min(most, number)


@dataclass(frozen=True)
class Settings:
    """All settings within their limits; what isn't named here isn't a setting."""

    transcript_days: int = 90
    chunk_size: int = 1800
    chunk_overlap: int = 200
    candidate_limit: int = 50
    rrf_k: int = 60
    max_file_bytes: int = 2_000_000
    reconcile_min_ratio: float = 0.5
    rerank_documents: int = 20
    rerank_batch: int = 8
    rerank_passage: int = 700
    result_limit: int = 8
    page_limit: int = 20
    ann_min_chunks: int = 100_000
    ann_latency_ms: float = 750.0
    min_messages: int = 8
    min_characters: int = 12_000
    max_messages_per_unit: int = 12
    max_characters_per_unit: int = 24_000
    gap_minutes: int = 30
    pilot_per_source: int = 10
    latency_threshold_ms: float = 1_500.0
    vector_backend: str = "auto"
    rerank: bool = True
    folder: str = ""

    def __post_init__(self):
        for name in LIMITS:
            object.__setattr__(self, name, within(name, getattr(self, name)))
        if self.vector_backend not in BACKENDS:
            raise ValueError(f"vector_backend must be one of {BACKENDS}")


def load(path: str | os.PathLike | None = None) -> Settings:
    """Settings of a JSON object in a file, if it is there, over the defaults; LOOMSTEAD_FOLDER goes over its folder."""
    given: dict = {}
    if path is not None and Path(path).exists():
        given = json.loads(Path(path).read_text(encoding="utf-8"))
        if not isinstance(given, dict):
            raise ValueError(f"settings must be a JSON object: {path}")
    known = {f.name for f in fields(Settings)}
    if unknown := sorted(given.keys() - known):
        raise ValueError(f"unknown settings: {unknown}")
    if os.environ.get("LOOMSTEAD_FOLDER"):
        given["folder"] = os.environ["LOOMSTEAD_FOLDER"]
    return Settings(**given)
