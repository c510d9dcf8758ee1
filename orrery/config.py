"""Settings of an index from a TOML file, with defaults and checks."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

#: Bytes of free memory below which the small embedding is chosen.
LOW_MEMORY = 4 << 30


@dataclass(frozen=True)
class Config:
    """All settings; unknown keys and values out of range are refused."""

    resolution: float = 1.5
    prune: float = 0.3
    cosine: float = 0.4
    temporal: float = 0.05
    affinity: float = 0.4
    max_file_bytes: int = 5 * 1024 * 1024
    debounce_ms: int = 600
    max_batch_paths: int = 500
    in_flight: int = 4
    max_response_kb: int = 256
    embedding_dim: int | None = None
    skipped: tuple[str, ...] = field(default=("node_modules", ".git"))

    def __post_init__(self) -> None:
        for name in ("resolution", "max_file_bytes", "debounce_ms", "max_batch_paths", "in_flight", "max_response_kb"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        if not 0 <= self.prune <= 1:
            raise ValueError("prune must lie within 0 and 1")


def load_config(path: str | None) -> Config:
    """The settings of a file; defaults where there is none."""
    if path is None or not os.path.exists(path):
        return Config()
    with open(path, "rb") as file:
        values = tomllib.load(file)
    known = {f.name for f in fields(Config)}
    strange = set(values) - known
    if strange:
        raise ValueError(f"unknown settings: {', '.join(sorted(strange))}")
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def choose_dimension(config: Config, free_bytes: int, small: int = 384, large: int = 768) -> int:
    """The forced dimension, else the small one where memory is short."""
    return config.embedding_dim or (small if free_bytes < LOW_MEMORY else large)
