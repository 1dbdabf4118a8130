"""Options as frozen records, read and written as YAML (where a YAML library is there) or JSON, and checked when built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class StreamOptions:
    min_chunk: float = 1.0
    voice_chunk: float = 0.5
    beams: int = 1
    frame_threshold: int = 25
    rewind_threshold: int = 1500
    audio_max_seconds: float = 30.0
    max_context: int = 0
    language: str = "en"
    never_fire: bool = False

    def __post_init__(self) -> None:
        if self.min_chunk <= 0 or self.voice_chunk <= 0:
            raise ValueError("chunks must be longer than 0 s")
        if self.beams < 1:
            raise ValueError("at least one beam is needed")
        if self.frame_threshold < 0 or self.audio_max_seconds <= 0 or self.max_context < 0:
            raise ValueError("thresholds and budgets can't be negative")


@dataclass(frozen=True)
class DecodeOptions:
    temperatures: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    beam_size: int | None = None
    best_of: int | None = None
    patience: float | None = None
    length_penalty: float | None = None

    def __post_init__(self) -> None:
        if self.beam_size is not None and self.best_of is not None:
            raise ValueError("beam_size and best_of exclude each other")
        if self.patience is not None and self.beam_size is None:
            raise ValueError("patience needs beam_size")
        if self.length_penalty is not None and not 0 <= self.length_penalty <= 1:
            raise ValueError("length_penalty must be from 0 to 1")

    @property
    def max_candidates(self) -> int:
        return round((self.beam_size or 1) * (self.patience or 1.0))


def _yaml():
    try:
        import yaml
    except ImportError:
        return None
    return yaml


def load(kind: type, path: str):
    """A record from a file; names that it doesn't have are an error."""
    text, yaml = Path(path).read_text(), _yaml()
    if path.endswith((".yaml", ".yml")) and yaml is None:
        raise RuntimeError("no YAML library here; use JSON")
    values = (yaml.safe_load(text) if path.endswith((".yaml", ".yml")) else json.loads(text)) or {}
    if unknown := set(values) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def save(record, path: str) -> None:
    yaml = _yaml()
    as_yaml = path.endswith((".yaml", ".yml"))
    if as_yaml and yaml is None:
        raise RuntimeError("no YAML library here; use JSON")
    values = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(record).items()}
    Path(path).write_text(yaml.safe_dump(values) if as_yaml else json.dumps(values, indent=1))
