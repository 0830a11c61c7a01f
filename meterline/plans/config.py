"""Configuration: frozen sections with defaults, read from TOML, hashed by stage."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import tomllib
from pathlib import Path


class ConfigError(ValueError):
    pass


def _at_least(section: object, name: str, least: float, strict: bool = False) -> None:
    value = getattr(section, name)
    if value < least or strict and value == least:
        raise ConfigError(f"{name} is {value}, it must be {'over' if strict else 'at least'} {least}")


@dataclasses.dataclass(frozen=True)
class Ingest:
    sample_rate: int = 44100
    channels: int = 2
    copy_video: bool = False


@dataclasses.dataclass(frozen=True)
class Stems:
    retain: bool = True
    model: str = "htdemucs"
    device: str = "auto"
    cpu_threads: int = 1

    def __post_init__(self):
        _at_least(self, "cpu_threads", 1)


@dataclasses.dataclass(frozen=True)
class Features:
    vocal_enter_db: float = -35.0
    vocal_exit_db: float = -45.0
    vocal_min_region_seconds: float = 0.3
    vocal_min_gap_seconds: float = 0.2
    phase_fit_window_seconds: float = 0.03

    def __post_init__(self):
        _at_least(self, "phase_fit_window_seconds", 0, strict=True)


@dataclasses.dataclass(frozen=True)
class Lyrics:
    model: str = "small"
    language: str | None = None
    confidence_threshold: float = 0.5
    long_word_seconds: float = 2.5
    flag_no_speech_threshold: float = 0.5
    compression_ratio_threshold: float = 2.4
    overlap_rms_db: float = -15.0
    min_anchor_score: float = 0.6
    uncovered_min_seconds: float = 1.0
    fallback_language: str = "en"
    clip_to_vocal_activity: bool = True
    clip_padding_seconds: float = 0.5
    decode_no_speech_threshold: float = 0.6

    def __post_init__(self):
        _at_least(self, "clip_padding_seconds", 0)


@dataclasses.dataclass(frozen=True)
class Video:
    detector_threshold: float = 27.0
    min_shot_seconds: float = 0.4
    caption_backend: str = "null"
    caption_model: str = "claude-haiku-4-5"
    caption_prompt_version: str = "v1"
    caption_max_output_tokens: int = 300
    caption_budget_usd_per_run: float = 0.50

    def __post_init__(self):
        _at_least(self, "min_shot_seconds", 0, strict=True)
        _at_least(self, "caption_max_output_tokens", 1)
        _at_least(self, "caption_budget_usd_per_run", 0)
        if self.caption_backend not in ("null", "anthropic"):
            raise ConfigError(f"caption_backend is {self.caption_backend!r}")


@dataclasses.dataclass(frozen=True)
class Config:
    ingest: Ingest = Ingest()
    stems: Stems = Stems()
    features: Features = Features()
    lyrics: Lyrics = Lyrics()
    video: Video = Video()


SECTION_OF = {"source": "ingest", "stems": "stems", "audio_features": "features", "lyrics": "lyrics", "video": "video"}


def parse(told: dict) -> Config:
    sections = {f.name: type(f.default) for f in dataclasses.fields(Config)}
    for name in told:
        if name not in sections:
            raise ConfigError(f"no section {name!r}")
    try:
        return Config(**{name: sections[name](**values) for name, values in told.items()})
    except TypeError as e:
        raise ConfigError(str(e)) from None


def load(path: str | None = None, default: str = "meterline.toml") -> Config:
    """The file named, else the default one if it is there, else all defaults; a named file that isn't there is an error."""
    at = Path(path or default)
    if at.is_file():
        return parse(tomllib.loads(at.read_text(encoding="utf-8")))
    if path:
        raise FileNotFoundError(f"no configuration at {path}")
    return Config()


def section_hash(section: object) -> str:
    """16 hex digits over the section's canonical JSON, defaults included."""
    text = json.dumps(dataclasses.asdict(section), ensure_ascii=False, indent=2) + "\n"
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def current_hashes(config: Config) -> list[tuple[str, str]]:
    """(stage, hash) of every stage that has a section."""
    return [(stage, section_hash(getattr(config, section))) for stage, section in SECTION_OF.items()]
