"""Settings of an export: a YAML file with known keys only."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

CONFIG_NAME = ".lodestack.yml"
SPLIT_CHARS, SPLIT_STRATEGIES = 200_000, ("plain", "heading")


@dataclass(frozen=True)
class Rules:
    paths: tuple[str, ...] = ()
    globs: tuple[str, ...] = ()


@dataclass(frozen=True)
class Settings:
    include: Rules = field(default_factory=Rules)
    exclude: Rules = field(default_factory=Rules)
    max_file_size_bytes: int | None = None
    max_total_files: int | None = None
    max_export_bytes: int | None = None
    max_line_count: int | None = None
    split: bool = False
    split_max_chars: int = SPLIT_CHARS
    split_strategy: str = "heading"


def positive(value: object, name: str) -> int | None:
    """A positive number or nothing."""
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive number")
    return value


def _only(data: object, known: set[str], where: str) -> dict:
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError(f"{where} must be a mapping")
    if unknown := sorted(set(data) - known):
        raise ValueError(f"unknown keys in {where}: {', '.join(map(str, unknown))}")
    return data


def _rules(data: object, where: str) -> Rules:
    d = _only(data, {"paths", "globs"}, where)
    for key in ("paths", "globs"):
        if not isinstance(d.get(key, []), list) or not all(isinstance(x, str) for x in d.get(key, [])):
            raise ValueError(f"{where}.{key} must be a list of texts")
    return Rules(tuple(d.get("paths", [])), tuple(d.get("globs", [])))


def parse(data: object) -> Settings:
    top = _only(data, {"include", "exclude", "limits", "split"}, "the settings")
    limits = _only(top.get("limits"), {"max_file_size_bytes", "max_total_files", "max_export_bytes", "max_line_count"}, "limits")
    split = _only(top.get("split"), {"enabled", "max_chars", "strategy"}, "split")
    if split.get("strategy", "heading") not in SPLIT_STRATEGIES:
        raise ValueError(f"split.strategy must be one of {', '.join(SPLIT_STRATEGIES)}")
    return Settings(
        _rules(top.get("include"), "include"), _rules(top.get("exclude"), "exclude"), **{k: positive(limits.get(k), k) for k in ("max_file_size_bytes", "max_total_files", "max_export_bytes", "max_line_count")},
        split=bool(split.get("enabled", False)), split_max_chars=positive(split.get("max_chars"), "split.max_chars") or SPLIT_CHARS, split_strategy=split.get("strategy", "heading"),
    )


def load(root: str) -> Settings:
    """The settings of a folder; the defaults if it has no file of them."""
    import yaml

    file = Path(root) / CONFIG_NAME
    return parse(yaml.safe_load(file.read_text("utf-8"))) if file.exists() else Settings()
