"""Run configuration from a YAML file."""

from __future__ import annotations

from pathlib import Path


def load(*candidates: str) -> dict:
    """The first of these files that exists; empty if none does or it is empty."""
    import yaml

    for c in candidates:
        if Path(c).is_file():
            return yaml.safe_load(Path(c).read_text()) or {}
    return {}


def get(config: dict, dotted: str, default=None):
    """A value by dotted key; a null counts as absent."""
    for part in dotted.split("."):
        if not isinstance(config, dict) or config.get(part) is None:
            return default
        config = config[part]
    return config
