"""The review settings of a YAML file: found by an environment variable or in three places, merged over defaults."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Any

#: The settings and their defaults.
DEFAULTS: dict[str, dict[str, Any]] = {
    "provider": {"name": "", "base_url": "", "api_key": "", "model": ""},
    "review": {"agents": [], "severity_threshold": "low", "max_findings": 50},
    "ignore": {"paths": [], "rules": []},
    "quality_gate": {"min_score": 0, "max_critical": 0, "max_high": 0, "block_on_fail": False},
    "rules": {"enabled": True, "complexity_threshold": 10, "function_length_threshold": 50, "nesting_depth_threshold": 4},
}
VARIABLE, NAME = "LINTLAKE_CONFIG_FILE", "lintlake"


def find_config(folder: str = ".") -> Path | None:
    """The file named by the environment, else the first of the usual ones that is there."""
    named = os.environ.get(VARIABLE)
    places = [Path(named)] if named else []
    places += [Path(folder, f"{NAME}.yaml"), Path(folder, f".{NAME}.yaml"), Path.home() / f".{NAME}" / "config.yaml"]
    return next((p for p in places if p.is_file()), None)


def load_config(folder: str = ".") -> dict[str, dict[str, Any]] | None:
    """The settings over their defaults; None without a file, without a YAML reader, or if the file is malformed."""
    path = find_config(folder)
    if path is None:
        return None
    try:
        import yaml
    except ImportError:
        return None
    try:
        raw = yaml.safe_load(path.read_text())
    except (OSError, ValueError, yaml.YAMLError):
        return None
    if not isinstance(raw, dict):
        return None
    out = {}
    for part, defaults in DEFAULTS.items():
        given = raw.get(part, {})
        if not isinstance(given, dict) or any(k in given and not _fits(given[k], v) for k, v in defaults.items()):
            return None
        out[part] = {k: given.get(k, v) for k, v in defaults.items()}
    return out


def _fits(value: Any, default: Any) -> bool:
    """Whether a value has the type of the default; whole numbers aren't booleans."""
    if isinstance(default, list):
        return isinstance(value, list) and all(isinstance(x, str) for x in value)
    return type(value) is type(default)
