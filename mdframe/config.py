"""Settings from a YAML file, with types checked; unknown keys are ignored."""

from __future__ import annotations

import os

import yaml

# Known settings, their types and allowed values.
SETTINGS: dict[str, tuple[type, tuple | None]] = {
    "format": (str, ("json", "csv", "table")), "compact": (bool, None), "rows": (int, None), "columns": (str, None), "trim": (str, None),
    "titleFormat": (str, ("none", "upper", "capitalize", "camel-case", "pascal-case")), "normalize": (bool, None), "color": (bool, None),
    "colors": (str, None), "depth": (int, None), "hidden": (bool, None), "ignore": (bool, None), "dir": (str, None),
}


class ConfigError(ValueError):
    pass


def config_path() -> str:
    base = os.environ.get("XDG_CONFIG_HOME") or os.path.join(os.path.expanduser("~"), ".config")
    return os.path.join(base, "mdframe", "config.yaml")


def load_config(path: str | None = None) -> dict:
    path = path or config_path()
    if not os.path.isfile(path):
        return {}
    with open(path, encoding="utf-8") as f:
        try:
            found = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise ConfigError(f"Invalid config: {e}") from e
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ConfigError("Invalid config: must be a mapping")
    out = {}
    for key, value in found.items():
        if key not in SETTINGS:
            continue
        kind, allowed = SETTINGS[key]
        if not isinstance(value, kind) or kind is int and isinstance(value, bool):
            raise ConfigError(f"Invalid config: {key} must be of type {kind.__name__}")
        if allowed and value not in allowed:
            raise ConfigError(f"Invalid config: {key} must be one of {', '.join(allowed)}")
        out[key] = value
    return out


def header_color(flag: bool | None, config: dict) -> str | None:
    """The colour code of headers: a flag, then ``MDFRAME_COLORS``, then ``LS_COLORS`` (directories), then the settings."""
    if flag is False or flag is None and config.get("color") is False:
        return None
    for value in (os.environ.get("MDFRAME_COLORS"), next((x[3:] for x in os.environ.get("LS_COLORS", "").split(":") if x.startswith("di=")), None), config.get("colors")):
        if value:
            return value
    return "1;36" if flag else None
