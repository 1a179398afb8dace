"""Settings from the environment, or from a .env file beside the run."""

from __future__ import annotations

import math
import os
from collections.abc import Callable

from gridloom.errors import ConfigurationError


def load_env_file(path: str = ".env") -> None:
    """NAME=value lines into the environment; what is set already stays, a missing file is none."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError:
        return
    for line in lines:
        name, sign, value = line.removeprefix("export ").partition("=")
        if sign and name.strip() and not name.lstrip().startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))


def default_model() -> str:
    load_env_file()
    if model := os.environ.get("DEFAULT_MODEL"):
        return model
    raise ConfigurationError("DEFAULT_MODEL is not set")


def _number(name: str, kind: Callable[[str], float], fits: Callable[[float], bool], what: str) -> float | None:
    raw = (os.environ.get(name) or "").strip()
    if not raw:
        return None
    try:
        value = kind(raw)
    except ValueError:
        value = math.nan
    if not (math.isfinite(value) and fits(value)):
        raise ConfigurationError(f"{name} must be a {what}.")
    return value


def positive_number(name: str) -> float | None:
    """An optional setting like a time-out."""
    return _number(name, float, lambda v: v > 0, "positive number")


def whole_number(name: str) -> int | None:
    """An optional setting like a number of retries."""
    return _number(name, int, lambda v: v >= 0, "non-negative integer")
