"""Settings: YAML with defaults, dotted paths, the environment. A driver-side object, no relation."""

from __future__ import annotations

import copy
import os
from pathlib import Path
from typing import Any

import yaml

#: Used where no file is given or the file is absent. Fixed values.
DEFAULTS = {
    "application": {"name": "tallysheet", "debug": False, "offline_mode": True},
    "ocr": {"processing": {"aggregation_method": "weighted_vote", "symbol_correction": True, "confidence_threshold": 0.7}, "quality_thresholds": {"min_confidence": 0.5, "min_character_count": 10, "max_processing_time": 120}},
    "mock": {},
}
REQUIRED = ("application",)


class Settings:
    """S7 to S11. Invalid YAML is an error; a missing file gives the defaults."""

    def __init__(self, path: str | None = None):
        self.path = path
        self.values = self._load()
        missing = [s for s in REQUIRED if s not in self.values]
        if missing:
            raise ValueError(f"missing sections: {', '.join(missing)}")

    def _load(self) -> dict:
        if not self.path or not Path(self.path).exists():
            return copy.deepcopy(DEFAULTS)
        try:
            found = yaml.safe_load(Path(self.path).read_text())
        except yaml.YAMLError as e:
            raise ValueError(f"{self.path} is no valid YAML: {e}") from e
        return found or {}

    def get(self, dotted: str, default: Any = None) -> Any:
        at: Any = self.values
        for key in dotted.split("."):
            if not isinstance(at, dict) or key not in at:
                return default
            at = at[key]
        return at

    def set(self, dotted: str, value: Any) -> None:
        *path, last = dotted.split(".")
        at = self.values
        for key in path:
            if not isinstance(at.get(key), dict):
                at[key] = {}
            at = at[key]
        at[last] = value

    def env(self, name: str, default: str | None = None) -> str | None:
        return os.environ.get(name, default)

    def reload(self) -> Settings:
        self.values = self._load()
        return self

    @property
    def debug(self) -> bool:
        return bool(self.get("application.debug", False))

    @property
    def offline(self) -> bool:
        return bool(self.get("application.offline_mode", True))

    def mock(self, service: str) -> bool:
        """Whether a service is to be replaced by a stand-in: always when offline, else by its setting."""
        return self.offline or bool(self.get(f"mock.{service}", False))

    @property
    def ocr(self) -> dict:
        return self.get("ocr", {})
