"""Settings as a nested mapping with dotted names; a YAML or JSON file over the defaults."""

from __future__ import annotations

import json
import os
from typing import Any

# The services' limits and lists.
DEFAULTS: dict[str, Any] = {
    "zenodo": {"communities": ["es-replication-repository", "restud-replication", "ej-replication-repository", "pemj"], "page_size": 100},
    "osf": {"page_size": 100, "delay": 0.5},
    "researchbox": {"delay": 1.0, "batch": 20},
    "http": {"timeout": 30, "retries": 3, "delay": 1.0},
    "storage": {"min_free_gb": 5, "max_temp_gb": 50, "keep_archives": False, "retry_attempts": 2},
    "analysis": {"languages": ["R", "Python", "Stata"]},
}


class Settings:
    def __init__(self, values: dict[str, Any] | None = None) -> None:
        self.values = json.loads(json.dumps(DEFAULTS))
        self._merge(self.values, values or {})

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                import yaml

                return cls(yaml.safe_load(f))
            return cls(json.load(f))

    @staticmethod
    def _merge(into: dict, new: dict) -> None:
        for k, v in new.items():
            if isinstance(v, dict) and isinstance(into.get(k), dict):
                Settings._merge(into[k], v)
            else:
                into[k] = v

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    @staticmethod
    def token(service: str) -> str | None:
        return os.environ.get(f"{service.upper()}_TOKEN")
