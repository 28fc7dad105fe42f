"""Settings from a YAML or JSON file, typed and frozen; read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class StageModel:
    provider: str
    model: str
    prompt_version: str = "v1"
    params: dict = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Settings:
    pipeline_version: str = "0"
    max_distance: float = 0.6
    shortlist: int = 5
    models: dict[str, StageModel] = field(default_factory=dict, hash=False)
    raw: dict = field(default_factory=dict, hash=False)

    @classmethod
    def load(cls, path: str) -> Settings:
        text = Path(path).read_text(encoding="utf-8")
        try:
            raw = json.loads(text)
        except ValueError:
            import yaml

            raw = yaml.safe_load(text)
        raw = raw or {}
        match = raw.get("dedup") or {}
        models = {k: StageModel(v["provider"], v["model"], v.get("prompt_version", "v1"), v.get("params") or {}) for k, v in (raw.get("models") or {}).items()}
        return cls(str(raw.get("pipeline_version", "0")), float(match.get("max_distance", 0.6)), int(match.get("shortlist_k", 5)), models, raw)

    def model(self, stage: str) -> StageModel:
        if stage not in self.models:
            raise ValueError(f"no model is configured for stage {stage!r}")
        return self.models[stage]
