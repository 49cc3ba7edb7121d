"""Settings of models and processing, read from JSON (YAML, if a reader is installed)."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any


@dataclass
class ModelSettings:
    device: str = "cpu"
    batch_size: int = 1
    threshold: float = 0.5


@dataclass
class ProcessingSettings:
    tile_size: int = 512
    overlap: int = 64
    num_workers: int = 4


@dataclass
class Config:
    model: ModelSettings = field(default_factory=ModelSettings)
    processing: ProcessingSettings = field(default_factory=ProcessingSettings)

    def update(self, **values: Any) -> Config:
        """Set by name; the model's settings come first, names of neither are ignored."""
        for name, value in values.items():
            for part in (self.model, self.processing):
                if name in {f.name for f in fields(part)}:
                    setattr(part, name, value)
                    break
        return self

    def to_file(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(asdict(self), f, indent=2)

    @classmethod
    def from_file(cls, path: str) -> Config:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as error:
                raise ValueError("no YAML reader is installed: write the settings as JSON") from error
            given = yaml.safe_load(text)
        else:
            given = json.loads(text)
        return cls(ModelSettings(**given.get("model", {})), ProcessingSettings(**given.get("processing", {})))
