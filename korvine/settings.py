"""Settings of a run: a flat YAML or JSON file; names that are no setting are passed over."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Settings:
    min_freq: int = 2
    max_vocab_size: int = 30_000
    max_length: int = 512
    truncation: str = "tail"
    padding: str = "right"
    slice_type: str = "backward"
    window_size: int = 15
    num_slices: int = 6
    slice_length: int = 256
    threshold: float = 0.65
    pattern_file: str = ""

    @staticmethod
    def load(text: str) -> Settings:
        try:
            import yaml

            held = yaml.safe_load(text) or {}
        except ImportError:
            held = json.loads(text or "{}")
        names = {f.name for f in fields(Settings)}
        return Settings(**{k: v for k, v in held.items() if k in names})

    def dump(self) -> str:
        return json.dumps(asdict(self), indent=1)
