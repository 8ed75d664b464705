"""The settings of a run: read from and written to JSON, or YAML where a reader for it is there, and checked on the way."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: The least and the largest value that a setting may have.
BOUNDS = {"max_source_rows": (1, 2_000_000), "max_training_samples": (1, 5_000_000), "max_validation_samples": (1, 100_000), "eval_ratio": (0.0, 0.5), "replay_ratio": (0.0, 1.0)}


@dataclass
class Recipe:
    name: str
    datasets: list[str]
    validation_datasets: list[str] = field(default_factory=list)
    allowed_tools: list[str] | None = None
    eval_ratio: float = 0.05
    replay_ratio: float | None = None
    seed: int = 42
    max_source_rows: int = 25_000
    max_training_samples: int = 50_000
    max_validation_samples: int = 512

    def __post_init__(self) -> None:
        if not self.name.strip():
            raise ValueError("a recipe needs a name")
        if not self.datasets:
            raise ValueError("a recipe needs datasets")
        for key, (low, high) in BOUNDS.items():
            value = getattr(self, key)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{key} must be from {low} to {high}")
        if both := set(self.datasets) & set(self.validation_datasets):
            raise ValueError(f"used for training and for validation: {sorted(both)}")


def yaml():
    try:
        import yaml as module
    except ImportError as e:
        raise ValueError("no reader for YAML here; use a .json file") from e
    return module


def load_recipe(path: str) -> Recipe:
    """A setting that isn't known is an error."""
    text = Path(path).read_text(encoding="utf-8")
    values = json.loads(text) if path.endswith(".json") else yaml().safe_load(text)
    if not isinstance(values, dict):
        raise ValueError(f"{path} holds no settings")
    if unknown := set(values) - {f.name for f in fields(Recipe)}:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return Recipe(**values)


def save_recipe(recipe: Recipe, path: str) -> None:
    text = json.dumps(asdict(recipe), indent=2) if path.endswith(".json") else yaml().safe_dump(asdict(recipe), sort_keys=False)
    Path(path).write_text(text, encoding="utf-8")
