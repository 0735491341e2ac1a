"""Parameters with defaults, validated on the driver before any job starts."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping


@dataclasses.dataclass(frozen=True)
class ScoringConfig:
    lambda1: float = 0.60
    lambda2: float = 0.25
    lambda3: float = 0.15
    confidence_level: float = 0.90
    default_budget_usd: float = 100_000.0
    cost_per_inspection: float = 500.0
    budget_scenarios: tuple[float, ...] = (100_000.0, 500_000.0, 1_000_000.0)
    initial_labeled_fraction: float = 0.10
    batch_size: int = 500
    n_rounds: int = 10
    retrain_threshold: int = 500
    epsilon: float = 1e-6

    def __post_init__(self) -> None:
        if not 0.0 < self.confidence_level < 1.0:
            raise ValueError(f"confidence_level must lie strictly in (0, 1): {self.confidence_level}")
        if not 0.0 < self.initial_labeled_fraction <= 1.0:
            raise ValueError("initial_labeled_fraction must lie in (0, 1]")
        if self.batch_size < 1 or self.n_rounds < 0 or self.retrain_threshold < 1:
            raise ValueError("batch_size, n_rounds and retrain_threshold must be positive")
        if self.cost_per_inspection < 0 or self.default_budget_usd < 0:
            raise ValueError("budgets and costs must not be negative")

    @classmethod
    def from_mapping(cls, values: Mapping | None) -> "ScoringConfig":
        """Build from a (possibly nested) mapping; missing keys keep their defaults."""
        names = {f.name for f in dataclasses.fields(cls)}
        flat: dict = {}
        for key, value in (values or {}).items():
            items = value.items() if isinstance(value, Mapping) else [(key, value)]
            flat.update({k: v for k, v in items if k in names})
        return cls(**flat)

    @classmethod
    def from_json(cls, text: str) -> "ScoringConfig":
        return cls.from_mapping(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str) -> "ScoringConfig":
        """Build from a YAML document; an empty one gives the defaults. Needs PyYAML, which is no dependency otherwise."""
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("YAML configuration needs the package PyYAML; JSON needs none") from missing
        values = yaml.safe_load(text)
        if values is not None and not isinstance(values, Mapping):
            raise ValueError("the configuration must be a mapping")
        return cls.from_mapping(values)


@dataclasses.dataclass(frozen=True)
class TrainConfig:
    max_depth: int = 6
    learning_rate: float = 0.05
    n_estimators: int = 100
    subsample: float = 0.8
    n_trials: int = 20
    patience: int = 30
    parallel_trials: int = 4
    search_seconds: float = 3600.0
    forest_trees: int = 300
    forest_depth: int = 10
    forest_min_leaf: int = 5
    logistic_c: float = 1.0
    logistic_iterations: int = 1000
    min_relative_improvement: float = 0.10
    max_split_gap: float = 0.15
    seed: int = 42
