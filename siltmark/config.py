"""Experiment settings as frozen dataclasses, checked before any job starts."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

# The closed set of selection arms and their display names.
ARMS = ("A_random", "B_pca", "C_mi", "D_qubo", "E_lasso", "F_mrmr", "Z_full")
ARM_NAMES = {
    "A_random": "Random",
    "B_pca": "PCA",
    "C_mi": "MI",
    "D_qubo": "QUBO",
    "E_lasso": "LASSO",
    "F_mrmr": "mRMR",
}

# Hazard weights per class, the clean classes, and the index bands.
HAZARD_WEIGHTS = {"cigarette": 3.0, "bottle": 1.0, "can": 1.0, "carton": 0.8, "cup": 0.8, "lid": 0.5}
CLEAN_CLASSES = ("bottle", "can", "carton", "cup", "lid")
BANDS = ((50, "Good"), (100, "Moderate"), (200, "Unhealthy"), (300, "Very Unhealthy"), (500, "Hazardous"))

# Window the training range of a feature is scaled into.
ANGLE_WINDOW = (0.05, 1.52)


class ConfigError(ValueError):
    """A setting is outside its range or contradicts another one."""


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


@dataclass(frozen=True)
class ExperimentConfig:
    """All settings of one experiment; construction fails on the first bad value."""

    classes: tuple[str, ...]
    seed: int = 42
    min_images_per_class: int = 50
    pca_components: int = 50
    k: int = 8
    mi_bins: int = 16
    sa_sweeps: int = 1000
    sa_reads: int = 10
    max_train_rows: int = 400
    test_fraction: float = 0.25
    tune_rbf: bool = True
    max_qsvm_features: int = 20
    n_repeats: int = 25
    arms: tuple[str, ...] = field(default=ARMS)
    early_stop: bool = False

    def __post_init__(self) -> None:
        _require(self.seed >= 0, "seed must be >= 0")
        _require(len(self.classes) >= 2, "at least two classes are needed")
        _require(len(set(self.classes)) == len(self.classes), "classes must be unique")
        for name in self.classes:
            plain = bool(name) and name == name.strip() and name not in (".", "..")
            _require(plain and not set(name) & set('/\\<>:"|?*'), f"class is not a plain folder name: {name!r}")
        for name, low, high in (
            ("min_images_per_class", 10, None),
            ("pca_components", 10, 200),
            ("k", 2, 50),
            ("mi_bins", 4, 32),
            ("sa_sweeps", 1000, None),
            ("sa_reads", 5, 50),
            ("max_train_rows", 50, None),
            ("test_fraction", 0.1, 0.5),
            ("max_qsvm_features", 1, 30),
            ("n_repeats", 5, 100),
        ):
            value = getattr(self, name)
            _require(value >= low and (high is None or value <= high), f"{name} out of range: {value}")
        _require(self.k <= self.pca_components, "k exceeds pca_components")
        _require(self.k <= self.max_qsvm_features, "k exceeds max_qsvm_features")
        _require(len(self.arms) >= 1 and len(set(self.arms)) == len(self.arms), "arms must be unique")
        _require(set(self.arms) <= set(ARMS), f"unknown arms: {sorted(set(self.arms) - set(ARMS))}")
        _require(not self.early_stop or self.n_repeats >= 10, "early_stop needs n_repeats >= 10")

    @property
    def reps(self) -> range:
        return range(self.n_repeats)

    def as_dict(self) -> dict[str, Any]:
        return dataclasses.asdict(self)


def flatten(config: dict[str, Any], prefix: str = "") -> list[tuple[str, str]]:
    """Nested settings as (path, canonical JSON value); a list is one value, so order counts."""
    rows: list[tuple[str, str]] = []
    for key in sorted(config):
        path = f"{prefix}{key}"
        if isinstance(config[key], dict):
            rows += flatten(config[key], path + ".")
        else:
            rows.append((path, json.dumps(config[key], sort_keys=True)))
    return rows
