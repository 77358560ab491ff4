"""The settings of a study as one value: defaults, a quick profile for trials, and a snapshot to keep with results."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace


@dataclass(frozen=True)
class Study:
    """Settings of all parts of a study; names that are not among these can't be set."""

    pool: int | None = 2000
    folds: int = 5
    seed: int = 42
    cuts: tuple[float, float] = (1 / 3, 2 / 3)
    pair_scope: str = "global"
    clusters: int = 5
    within_label: bool = True
    budget_mode: str = "exact"
    bound_sizes: tuple[int, ...] = (10, 14, 18)
    bound_ratios: tuple[float, ...] = (0.2, 0.4)
    bound_repeats: int = 20
    budgets: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3, 0.5)
    random_seeds: int = 30
    curve: tuple[float, ...] = (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
    published_seeds: tuple[int, ...] = (42, 43, 44, 45, 46)
    alpha: float = 0.05
    generated: bool = False
    quick: bool = False
    more: dict = field(default_factory=dict)

    def changed(self, **settings) -> Study:
        """The study with other settings; an unknown name is an error."""
        if unknown := set(settings) - set(asdict(self)):
            raise ValueError(f"unknown settings {sorted(unknown)}")
        return replace(self, **settings)


#: Small numbers of everything, for trials.
QUICK = {"pool": 300, "folds": 3, "bound_sizes": (10, 12), "bound_repeats": 3, "budgets": (0.1, 0.3), "random_seeds": 3, "curve": (0.1, 0.3, 0.5, 1.0), "published_seeds": (42,), "quick": True}


def quick(study: Study = Study()) -> Study:
    return study.changed(**QUICK)


def snapshot(study: Study, **run) -> tuple[str, str]:
    """The settings in effect with what else the run tells, as text, and a fingerprint of the settings alone."""
    own = asdict(study)
    text = json.dumps({"settings": own, "run": run}, sort_keys=True, default=str)
    return text, hashlib.sha256(json.dumps(own, sort_keys=True, default=str).encode()).hexdigest()
