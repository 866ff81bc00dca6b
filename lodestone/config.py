"""Typed options with their ranges; an option outside its range takes its default, with a warning."""

from __future__ import annotations

import logging
from dataclasses import dataclass, fields

log = logging.getLogger("lodestone")


def option(default, low=None, high=None, among=None):
    from dataclasses import field

    return field(default=default, metadata={"low": low, "high": high, "among": among})


class Options:
    def __post_init__(self):
        for f in fields(self):
            v, m = getattr(self, f.name), f.metadata
            bad = v is not None and ((m.get("among") and v not in m["among"]) or (m.get("low") is not None and (isinstance(v, (bool, str)) or v < m["low"])) or (m.get("high") is not None and (isinstance(v, (bool, str)) or v > m["high"])))
            if isinstance(f.default, bool) and not isinstance(v, bool):
                bad = True
            if bad:
                log.warning("%s = %r is out of range; %r is used", f.name, v, f.default)
                object.__setattr__(self, f.name, f.default)


@dataclass(frozen=True)
class ClusterOptions(Options):
    """Options of the selection workflow."""

    name: str | None = None
    y: str | None = None
    ignore: tuple[str, ...] = ()
    n_points: int | None = option(None, 0)
    mode: str = option("representative", among=("representative", "exploratory", "natural"))
    categorical: str = option("onehot", among=("onehot", "numbers"))
    auto_fill: bool = option(True)
    impute: str = option("knn", among=("knn", "mean"))
    #: With more rows that have gaps than this, means fill them: nearest rows cost (rows with gaps) x (rows).
    impute_rows: int = option(200_000, 0)
    evaluate: bool = option(False)
    missing: float = option(0.30, 0.0, 1.0)
    near_constant: float = option(0.98, 0.5, 1.0)
    correlation: float = option(0.95, 0.0, 1.0)
    pca_columns: int = option(80, 2)
    pca_target: float = option(0.95, 0.5, 1.0)
    pca_minimum: float = option(0.85, 0.0, 1.0)
    max_points: int = option(700, 1)
    min_points: int = option(20, 1)
    coverage_sample: int = option(10_000, 10)
    families: tuple[str, ...] = ("kmeans", "gmm", "density")
    max_clusters: int | None = option(None, 2)
    seed: int = option(0)


@dataclass(frozen=True)
class LearnOptions(Options):
    """Options of an active-learning round."""

    y: str = "y"
    n_exps: int = option(10, 1)
    mode: str = option("auto", among=("auto", "model", "hit"))
    objective: str | None = option("max", among=("max", "min"))
    alpha: float | None = option(None, 0.0, 1.0)
    tolerance: str = option("medium", among=("tight", "medium", "wide"))
    patience: int = option(2, 1)
    ignore: tuple[str, ...] = ()

    @property
    def delta(self) -> float:
        return {"tight": 0.01, "medium": 0.05, "wide": 0.10}[self.tolerance]
