"""How many rows to select and how many clusters to try: budgets, stop rule, integer search."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F


def budget_grid(n: int, max_points: int = 700, factor: float = 5.0, min_points: int = 20) -> list[int]:
    """Selection sizes worth trying for n rows."""
    if n <= 0:
        return []
    if n < 200:
        top = min(max_points, int(factor * math.sqrt(n)), n, max(3, math.ceil(n / 2)))
    elif n < 10_000:
        top = min(max_points, max(10, math.ceil(0.10 * n)), 300, n)
    elif n < 50_000:
        top = min(max_points, max(500, math.ceil(0.05 * n)), 500, n)
    else:
        top = min(max_points, max(500, math.ceil(0.02 * n)), 700, n)
    low = min(min_points, max(1, math.ceil(0.01 * n)), n)
    if top <= low:
        return [low]
    if n < 500:
        return list(range(low, top + 1))
    # Steps widen with the size; each segment goes on from where the one before stopped.
    segments = [(100, 10), (200, 20), (top, 25)] if n < 10_000 else [(100, 10), (300, 25), (top, 50 if n < 50_000 else 100)]
    out, step = [low], 10
    for end, width in segments:
        if out[-1] < min(end, top):
            out += range(out[-1] + width, min(end, top) + 1, width)
            step = width
    if top - out[-1] >= max(1, math.ceil(0.5 * step)):
        out.append(top)
    return out


@dataclass
class Budget:
    size: int
    gap: float
    area: float | None = None


def marginal_gain(table: DataFrame, value: str, order: str) -> DataFrame:
    """(order, gain): the share by which the value fell since the row before; NULL for the first row and after 0."""
    prev = F.lag(value).over(Window.orderBy(order))
    return table.select(order, F.try_divide(prev - F.col(value), prev).alias("gain"))


def look_ahead(table: DataFrame, value: str, order: str, steps: tuple[int, ...] = (1, 2)) -> DataFrame:
    """(order, g1, g2, ...): the share by which the value falls over so many rows to come; 0 at the end and where the value is 0."""
    w = Window.orderBy(order)
    return table.select(order, *[F.coalesce(F.try_divide(F.col(value) - F.lead(value, k).over(w), F.col(value)), F.lit(0.0)).alias(f"g{k}") for k in steps])


@dataclass
class Decision:
    """A budget with the gains of the next one and two, and whether they are too small to go on."""

    budget: Budget
    gains: tuple[float, float]
    required: tuple[float, float]
    accepted: bool


def decide(found: list[Budget], n: int, area: float = 0.85) -> list[Decision]:
    """The stop rule for each budget, in order of size. Budgets are a few dozen, so this is the driver's work."""
    out = []
    for i, b in enumerate(found):
        gains, required = [], []
        for ahead in (1, 2):
            later = found[i + ahead] if i + ahead < len(found) else None
            gains.append(0.0 if later is None or not b.gap else (b.gap - later.gap) / b.gap)
            required.append(0.05 * ahead if later is None else (0.05 if n < 100 else 0.005) * (later.size - b.size))
        enough = (b.area is None or b.area >= area) and (n >= 100 or b.size >= max(3, math.ceil(0.05 * n)))
        out.append(Decision(b, tuple(gains), tuple(required), enough and all(g < r for g, r in zip(gains, required, strict=True))))
    return out


def stop_at(found: list[Budget], n: int, area: float = 0.85) -> Budget:
    """The first budget after which more rows bring little, else the one of the smallest gap."""
    for d in decide(found, n, area):
        if d.accepted:
            return d.budget
    return min([b for b in found if b.area is None or b.area >= area] or found, key=lambda b: b.gap)


def auto_budget(n: int, measure: Callable[[int], Budget], grid: list[int] | None = None) -> tuple[Budget, list[Budget]]:
    """Measure budgets in order; from 10 000 rows on stop once one with both successors known is accepted."""
    found: list[Budget] = []
    for size in grid or budget_grid(n):
        found.append(measure(size))
        if n >= 10_000 and len(found) >= 3 and decide(found, n)[-3].accepted:
            return found[-3], found
    return stop_at(found, n), found


# Integer search by a Gaussian process


def search_budget(space: int, grid: int = 10, centers: int = 1, radius: int = 2, fraction: float = 0.20, most: int = 30) -> tuple[int, int]:
    """How many values to look at first, and how many to choose after that."""
    total = max(1, min(max(grid + centers * (2 * radius + 1), math.ceil(fraction * space)), most, space))
    first = total if total <= 1 else max(1, total // 2)
    return first, total - first


def matern(a: np.ndarray, b: np.ndarray, scale: float) -> np.ndarray:
    d = math.sqrt(5) * np.abs(a[:, None] - b[None]) / scale
    return (1 + d + d * d / 3) * np.exp(-d)


def expected_improvement(seen: np.ndarray, value: np.ndarray, ask: np.ndarray, xi: float = 0.01, noise: float = 1e-4) -> np.ndarray:
    """Of a Matern-5/2 process with white noise; the length scale of the best likelihood of a few."""
    x0, span = seen.min(), max(np.ptp(np.concatenate((seen, ask))), 1)
    s, a = (seen - x0) / span, (ask - x0) / span
    y0, y1 = value.mean(), value.std() or 1.0
    y = (value - y0) / y1
    best = None
    for scale in (0.05, 0.1, 0.2, 0.4, 0.8):
        k = matern(s, s, scale) + noise * np.eye(len(s))
        c = np.linalg.cholesky(k)
        w = np.linalg.solve(c.T, np.linalg.solve(c, y))
        ll = -0.5 * y @ w - np.log(np.diag(c)).sum()
        if best is None or ll > best[0]:
            best = (ll, scale, c, w)
    _, scale, c, w = best
    k = matern(a, s, scale)
    mean, v = k @ w, np.linalg.solve(c, k.T)
    sd = np.sqrt(np.maximum(1 - (v * v).sum(0), 1e-12))
    gain = mean - y.max() - xi
    z = gain / sd
    cdf = 0.5 * (1 + np.array([math.erf(t / math.sqrt(2)) for t in z]))
    return gain * cdf + sd * np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


@dataclass
class IntegerSearch:
    """Maximise a costly function of an integer: an even grid first, all at once, then one by one where improvement is expected."""

    objective: Callable[[list[int]], list[float]]
    low: int
    high: int
    budget: tuple[int, int] | None = None
    seen: dict[int, float] = field(default_factory=dict)

    def run(self) -> int:
        space = list(range(self.low, self.high + 1))
        first, rest = self.budget or search_budget(len(space))
        self._look(space if len(space) <= first else sorted({space[round(float(x))] for x in np.linspace(0, len(space) - 1, first)}))
        for _ in range(rest):
            ask = [k for k in space if k not in self.seen]
            if not ask:
                break
            known = sorted(k for k in self.seen if math.isfinite(self.seen[k]))
            if len(known) < 2:
                self._look(ask[:1])
                continue
            ei = expected_improvement(np.array(known, float), np.array([self.seen[k] for k in known]), np.array(ask, float))
            self._look([ask[int(ei.argmax())]])
        return max(sorted(self.seen), key=lambda k: self.seen[k])

    def _look(self, ks: list[int]) -> None:
        if new := [k for k in ks if k not in self.seen]:
            self.seen.update(zip(new, self.objective(new), strict=True))
