"""Small gradient-boosted trees: fitted on a bounded table, then written as one SQL expression."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Leaf:
    value: float

    def sql(self) -> str:
        return f"{self.value!r}D"

    def of(self, x: dict) -> float:
        return self.value


@dataclass(frozen=True)
class Cut:
    feature: str
    at: float
    low: object
    high: object

    def sql(self) -> str:
        return f"IF({self.feature} <= {self.at!r}D, {self.low.sql()}, {self.high.sql()})"

    def of(self, x: dict) -> float:
        return (self.low if x[self.feature] <= self.at else self.high).of(x)


@dataclass(frozen=True)
class Boosted:
    """Log-odds are base plus the trees' sum; threshold is on the calibrated probability."""

    base: float
    trees: tuple
    slope: float
    shift: float
    threshold: float

    def raw(self, x: dict) -> float:
        return self.base + sum(t.of(x) for t in self.trees)

    def probability(self, x: dict) -> float:
        import math

        return 1 / (1 + math.exp(-(self.slope * self.raw(x) + self.shift)))

    def sql(self) -> str:
        """The calibrated probability over columns named as the features."""
        total = " + ".join([f"{self.base!r}D", *(t.sql() for t in self.trees)])
        return f"(1D / (1D + exp(-({self.slope!r}D * ({total}) + {self.shift!r}D))))"


def grow(x, names, gradient, hessian, rows, depth: int, rate: float, ridge: float = 1.0):
    """A tree by exact splits on the second-order gain."""
    import numpy as np

    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth:
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for at in (values[1:] + values[:-1]) / 2:
                low = x[rows, j] <= at
                gl, hl = gradient[rows][low].sum(), hessian[rows][low].sum()
                gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                if gain > best[0]:
                    best = (gain, j, float(at))
    _, j, at = best
    if j is None:
        return Leaf(float(rate * g / (h + ridge)))
    low = rows[x[rows, j] <= at]
    high = rows[x[rows, j] > at]
    return Cut(names[j], at, *(grow(x, names, gradient, hessian, r, depth - 1, rate, ridge) for r in (low, high)))


def logistic(x, y, ridge: float = 1.0, steps: int = 100):
    """Weights of a logistic regression. Steps are bounded, so that it settles where the data can be told apart."""
    import numpy as np

    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * w)
        w += step / max(1.0, float(np.abs(step).max()))
    return w


def fit(rows: list[dict], labels: list[int], trees: int = 12, depth: int = 3, rate: float = 0.4, precision: float = 0.95) -> Boosted:
    """Trees on the even rows; the odd rows calibrate the probability and set the threshold: the lowest whose precision there holds."""
    import numpy as np

    names = sorted(rows[0])
    x, y = np.array([[float(r[n]) for n in names] for r in rows]), np.array(labels, float)
    even, odd = np.arange(len(y)) % 2 == 0, np.arange(len(y)) % 2 == 1
    xe, ye = x[even], y[even]
    base = float(np.log((ye.mean() + 1e-3) / (1 - ye.mean() + 1e-3)))
    f, made = np.full(len(ye), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        tree = grow(xe, names, ye - p, p * (1 - p), np.arange(len(ye)), depth, rate)
        made.append(tree)
        f += np.array([tree.of(dict(zip(names, r, strict=True))) for r in xe])
    z = np.array([base + sum(t.of(dict(zip(names, r, strict=True))) for t in made) for r in x[odd]])
    a = np.stack([z, np.ones_like(z)], 1)
    w = logistic(a, y[odd])
    p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
    good = [float(t) for t in np.unique(p) if y[odd][p >= t].mean() >= precision]
    return Boosted(base, tuple(made), float(w[0]), float(w[1]), max(0.5, min(good, default=1.0) - 1e-9))
