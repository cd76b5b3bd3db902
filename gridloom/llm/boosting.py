"""Small gradient-boosted trees for a binary label, trained on the driver and written as SQL."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple | float  # (feature, cut, left, right) or a leaf's value


@dataclass(frozen=True)
class Boosted:
    names: tuple[str, ...]
    base: float
    trees: tuple[Tree, ...]

    def margin(self, value) -> Column:
        """Sum of the trees; ``value(name)`` gives a feature's column."""

        def walk(t: Tree) -> Column:
            if isinstance(t, float):
                return F.lit(t)
            feature, cut, left, right = t
            return F.when(value(self.names[feature]) <= cut, walk(left)).otherwise(walk(right))

        out = F.lit(self.base)
        for t in self.trees:
            out = out + walk(t)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(t: Tree, rows: np.ndarray) -> np.ndarray:
            if isinstance(t, float):
                return np.full(len(rows), t)
            feature, cut, left, right = t
            return np.where(rows[:, feature] <= cut, walk(left, rows), walk(right, rows))

        return self.base + sum((walk(t, x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], rounds: int = 20, depth: int = 3, rate: float = 0.4, penalty: float = 1.0, least: int = 5) -> Boosted:
    """Newton boosting of the logistic loss; splits lie between all different values of a feature."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    margin, trees = np.full(len(y), base), []
    values, codes = zip(*(np.unique(x[:, f], return_inverse=True) for f in range(x.shape[1])), strict=True) if len(y) else ((), ())

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int) -> Tree:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        best = (1e-6, 0, 0)
        for f in range(x.shape[1]) if left and len(rows) >= 2 * least else ():
            c, m = codes[f][rows], len(values[f])
            if m < 2:
                continue
            cg, ch, cn = (np.cumsum(np.bincount(c, w, m))[:-1] for w in (g[rows], h[rows], None))
            gain = cg**2 / (ch + penalty) + (total_g - cg) ** 2 / (total_h - ch + penalty) - total_g**2 / (total_h + penalty)
            gain[(cn < least) | (len(rows) - cn < least)] = -1
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (float(gain[at]), f, at)
        if best[0] <= 1e-6:
            return float(-rate * total_g / (total_h + penalty))
        _, f, at = best
        low = codes[f][rows] <= at
        return (f, float((values[f][at] + values[f][at + 1]) / 2), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), p - y, p * (1 - p), depth)
        trees.append(tree)
        margin = margin + Boosted(names, 0.0, (tree,)).predict(x)
    return Boosted(names, base, tuple(trees))
