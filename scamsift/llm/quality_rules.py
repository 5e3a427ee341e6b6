"""Quality rules: base limits, then gradient-boosted trees over document statistics.

The trees are grown on histograms with the logistic loss. A feature may carry a monotonic
constraint: a split that would order its children the wrong way is not taken, and the
middle of the two values bounds everything below, so the score is monotonic in that
feature over the whole tree. All trees are flattened into four numpy arrays; scoring walks
every row through every tree at once, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import annotate
from .labelled import sample
from .text_stats import BASE, FEATURES, features, statistics

#: More of these never raises the score.
FALLING = ("symbol_share", "symbols_per_word", "bang_per_word", "repeat_share", "dup_line_share")


@dataclass(frozen=True)
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray  # of the left child; the right one follows it; a leaf is its own child
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(f < 0, at, self.child[at] + (x[rows, np.maximum(f, 0)] > self.threshold[at]))
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def grow(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 5) -> Trees:
    """Boosted trees for labels 0 and 1. ``signs``: -1, 0 or 1 a feature. One class only, or no rows: a constant score."""
    flat: list[tuple[int, float, int, float]] = []
    roots: list[int] = []
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.array([-1]), np.zeros(1), np.zeros(1, int), np.zeros(1), np.array([0]), 0, start)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    width = bins + 1
    spread = codes + np.arange(x.shape[1]) * width
    margin = np.full(len(y), start)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def build(at: int, rows: np.ndarray, grad: np.ndarray, hess: np.ndarray, level: int, low: float, high: float) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = leaf(g, h, low, high)
        best = None
        if level < depth and len(rows) >= 2 * least:
            index, size = spread[rows].ravel(), width * x.shape[1]
            shape = (x.shape[1], width)
            each = x.shape[1]
            gs = np.bincount(index, weights=np.repeat(grad[rows], each), minlength=size).reshape(shape).cumsum(axis=1)[:, :-1]
            hs = np.bincount(index, weights=np.repeat(hess[rows], each), minlength=size).reshape(shape).cumsum(axis=1)[:, :-1]
            ns = np.bincount(index, minlength=size).reshape(shape).cumsum(axis=1)[:, :-1]
            left, right = np.clip(-gs / (hs + ridge), low, high), np.clip(-(g - gs) / (h - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            fine = (ns >= least) & (len(rows) - ns >= least) & ((right - left) * signs[:, None] >= 0)
            for j, c in enumerate(cuts):
                fine[j, len(c) :] = False
            gain = np.where(fine, gain, -np.inf)
            j, k = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[j, k] > 1e-6:
                best = (int(j), int(k), float(left[j, k]), float(right[j, k]))
        if best is None:
            flat[at] = (-1, 0.0, at, rate * own)
            margin[rows] += rate * own
            return
        j, k, a, b = best
        child = len(flat)
        flat.extend([(-1, 0.0, child, 0.0), (-1, 0.0, child + 1, 0.0)])
        flat[at] = (j, float(cuts[j][k]), child, 0.0)
        goes = codes[rows, j] <= k
        mid = (a + b) / 2
        lows, highs = ((low, mid), (mid, high)) if signs[j] > 0 else ((mid, high), (low, mid)) if signs[j] < 0 else ((low, high), (low, high))
        build(child, rows[goes], grad, hess, level + 1, *lows)
        build(child + 1, rows[~goes], grad, hess, level + 1, *highs)

    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(len(flat))
        flat.append((-1, 0.0, 0, 0.0))
        build(roots[-1], np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf)
    f, t, c, v = map(np.array, zip(*flat, strict=True))
    return Trees(f, t, c, v, np.array(roots), depth, start)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, **options) -> Trees:
    """Trees fitted on at most ``max_rows`` labelled documents."""
    signs = np.array([-1 if f in FALLING else 0 for f in FEATURES])
    return grow(*sample(docs, labels, max_rows), signs, **options)


def quality_rules(docs: DataFrame, model: Trees, text: str = "text", cutoff: float = 0.5) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept.

    Null and empty texts have no words, so they fail the base limits. Any number of rows,
    repeated rows and further columns are allowed; columns of these names are replaced.
    """
    columns = ", ".join(f"{c} bigint" for c in BASE) + ", base_failed boolean, quality_score double, kept boolean"

    def judge(texts: pa.Array) -> list[pa.Array]:
        s = statistics(texts)
        failed = (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
        score = model.score(features(s))
        return [*(pa.array(s[c]) for c in BASE), pa.array(failed), pa.array(score), pa.array(~failed & (score >= cutoff))]

    return annotate(docs, text, columns, judge)
