"""Quality classifier: a regularised quadratic discriminant over transformed statistics.

Each class has a mean and a covariance shrunk towards the pooled covariance and towards a
multiple of the identity. The Cholesky factors are computed once and kept; a score is the
logistic function of the difference of the two Mahalanobis log densities plus the log odds
of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import annotate, fold
from .labelled import sample
from .text_stats import features, statistics


@dataclass(frozen=True)
class Discriminant:
    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    inverse: tuple[np.ndarray, ...]  # of the Cholesky factors
    log_det: tuple[float, ...]
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = [-0.5 * ((((z - m) @ i.T) ** 2).sum(axis=1) + d) for m, i, d in zip(self.means, self.inverse, self.log_det, strict=True)]
        gap = logs[1] - logs[0] + self.log_odds if logs else np.full(len(x), self.log_odds)
        return 1 / (1 + np.exp(-np.clip(gap, -700, 700)))


def fit(x: np.ndarray, y: np.ndarray, pooled_share: float = 0.1, ridge_share: float = 0.05) -> Discriminant:
    """A discriminant for labels 0 and 1; with fewer than two classes, the constant log odds."""
    width = x.shape[1]
    odds = float(np.log((np.sum(y == 1) + 0.5) / (np.sum(y == 0) + 0.5)))
    centre, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(width), np.ones(width))
    scale = np.where(scale > 1e-9, scale, 1.0)
    if len(set(y.tolist())) < 2:
        return Discriminant(centre, scale, (), (), (), odds)
    z = (x - centre) / scale
    parts = [z[y == k] for k in (0, 1)]
    means = [p.mean(axis=0) for p in parts]
    own = [(p - m).T @ (p - m) / len(p) for p, m in zip(parts, means, strict=True)]
    pooled = sum(len(p) * c for p, c in zip(parts, own, strict=True)) / len(z)
    inverse, dets = [], []
    for c in own:
        mixed = (1 - pooled_share) * c + pooled_share * pooled
        mixed = (1 - ridge_share) * mixed + ridge_share * max(1e-6, np.trace(mixed) / width) * np.eye(width)
        factor = np.linalg.cholesky(mixed)
        inverse.append(np.linalg.inv(factor))
        dets.append(2 * float(np.log(np.diag(factor)).sum()))
    return Discriminant(centre, scale, tuple(means), tuple(inverse), tuple(dets), odds)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, modulus: int = 3, held: int = 1) -> Discriminant:
    """Fitted on at most ``max_rows`` labelled documents outside the held-out fold of ids."""
    return fit(*sample(docs, labels, max_rows, keep=fold(F.col("doc_id"), modulus) != held))


def quality_score(docs: DataFrame, model: Discriminant, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5).

    Only the text counts. Null and empty texts are scored like any other, from statistics
    that are all zero. Columns named score or predicted are replaced; repeated rows stay.
    """

    def judge(texts: pa.Array) -> list[pa.Array]:
        score = model.score(features(statistics(texts)))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return annotate(docs, text, "score double, predicted int", judge)
