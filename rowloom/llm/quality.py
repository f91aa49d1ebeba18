"""Quality scores learned from preference pairs: Bradley-Terry strengths, cut at a score quantile.

A good document should beat a bad one: the logistic loss on the differences of their features gives
weights, whose sum over a document's features is its strength. The cut is the quantile of the sample's
strengths that parts the labels best; a logistic curve through it makes strengths scores from 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.features import QUALITY_NAMES, labelled_sample, map_passages, quality_features, remainder
from rowloom.sources.tables import table

#: At most so many labelled rows are fitted on, and so many preference pairs of them.
SAMPLE, PAIRS = 20_000, 60_000


@dataclass(frozen=True)
class Ranking:
    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        bent = [np.maximum(z - k, 0) for k in self.knots]
        return np.concatenate([z, *bent], 1)

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strengths(x) - self.cut), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 25) -> Ranking:
    """x: rows of features, y: 0 or 1. With one label only, every strength is 0 and every score the label's side."""
    centre = np.median(x, 0) if len(x) else np.zeros(len(QUALITY_NAMES))
    scale = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(len(QUALITY_NAMES))
    knots = np.array([-1.5, 0.0, 1.5])
    blank = Ranking(centre, scale, knots, np.zeros(len(centre) * (1 + len(knots))), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        side = -1.0 if len(y) == 0 or y[0] == 1 else 1.0
        return Ranking(centre, scale, knots, blank.weights, side, 1.0)
    random = np.random.default_rng(7)
    b = blank.basis(x)
    diff = b[random.choice(good, pairs)] - b[random.choice(bad, pairs)]
    w = np.zeros(diff.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(diff @ w, -40, 40)))
        gradient = diff.T @ (p - 1) / pairs + ridge * w
        curve = (diff * (p * (1 - p))[:, None]).T @ diff / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    s = b @ w
    order = np.argsort(s, kind="stable")
    right = np.cumsum(y[order] == 0) + (y == 1).sum() - np.cumsum(y[order] == 1)
    quantile = (int(np.argmax(right)) + 1) / len(s)
    at = min(int(quantile * len(s)), len(s) - 1)
    cut = float((s[order][max(at - 1, 0)] + s[order][at]) / 2)
    slope = 1.0
    for _ in range(50):  # one parameter: the slope of the curve through the cut
        p = 1 / (1 + np.exp(-np.clip(slope * (s - cut), -40, 40)))
        g = ((p - y) * (s - cut)).sum() + 1e-3 * slope
        h = (p * (1 - p) * (s - cut) ** 2).sum() + 1e-3
        slope = float(np.clip(slope - g / h, slope / 2, slope * 2))
    return Ranking(centre, scale, knots, w, cut, slope)


def learn(docs: DataFrame, labels: DataFrame, label: str, rows: Callable[[Column], Column], sample: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> Ranking:
    """A ranking fitted on at most sample labelled rows; only their features reach the driver."""
    picked = labelled_sample(docs, labels, label, sample, rows, text, id_col)
    measured = map_passages(picked, lambda buf, at: {"x": pa.array(list(quality_features(buf, at)), pa.list_(pa.float64()))}, "x array<double>")
    got = measured.orderBy("id", F.xxhash64("x")).limit(2 * sample).toPandas()
    x = np.array(got["x"].tolist(), float).reshape(len(got), len(QUALITY_NAMES))
    return fit(x, got["y"].to_numpy(int))


def score(docs: DataFrame, ranking: Ranking, text: str = "text") -> DataFrame:
    """docs without text, plus score."""
    kept = docs.drop("score")
    ordered = kept.select(*[c for c in kept.columns if c != text], F.col(text))
    return map_passages(ordered, lambda buf, at: {"score": pa.array(ranking.scores(quality_features(buf, at)), pa.float64())}, "score double")


def training(id_col: Column) -> Column:
    return remainder(id_col, 3) != 1


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents is scored, null texts as empty ones, repeated rows each for itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranking = learn(docs, table(spark, sf_dir, "labels"), "quality", training)
    return score(docs, ranking).select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
