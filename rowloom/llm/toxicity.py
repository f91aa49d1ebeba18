"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learned too: words and beginnings of words whose log-odds of being in a toxic document
are high. Each half of the sample is measured with the lexicon of the other, so that trees never see a
density that their own labels made; curves come from trees grown on the other half as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import written
from rowloom.llm.features import TOXIC_NAMES, Lexicon, labelled_sample, map_passages, remainder, tokens, toxic_features, word_keys
from rowloom.llm.textkernel import column_bytes, passages
from rowloom.sources.tables import table

#: At most so many labelled rows are fitted on; so many words and beginnings make a lexicon.
SAMPLE, ENTRIES = 20_000, 600
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 80, 3, 0.15, 32, 8


@dataclass(frozen=True)
class Forest:
    """Complete trees: feature and threshold of each inner node, value of each leaf."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - (2**DEPTH - 1)]
        return total


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Trees on the gradients of the logistic loss, splits at quantiles of the features."""
    n, m = x.shape
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    start = float(np.log(rate / (1 - rate)))
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, m), int)
    margin = np.full(n, start)
    features, thresholds, values = [], [], []
    for _ in range(TREES if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(n, int)
        for level in range(DEPTH):
            first = 2**level - 1
            width = 2**level
            best = np.full(width, 1e-9)
            at = [(0, np.inf)] * width
            for j in range(m):
                size = len(edges[j]) + 1
                if size < 2:
                    continue
                key = (node - first) * size + binned[:, j]
                gs, hs, cs = (np.bincount(key, weights=w, minlength=width * size).reshape(width, size).cumsum(1) for w in (g, h, np.ones(n)))
                gl, hl, cl = gs[:, :-1], hs[:, :-1], cs[:, :-1]
                gt, ht, ct = gs[:, -1:], hs[:, -1:], cs[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[(cl < LEAST_LEAF) | (ct - cl < LEAST_LEAF)] = -1
                k = gain.argmax(1)
                for q in np.flatnonzero(gain[np.arange(width), k] > best):
                    best[q], at[q] = gain[q, k[q]], (j, edges[j][k[q]])
            for q, (j, t) in enumerate(at):
                feature[first + q], threshold[first + q] = j, t
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + 1)
        margin = margin + value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Forest(start, np.array(features, int).reshape(-1, inner), np.array(thresholds).reshape(-1, inner), np.array(values).reshape(-1, leaves))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of the non-decreasing curve nearest to y; ties in x are pooled first."""
    if not len(x):
        return np.array([0.0]), np.array([0.0])
    xs, back = np.unique(x, return_inverse=True)
    weight = np.bincount(back).astype(float)
    mean = np.bincount(back, weights=y) / weight
    stack: list[list[float]] = []
    for at, (m, w) in enumerate(zip(mean, weight, strict=True)):
        stack.append([m, w, at, at])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            m2, w2, _, last = stack.pop()
            m1, w1, first, _ = stack.pop()
            stack.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    px = np.array([v for m, _, a, b in stack for v in (xs[int(a)], xs[int(b)])])
    py = np.array([m for m, *_ in stack for _ in range(2)])
    return px, py


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    forest: Forest
    curve: tuple[np.ndarray, np.ndarray]

    def scores(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        margins = self.forest.margins(toxic_features(buf, at, self.lexicon))
        # the curve is flat in pieces; a small share of the margin keeps the order inside them
        smooth = 1 / (1 + np.exp(-np.clip(margins, -40, 40)))
        return 0.98 * np.interp(margins, *self.curve) + 0.02 * smooth


def lexicon(sample: DataFrame) -> Lexicon:
    """The ENTRIES words and beginnings that tell most of (id, y, text) rows; counts are of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(0))
            buf, at = column_bytes(batch.column(1))
            for a, b in passages(at):
                starts, ends, row, plain = tokens(buf[at[a] : at[b]], at[a : b + 1] - at[a])
                whole, begun = word_keys(plain, starts, ends)
                keys = np.concatenate([whole, *(k for _, k in begun)])
                rows = np.concatenate([row, *(row[i] for i, _ in begun)])
                order = np.lexsort((keys, rows))
                keys, rows = keys[order], rows[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), pa.array(y[a:b][rows[new]].astype(np.int64))], ["key", "y"])

    sizes = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    n = {r.y: r.n for r in sizes}
    toxic, clean = n.get(1, 0) + 1.0, n.get(0, 0) + 1.0
    counted = sample.select("y", "text").mapInArrow(run, "key long, y long").groupBy("key").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / toxic) - F.log((F.col("c") + 0.5) / clean)
    told = counted.where("t >= 3").withColumn("odds", odds).where("odds > 1.5").withColumn("gain", F.col("t") / toxic * F.col("odds"))
    top = told.orderBy(F.desc("gain"), "key").limit(ENTRIES).select("key", "odds").toPandas()
    return Lexicon(top["key"].to_numpy(np.int64).view(np.uint64), top["odds"].to_numpy(float))


def _measured(sample: DataFrame, words: Lexicon, bound: int) -> tuple[np.ndarray, np.ndarray]:
    made = map_passages(sample, lambda buf, at: {"x": pa.array(list(toxic_features(buf, at, words)), pa.list_(pa.float64()))}, "x array<double>")
    got = made.orderBy("id", F.xxhash64("x")).limit(2 * bound).toPandas()
    return np.array(got["x"].tolist(), float).reshape(len(got), len(TOXIC_NAMES)), got["y"].to_numpy(float)


def learn(docs: DataFrame, labels: DataFrame, label: str, rows: Callable[[Column], Column], sample: int = SAMPLE, text: str = "text", id_col: str = "doc_id") -> Model:
    """A model fitted on at most sample labelled rows; only their features and word counts reach the driver."""
    picked = written(labelled_sample(docs, labels, label, sample, rows, text, id_col))  # read many times
    halves = [picked.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2)) == half) for half in (0, 1)]
    words = [lexicon(h) for h in halves]
    (xa, ya), (xb, yb) = _measured(halves[0], words[1], sample), _measured(halves[1], words[0], sample)
    apart = np.concatenate([grow(xb, yb).margins(xa), grow(xa, ya).margins(xb)])
    return Model(lexicon(picked), grow(np.concatenate([xa, xb]), np.concatenate([ya, yb])), isotonic(apart, np.concatenate([ya, yb])))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs without text, plus score."""
    kept = docs.drop("score")
    ordered = kept.select(*[c for c in kept.columns if c != text], F.col(text))
    return map_passages(ordered, lambda buf, at: {"score": pa.array(model.scores(buf, at), pa.float64())}, "score double")


def training(id_col: Column) -> Column:
    return remainder(id_col, 4) != 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents is scored, null texts as empty ones, repeated rows each for itself."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"), "toxic", training)
    return score(docs, model).select(
        "doc_id", (~training(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
