"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

A text is the set of its hashed byte 3- and 4-grams. Each indicator is scaled by the
log-ratio of its smoothed counts in the two classes; a linear hinge-loss model is fitted to the scaled, normalised vectors by
dual coordinate descent (Hsieh et al., 2008). Margins become scores by Platt's sigmoid, fitted on rows held back from it.
Training takes a bounded sample (`per_class` labelled rows a class) and runs in a task, as langid's does; the scores are set
back to the classes' true shares.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import batches, id_text
from corpuslode.llm.langid import grams, held_out, sampled, trained

BITS = 18
THRESHOLD = 0.3


def features(text: str | None) -> np.ndarray:
    """The distinct buckets of a whole text's byte n-grams."""
    return np.unique(grams(text or "", BITS))


@dataclass
class Model:
    weights: np.ndarray  # of each bucket, the log-count ratio included
    bias: float
    slope: float
    shift: float

    def margin(self, own: np.ndarray) -> float:
        return float(self.weights[own].sum(dtype=np.float64) / np.sqrt(len(own))) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -50, 50))))


def _ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float) -> np.ndarray:
    counts = np.full((2, 1 << BITS), smooth)
    for own, k in zip(rows, y):
        counts[k][own] += 1
    p = counts / counts.sum(axis=1, keepdims=True)
    return np.log(p[1] / p[0])


def _hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss with a bias feature of 1."""
    w, b, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    norms = [float(v @ v) + 1.0 for v in values]
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            own, v = rows[i], values[i]
            g = y[i] * (w[own] @ v + b) - 1
            new = min(max(alpha[i] - g / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[own] += step * v
                b += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, b


def train(texts: list[str], labels: list[int], share: float | None = None, cost: float = 1.0, epochs: int = 12, seed: int = 5) -> Model:
    """share: that of label 1 among all labelled rows, where the sample's differs."""
    y = np.array(labels, np.int64)
    flat = np.zeros(1 << BITS)
    if len(set(labels)) < 2:
        p = 0.5 if not len(y) else 0.99 if y[0] else 0.01
        return Model(flat, 0.0, 0.0, float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    rows = [features(t) for t in texts]
    own_share = y.mean()
    share = own_share if share is None else min(max(share, 1e-4), 1 - 1e-4)

    def fitted(use: np.ndarray) -> tuple[np.ndarray, float]:
        some, target = [rows[i] for i in use], y[use]
        ratio = _ratios(some, target, 1.0)
        values = [ratio[x] / np.sqrt(len(x)) for x in some]
        weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-9), 0.5 / max(1 - target.mean(), 1e-9)) * cost
        w, b = _hinge(some, values, 2 * target - 1, weight, epochs, rng)
        return w * ratio, b

    held = rng.random(len(y)) < 0.25
    fit, check = np.nonzero(~held)[0], np.nonzero(held)[0]
    if len(set(y[fit])) < 2 or len(set(y[check])) < 2:
        fit = check = np.arange(len(y))
    w, b = fitted(fit)
    slope, shift = _platt(np.array([Model(w, b, 1, 0).margin(rows[i]) for i in check]), y[check])
    w, b = fitted(np.arange(len(y)))
    shift += np.log(share / (1 - share)) - np.log(own_share / (1 - own_share))
    return Model(w.astype(np.float32), b, slope, float(shift))


def _platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's sigmoid by Newton's method, with his smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margin, np.ones(len(y))], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (t - p) - 1e-4 * at)
        at += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = 2500) -> Model:
    """Trains on at most per_class usable rows of each class of labels (doc_id, label); usable may use doc_id only."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(usable).join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    share = own.agg(F.avg("label")).first()[0]
    keys = own.groupBy("doc_id").agg(F.max("label").alias("label"))
    return trained(sampled(id_text(docs), keys, "label", per_class), lambda texts, labels: train(texts, labels, share))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, "doc_id", "text"):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([model.score(t) for t in texts], pa.float64())], names=["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, per_class: int = 2500) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    Labels of rows whose crc32(doc_id as text) mod parts is part are never learnt from. Null and empty texts are scored by
    the model as texts without words. Without labels of both classes the score is constant. A null doc_id is not held out.
    Repeated rows get one result each; of several labels of a doc_id the largest counts. Other columns, whatever their
    names, are left out. An empty table gives an empty result.
    """
    out = held_out("doc_id", parts, part)
    model = fit(docs, labels, ~out)
    return predict(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
