"""Language identification: averaged embeddings of hashed byte n-grams under a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its lower-cased UTF-8 3- and 4-grams; a softmax layer reads the language off it.
Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (`per_language` rows of each).
That runs in a task: the sample's texts, and what training makes of them, never reach the driver, which gets the model.
A fifth of the sample is held back from that: its likelihood sets the temperature of the scores, and its correctly
labelled rows set the score below which a text is rejected.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.llm.common import batches, id_text, trimmed
from corpuslode.llm.tokens import released

BUCKETS, DIM = 1 << 16, 16
UNKNOWN = "und"
#: Labels that are learnt, the commonest; characters of a text that is still learnt from.
LABELS, LONGEST = 200, 200_000


def grams(text: str, bits: int = 16, orders: tuple = (3, 4)) -> np.ndarray:
    """Buckets of the byte n-grams of the whole text, padded by spaces."""
    raw = b"  " + text.lower().encode("utf-8", "surrogatepass") + b"   "
    four = np.ndarray(len(raw) - 3, "<u4", raw, 0, (1,))
    out = []
    for n in orders:
        x = four & np.uint32((1 << 8 * n) - 1 & 0xFFFFFFFF)
        out.append((x + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - bits))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): each bucket's embedding times the softmax layer
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        return self.table[grams(text)].mean(axis=0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject_below)


def train(texts: list[str], langs: list[str], epochs: int = 4, rate: float = 0.5, reject: float = 0.002, seed: int = 11) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    rows = []
    for t, x in zip(texts, langs):
        i, n = np.unique(grams(t), return_counts=True)
        rows.append((i, (n / n.sum()).astype(np.float32), names.index(x)))
    held = rng.random(len(rows)) < 0.2
    fit = [r for r, h in zip(rows, held) if not h] or rows
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) / DIM
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for r in rng.permutation(len(fit)):
            i, w, y = fit[r]
            step = rate * (1 - done / steps)
            done += 1
            e = emb[i]
            h = w @ e
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= step * np.outer(h, p)
            bias -= step * p
            # a mean over many n-grams moves each of them little: scaled up by their number
            emb[i] = e - (step * len(w)) * np.outer(w, back) / np.sqrt(len(w))
    model = Model(names, emb @ out, bias.astype(np.float64))
    check = [(model.table[i].T.astype(np.float64) @ w + model.bias, y) for i, w, y in (r for r, h in zip(rows, held) if h)]
    if check and len(names) > 1:
        z, y = np.array([c[0] for c in check]), np.array([c[1] for c in check])

        def scores(t: float) -> np.ndarray:
            p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return p / p.sum(axis=1, keepdims=True)

        # noise in the labels keeps the likelihood finite: one in 1000 may be wrong
        loss = lambda t: -np.log(0.999 * scores(t)[np.arange(len(y)), y] + 0.001 / len(names)).mean()
        model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
        p = scores(model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.reject_below = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return model


def sampled(docs: DataFrame, keys: DataFrame, label: str, each: int, labels: int = LABELS, longest: int = LONGEST) -> DataFrame:
    """(doc_id, label, text): whole texts of at most `each` ids of keys (doc_id, label) a label, the least by a hash of doc_id.

    A bounded sample: of at most `labels` labels, the commonest; of rows with one doc_id the one with the least text; no text
    of more than `longest` characters. Ids are chosen before any text is read; only they reach the driver.
    """
    # A label may hold most rows. Its rows are counted first; only those whose hash lies below the share of the hash range that
    # should hold `each` of them, and 8 standard deviations more, meet in its window. One count a label is broadcast.
    keys = keys.distinct()
    at = F.shiftright(F.xxhash64("doc_id"), 11) / float(1 << 53) + 0.5
    counts = keys.groupBy(label).agg(F.count("*").alias("_all")).orderBy(F.desc("_all"), label).limit(labels)
    low = keys.join(F.broadcast(counts), label).where(at * F.col("_all") <= each + 8 * each**0.5 + 64)
    w = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = low.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).select(F.col("doc_id").alias("_id"), F.col(label).alias("_label"))
    got = [(r[0], r[1]) for r in chosen.collect()]  # bounded: `each` rows a label
    ids = docs.sparkSession.createDataFrame(got or [(None, None)], chosen.schema)
    rows = docs.where(F.length("text") <= longest).join(F.broadcast(ids), docs["doc_id"] == ids["_id"]).groupBy("doc_id", "_label").agg(F.min("text").alias("text"))
    return rows.select("doc_id", F.col("_label").alias("label"), "text")


def _in_order(rows: list[tuple]) -> tuple[list, list]:
    """Texts and labels of (doc_id, label, text), in the one order that training sees."""
    rows = sorted(rows, key=lambda r: (r[0], str(r[1])))
    return [r[2] for r in rows], [r[1] for r in rows]


def sample_of(docs: DataFrame, keys: DataFrame, label: str, each: int, labels: int = LABELS, longest: int = LONGEST) -> tuple[list, list]:
    """The texts and labels of sampled(), on the driver."""
    return _in_order(sampled(docs, keys, label, each, labels, longest).collect())


def trained(sample: DataFrame, make: Callable[[list[str], list], Any]) -> Any:
    """make(texts, labels) of a bounded sample (doc_id, label, text), called in one task; only what it returns reaches the driver."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        rows = [r for columns in batches(it, "doc_id", "label", "text") for r in zip(*columns)]
        if rows:
            model = pickle.dumps(make(*_in_order(rows)))
            del rows
            trimmed()
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    got = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0][0]) if got else make([], [])


def held_out(column: str, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, usable: Column, per_language: int = 1500) -> Model:
    """Trains on at most per_language rows of each lang among the usable rows of docs (doc_id, text, lang)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), usable.alias("use"))
    keys = base.where("use and lang is not null and doc_id is not null").select("doc_id", "lang")
    return trained(sampled(id_text(docs), keys, "lang", per_language), train)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs' rows as (doc_id, lang_pred, score, rejected); whole texts are read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, "doc_id", "text"):
            got = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identify(docs: DataFrame, parts: int = 3, part: int = 1, per_language: int = 1500) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of docs.

    Rows whose crc32(doc_id as text) mod parts is part are never learnt from. A text that is null or has no letter is
    `und` with score 0 and rejected; so is every text where there is nothing to learn from. A null doc_id is not held out,
    nor learnt from. Repeated rows get one result each; of equal scores the first language by name wins. Other columns,
    whatever their names, are left out. An empty table gives an empty result.
    """
    model = fit(docs, ~held_out("doc_id", parts, part), per_language)
    return predict(docs, model).select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "lang_pred", "score", "rejected")
