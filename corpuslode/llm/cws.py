"""Document fingerprints by consistent weighted sampling (Ioffe, 2010).

A text is a bag of lower-cased words, hashed to `buckets` dimensions and weighted by their counts. For each of `samples`
draws, gamma variates r and c and a uniform b per dimension turn a weight s into t = floor(ln s / r + b) and
a = c / exp(r (t - b + 1)); the draw is the dimension of least a, with its t. Two bags draw alike with a
probability equal to their generalised Jaccard similarity, sum of the smaller over sum of the larger weights.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import id_ranges, id_text, partitions

SAMPLES, BUCKET_BITS, SEED = 64, 16, 1234
_TABLES: dict = {}


def tables(samples: int, bits: int, seed: int) -> tuple[np.ndarray, ...]:
    """(r, ln c, b), each (buckets, samples); made once a worker process."""
    key = samples, bits, seed
    if key not in _TABLES:
        rng = np.random.default_rng(seed)
        shape = (1 << bits, samples)
        r, c = (rng.standard_gamma(2.0, shape, np.float32) + np.float32(1e-12) for _ in range(2))
        _TABLES[key] = r, np.log(c), rng.random(shape, np.float32)
    return _TABLES[key]


def bag(text: str | None, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(dimensions, weights) of a text's words."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    return np.unique(h * np.uint32(2654435761) >> np.uint32(32 - bits), return_counts=True)


def signature(text: str | None, samples: int = SAMPLES, bits: int = BUCKET_BITS, seed: int = SEED) -> np.ndarray:
    """16 bits a draw; all ones of a text without words."""
    dims, weights = bag(text, bits)
    if not len(dims):
        return np.full(samples, 0xFFFF, np.uint16)
    r, c, b = tables(samples, bits, seed)
    logs = np.log(weights).astype(np.float32)[:, None]
    best, which, at = np.full(samples, np.inf, np.float32), np.zeros(samples, np.int64), np.zeros(samples, np.float32)
    every = np.arange(samples)
    for lo in range(0, len(dims), 1024):
        own = dims[lo : lo + 1024]
        rate, shift = r[own], b[own]
        t = np.floor(logs[lo : lo + 1024] / rate + shift)
        a = c[own] - rate * (t - shift + 1)
        k = a.argmin(axis=0)
        new = a[k, every] < best
        best[new], which[new], at[new] = a[k, every][new], own[k][new], t[k, every][new]
    h = which.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (at.astype(np.int64).astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ h >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of draws that agree: an estimate of the generalised Jaccard similarity."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last half of code points replaced by as many of the next document's first, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, at, copy) dealt to ranges of ascending ids, each sorted, with a copy of the next range's first row.

    The ranges' first rows are one (id, hash) a range on the driver. The last range gets the first row of all.
    """
    n = partitions(docs)
    rows = id_ranges(id_text(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("h", F.coalesce(F.xxhash64("text"), F.lit(0))), n)
    first = sorted(rows.groupBy("range_id").agg(F.min(F.struct("at", "h")).alias("f")).select("f.at", "f.h", "range_id").collect())
    heads = [(a, h, first[i - 1][2]) for i, (a, h, _) in enumerate(first)]
    heads = rows.sparkSession.createDataFrame(heads, "at long, h long, range_id int")
    copies = rows.drop("range_id").join(F.broadcast(heads), ["at", "h"]).withColumn("copy", F.lit(True))
    every = rows.withColumn("copy", F.lit(False)).unionByName(copies)
    # behind all rows of its range, also behind those of larger ids in the last one
    return every.repartitionById(n, F.col("range_id")).sortWithinPartitions("copy", "at", "h").select("doc_id", "text", "copy")


def fingerprints(docs: DataFrame, samples: int = SAMPLES, bits: int = BUCKET_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of docs.

    Documents are ordered by id, rows of one id by a hash of their texts, null ids first; after the last comes the first.
    Null texts are empty; two texts without words are alike (1), and unlike any other (0). Repeated rows come as
    often as they are there. Other columns, whatever their names, are left out. An empty table gives an empty result.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in it:
            out: list[tuple] = []
            for doc, text, copy in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("copy").to_pylist()):
                text = text or ""
                own = signature(text, samples, bits, seed)
                if before:
                    other = edited(before[1], text)
                    sig = signature(other, samples, bits, seed)
                    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before[0], len(before[1]), sha, before[2].astype(">u2").tobytes().hex(), sig.astype(">u2").tobytes().hex(), likeness(before[2], sig), likeness(before[2], own)))
                before = None if copy else (doc, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _OUT.types)], schema=_OUT)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
