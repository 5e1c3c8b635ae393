"""A vector index on disk: inverted lists over product-quantised residuals, with an exact rerank.

Centres of lists and codebooks are trained on a bounded sample; every vector is in the index. A vector is in the list of its
nearest centre, as one byte for each few dimensions of what is left of it. A search reads codes only: per query the lists with
the greatest products, one product of a list's decoded rows with all its queries, the best `candidates` of all tasks; these
alone meet their vectors again and are scored exactly. How many lists and candidates a search takes is tuned on the sample when the index is built, for the
share of true neighbours that is asked for.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.operators import search as S
from corpuslode.sources.versions import Manifests

#: Rows that the centres and codebooks are trained on; lists; dimensions of a code's byte; queries of one pass; codes of a task.
SAMPLE, MOST_LISTS, SUB, PASS, CODES = 20_000, 4096, 4, 2048, 1 << 16


def k_means(rows: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """k centres by Lloyd's rounds from k random rows; a centre without rows takes a random row."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.repeat(centres[-1:], k - len(centres), axis=0)])
    for _ in range(rounds):
        own = nearest(rows, centres)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, rows)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], rows[rng.integers(0, len(rows), k)])
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(rows[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, np.int64)


class Books:
    """Centres of lists, and 256 centres of residuals for every few dimensions."""

    def __init__(self, centres: np.ndarray, books: np.ndarray) -> None:
        self.centres, self.books = centres, books

    @classmethod
    def trained(cls, rows: np.ndarray, lists: int) -> Books:
        centres = k_means(rows, lists)
        rest = cls.parted(rows - centres[nearest(rows, centres)])
        return cls(centres, np.stack([k_means(rest[:, m], 256, seed=m) for m in range(rest.shape[1])]))

    @staticmethod
    def parted(rows: np.ndarray) -> np.ndarray:
        """Rows as groups of SUB dimensions, the last filled up with zeros."""
        gap = -rows.shape[1] % SUB
        return np.pad(rows, ((0, 0), (0, gap))).reshape(len(rows), -1, SUB)

    def code(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = nearest(rows, self.centres)
        rest = self.parted(rows - self.centres[own])
        return own, np.stack([nearest(rest[:, m], self.books[m]) for m in range(rest.shape[1])], axis=1).astype(np.uint8)

    def decoded(self, own: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The rows that codes stand for."""
        rest = np.concatenate([self.books[m][codes[:, m]] for m in range(codes.shape[1])], axis=1)
        return self.centres[own] + rest[:, : self.centres.shape[1]]

    def saved(self) -> dict:
        pack = lambda x: {"shape": x.shape, "data": base64.b64encode(x.astype("<f4").tobytes()).decode()}
        return {"centres": pack(self.centres), "books": pack(self.books)}

    @classmethod
    def loaded(cls, saved: dict) -> Books:
        return cls(*(np.frombuffer(base64.b64decode(saved[n]["data"]), "<f4").astype(np.float64).reshape(saved[n]["shape"]) for n in ("centres", "books")))


def _units(rows: np.ndarray) -> np.ndarray:
    return S._unit(rows)


def tuned(books: Books, rows: np.ndarray, k: int, recall: float, total: int | None = None) -> tuple[int, int]:
    """(lists, candidates) for that share of the k true neighbours, besides itself, of some of the rows among all of `total`.

    rows are a sample: where there are `scale` times as many, the k nearest lie as deep as the k / scale nearest of the sample,
    and as many more rows lie before them. Beyond a scale of k the sample has no such neighbours.
    """
    scale = max(1.0, min((total or len(rows)) / len(rows), k))
    at = np.arange(len(rows))[:: max(1, len(rows) // 200)][:200]
    q = rows[at]
    own, codes = books.code(rows)
    scores, product = q @ rows.T, q @ books.centres.T
    scores[np.arange(len(q)), at] = -np.inf
    k = max(1, min(round(k / scale), len(rows) - 1))
    truth = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-product, axis=1), axis=1)  # of each list for each query
    where = place[np.arange(len(q))[:, None], own[truth]]
    lists = next(n for n in [*sorted({2**i for i in range(12)} | {3 * 2**i for i in range(11)}), 1 << 13] if n >= len(books.centres) or (where < n).mean() >= (1 + recall) / 2)
    lists = min(lists, len(books.centres))
    near = q @ books.decoded(own, codes).T
    near[place[:, own] >= lists] = -np.inf
    near[np.arange(len(q)), at] = -np.inf
    order = np.argsort(np.argsort(-near, axis=1), axis=1)
    found = order[np.arange(len(q))[:, None], truth]
    reached = where < lists
    n = k
    while n < len(rows) and ((found < n) & reached).mean() < recall:
        n *= 2
    return lists, int(np.ceil(n * scale))


class VectorIndex:
    """An index of vectors (id, embedding) at a path. cosine: vectors and queries count by their direction."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path, self.manifests = spark, path.rstrip("/"), Manifests(spark, path)

    def is_ready(self) -> bool:
        return self.manifests.latest() > 0

    def build(self, vectors: DataFrame, cosine: bool = False, lists: int | None = None, sample: int = SAMPLE, k: int = 10, recall: float = 0.97) -> None:
        """Trains on `sample` rows, the smallest by a hash of their ids, and writes every row that has a vector."""
        rows = vectors.where("embedding is not null").select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        got = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # bounded by `sample`
        if not got:
            self.manifests.publish(self.manifests.latest(), {"rows": 0})
            return
        own = np.array([r[1] for r in got], np.float64)
        own = _units(own) if cosine else own
        books = Books.trained(own, lists or int(min(MOST_LISTS, max(1, len(own) // 8), max(1, 2 * n**0.5))))
        probes, candidates = tuned(books, own, k, recall, n)
        at, sent = self.manifests.folder(), self.spark.sparkContext.broadcast(books)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                if b.num_rows:
                    x = S._matrix(b)
                    where, codes = sent.value.code(_units(x) if cosine else x)
                    yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), b.column("id"), pa.array([c.tobytes() for c in codes], pa.binary())], names=["list", "id", "code"])

        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        coded = rows.mapInArrow(run, "list int, id long, code binary")
        # a list's codes lie together; a list with a third of all rows is cut by id
        coded.repartitionByRange(tasks, "list", "id").sortWithinPartitions("list", "id").write.parquet(f"{self.path}/{at}/codes")
        rows.repartitionByRange(tasks, "id").sortWithinPartitions("id").write.parquet(f"{self.path}/{at}/vectors")
        self.manifests.publish(self.manifests.latest(), {"rows": n, "at": at, "cosine": cosine, "probes": probes, "candidates": candidates, **books.saved()})

    def search(self, queries: DataFrame, k: int, probes: int | None = None, candidates: int | None = None) -> DataFrame:
        """(query_id, chunk_id, score, rank) of queries (query_id, embedding), as search.dense() gives them, but for what the index misses."""
        state = self.manifests.read()
        if not state:
            raise RuntimeError(f"no index at {self.path}")
        asked = queries.where("embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = asked.count()
        if n > PASS:  # a stated query set goes through in parts
            parts = -(-n // (PASS // 2))
            out = [self._pass(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i), state, k, probes, candidates) for i in range(parts)]
            for other in out[1:]:
                out[0] = out[0].unionByName(other)
            return S.ranked(out[0], k)
        return S.ranked(self._pass(asked, state, k, probes, candidates), k)

    def _pass(self, asked: DataFrame, state: dict, k: int, probes: int | None, candidates: int | None) -> DataFrame:
        got = asked.collect()  # about PASS rows at most
        if not got or not state["rows"]:
            return self.spark.createDataFrame([], "query_id long, chunk_id long, score double")
        cosine, books = state["cosine"], Books.loaded(state)
        ids, q = np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.float64)
        q = _units(q) if cosine else q
        probes, best = probes or state["probes"], max(4 * k, candidates or state["candidates"])
        product = q @ books.centres.T
        probed = np.zeros(product.shape, bool)
        np.put_along_axis(probed, np.argpartition(-product, min(probes, product.shape[1]) - 1, axis=1)[:, :probes], True, axis=1)
        sent = self.spark.sparkContext.broadcast((q.astype(np.float32), probed, Books(books.centres.astype(np.float32), books.books.astype(np.float32))))
        wanted = np.flatnonzero(probed.any(axis=0)).tolist()

        def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, probed, books = sent.value
            ids, scores = np.zeros((len(q), best), np.int64), np.full((len(q), best), -np.inf, np.float32)  # the best so far
            for b in it:
                where, own = b.column("list").to_numpy(), b.column("id").to_numpy()
                if not len(where):
                    continue
                rows = books.decoded(where, np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(where), -1))
                cuts = [0, *(np.flatnonzero(where[1:] != where[:-1]) + 1).tolist(), len(where)]
                for i, j in zip(cuts, cuts[1:]):
                    some = np.flatnonzero(probed[:, where[i]])
                    for lo in range(0, len(some), 256):
                        x = some[lo : lo + 256]
                        s = np.concatenate([scores[x], q[x] @ rows[i:j].T], axis=1)
                        top = np.argpartition(-s, best - 1, axis=1)[:, :best]
                        a = np.concatenate([ids[x], np.broadcast_to(own[i:j], (len(x), j - i))], axis=1)
                        ids[x], scores[x] = np.take_along_axis(a, top, axis=1), np.take_along_axis(s, top, axis=1)
            for lo in range(0, len(q), 64):
                row, column = np.nonzero(scores[lo : lo + 64] > -np.inf)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(row + lo), pa.array(ids[row + lo, column]), pa.array(scores[row + lo, column].astype(np.float64))], names=["query_id", "chunk_id", "score"])

        codes = self.spark.read.schema("list int, id long, code binary").parquet(f"{self.path}/{state['at']}/codes")
        # every task sends its best: small files make no tasks of their own, the passes of a query set run side by side
        codes = codes.coalesce(-(-state["rows"] // CODES))
        if len(wanted) <= 64:
            codes = codes.where(F.col("list").isin(wanted))
        first = S.ranked(codes.mapInArrow(near, "query_id long, chunk_id long, score double"), best).select(F.col("query_id").alias("q"), F.col("chunk_id").alias("id"))
        vectors = self.spark.read.schema("id long, embedding array<double>").parquet(f"{self.path}/{state['at']}/vectors")
        # the candidates are bounded by queries x candidates; few enough go to where the vectors are
        met = vectors.join(F.broadcast(first) if len(got) * best <= S.MOST_TERMS else first, "id")
        exact = self.spark.sparkContext.broadcast((ids, q))

        def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q = exact.value
            for b in it:
                if b.num_rows:
                    x, own = S._matrix(b), b.column("q").to_numpy()
                    s = ((_units(x) if cosine else x) * q[own]).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), b.column("id"), pa.array(np.round(s, 6) + 0.0)], names=["query_id", "chunk_id", "score"])

        return met.mapInArrow(score, "query_id long, chunk_id long, score double")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth's rows (query_id, chunk_id) that are found."""
    both = truth.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0]
