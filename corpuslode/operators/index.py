"""Sparse indexes on disk, behind one contract for all kinds: block-max postings in segments, and given weights."""

from __future__ import annotations

import json
import math
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.functions.text import tokens
from corpuslode.operators import blockmax
from corpuslode.operators import search as S
from corpuslode.sources.versions import Manifests


class SparseIndex(Protocol):
    """What a sparse retriever offers, whatever its weights are."""

    def index(self, chunks: DataFrame) -> None: ...

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...

    def is_ready(self) -> bool: ...

    def document_count(self) -> int: ...


class _OnDisk:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def is_ready(self) -> bool:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/stats/_SUCCESS"))

    def document_count(self) -> int:
        return self.spark.read.parquet(f"{self.path}/stats").first()["n"] if self.is_ready() else 0

    def _read(self, name: str) -> DataFrame:
        if not self.is_ready():
            raise RuntimeError(f"no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{name}")


class Bm25:
    """A frequency's share of its term's weight, by Lucene's formula."""

    def __init__(self, mean: float, k1: float, b: float) -> None:
        self.mean, self.k1, self.b = mean or 1.0, k1, b

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))


class Bm25Index(_OnDisk):
    """Words and BM25 over block-max postings, in segments that documents are added to, replaced in and deleted from.

    A version's manifest names the segments, each some files of blockmax rows that are never changed, and the documents that
    no longer count. add() writes a segment of its rows alone; ids that it brings anew no longer count where they were. The
    number of documents, their mean length and every term's number of documents leave those out, so scores are those of an
    index built anew. Segments of like size are merged once there are `fan` of them: sizes grow by that factor from tier to
    tier, so there are few segments, and a document is written again once a tier. A merge reads blocks, not texts.
    """

    fan, smallest = 4, 1000

    def __init__(self, spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75, version: int | None = None) -> None:
        """version: the one that a read or the next write starts from, whatever came after it."""
        super().__init__(spark, path)
        self.k1, self.b, self.version, self.manifests = k1, b, version, Manifests(spark, path)

    def is_ready(self) -> bool:
        return self.manifests.latest() > 0

    def document_count(self) -> int:
        return self._state()["docs"] if self.is_ready() else 0

    def segments(self) -> list[dict]:
        return self._state()["segments"] if self.is_ready() else []

    def _state(self) -> dict:
        found = self.manifests.read(self.version)
        if not found:
            raise RuntimeError(f"no index at {self.path}")
        return found

    def _rows(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.schema(blockmax.SCHEMA).parquet(*[f"{self.path}/{s['at']}" for s in segments])

    def _gone(self, state: dict) -> DataFrame | None:
        """(shard, places) of the documents that no longer count."""
        if not state["gone"]:
            return None
        dead = self.spark.read.schema("shard long, place int").parquet(f"{self.path}/{state['gone']}")
        return dead.groupBy("shard").agg(F.collect_set("place").alias("places"))  # a shard's documents at most

    def _segment(self, rows: DataFrame, number: int) -> dict:
        """Writes rows as a segment; its shards' numbers begin with the segment's."""
        at = self.manifests.folder()
        rows.withColumn("shard", F.col("shard") + F.lit(number << 44)).write.parquet(f"{self.path}/{at}")
        docs, terms = blockmax.statistics(self.spark.read.schema(blockmax.SCHEMA).parquet(f"{self.path}/{at}")).select("docs", "terms").first()
        return {"at": at, "number": number, "docs": docs, "terms": terms}

    def _built(self, chunks: DataFrame) -> DataFrame:
        return blockmax.build(chunks.select(F.col("chunk_id").alias("id"), tokens(F.col("text")).alias("terms")))

    def index(self, chunks: DataFrame) -> None:
        """chunks (chunk_id, text) as all that the index has; one segment."""
        base, self.version = self.manifests.latest(), None
        number = self.manifests.read().get("next", 1) if base else 1
        one = self._segment(self._built(chunks), number)
        self.manifests.publish(base, {"next": number + 1, "segments": [one], "gone": None, "dead": 0, "docs": one["docs"], "terms": one["terms"]})

    def _buried(self, state: dict, ids: DataFrame) -> dict:
        """state without the documents of ids (id)."""
        if not state["segments"]:
            return state
        found = blockmax.places(self._rows(state["segments"]), ids)
        old = None
        if state["gone"]:
            old = self.spark.read.schema("shard long, place int").parquet(f"{self.path}/{state['gone']}")
            found = found.join(old, ["shard", "place"], "left_anti")
        at = self.manifests.folder()
        found.write.parquet(f"{self.path}/{at}-new")
        new = self.spark.read.schema("shard long, place int, id long, length long").parquet(f"{self.path}/{at}-new")
        docs, terms = new.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if not docs:
            return state
        every = new.select("shard", "place")
        (every if old is None else old.unionByName(every)).write.parquet(f"{self.path}/{at}")
        return {**state, "gone": at, "dead": state["dead"] + docs, "docs": state["docs"] - docs, "terms": state["terms"] - terms}

    def add(self, chunks: DataFrame, replaced: DataFrame | None = None) -> None:
        """Adds chunks (chunk_id, text); they take the place of those with their ids, and of the ids of replaced (chunk_id)."""
        if not self.is_ready():
            return self.index(chunks)
        base, state, self.version = self.manifests.latest(), self._state(), None
        ids = chunks.select(F.col("chunk_id").alias("id"))
        state = self._buried(state, ids if replaced is None else ids.unionByName(replaced.select(F.col("chunk_id").alias("id"))))
        one = self._segment(self._built(chunks), state["next"])
        state = {**state, "next": state["next"] + 1, "segments": [*state["segments"], one], "docs": state["docs"] + one["docs"], "terms": state["terms"] + one["terms"]}
        self.manifests.publish(base, self._tiered(state))

    def delete(self, ids: DataFrame) -> None:
        """Documents of ids (chunk_id) no longer count."""
        base, state, self.version = self.manifests.latest(), self._state(), None
        self.manifests.publish(base, self._tiered(self._buried(state, ids.select(F.col("chunk_id").alias("id")))))

    def _tier(self, segment: dict) -> int:
        return int(math.log(max(1, segment["docs"]) / self.smallest, self.fan)) if segment["docs"] > self.smallest else 0

    def _tiered(self, state: dict) -> dict:
        """state with the segments of full tiers merged; all of them, once a third of the documents no longer count."""
        while True:
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(self._tier(s), []).append(s)
            full = [t for t in sorted(tiers) if len(tiers[t]) >= self.fan]
            if 2 * state["dead"] > state["docs"]:
                some = state["segments"]
            elif full:
                some = tiers[full[0]]
            else:
                return state
            state = self._merged(state, some)

    def _merged(self, state: dict, some: list[dict]) -> dict:
        numbers = [s["number"] for s in some]
        one = self._segment(blockmax.merged(self._rows(some), self._gone(state)), state["next"])
        rest = [s for s in state["segments"] if s["number"] not in numbers]
        gone, dead = None, 0
        if state["gone"]:
            left = self.spark.read.schema("shard long, place int").parquet(f"{self.path}/{state['gone']}").where(~F.shiftright("shard", 44).isin(numbers))
            at = self.manifests.folder()
            left.write.parquet(f"{self.path}/{at}")
            dead = self.spark.read.schema("shard long, place int").parquet(f"{self.path}/{at}").count()
            gone = at if dead else None
        return {**state, "next": state["next"] + 1, "segments": [*rest, one] if one["docs"] else rest, "gone": gone, "dead": dead}

    def clean(self, keep: int = 1) -> list[str]:
        """Deletes older versions and files that no version names."""
        return self.manifests.clean(lambda m: {s["at"] for s in m.get("segments", [])} | ({m["gone"]} if m.get("gone") else set()), keep)

    def search(self, queries: DataFrame, k: int, pad: bool = True) -> DataFrame:
        """(query_id, chunk_id, score, rank) as search.bm25() gives them; queries (query_id, text)."""
        state = self._state()
        kind = dict(queries.dtypes)["query_id"]
        if not state["segments"]:
            return S.ranked(self.spark.createDataFrame([], f"query_id {kind}, chunk_id long, score double"), k)
        index, gone = self._rows(state["segments"]), self._gone(state)
        asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        held = blockmax.frequencies(index, asked, gone)
        d = F.col("df")
        weight = F.col("qf") * F.log(1 + (state["docs"] - d + 0.5) / (d + 0.5))
        own = asked.join(S.small(held), "term").select("query_id", "term", weight.alias("weight"))
        shards = sum(-(-x["docs"] // blockmax.SHARD_DOCS) for x in state["segments"])
        parts = min(16, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // max(1, shards)))
        hits = blockmax.search(index, own, k, Bm25(state["terms"] / max(1, state["docs"]), self.k1, self.b), places=6, gone=gone, parts=parts)
        hits = hits.select("query_id", F.col("id").alias("chunk_id"), "score")
        if pad:
            # a query with fewer than k hits finds k more chunks without a hit among the first 2 k ids
            low = blockmax.lowest(index, 2 * k, gone).select(F.nullif(F.col("id"), F.lit(blockmax.NULL_ID)).alias("chunk_id"))
            zero = queries.select("query_id").join(F.broadcast(low)).withColumn("score", F.lit(0.0))
            hits = hits.unionByName(zero).groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
        return S.ranked(hits, k)


class WeightedIndex(_OnDisk):
    """Terms with weights of any encoder: (chunk_id, term_id, weight); queries (query_id, term_id, weight)."""

    def index(self, chunks: DataFrame) -> None:
        chunks.select("chunk_id", "term_id", "weight").repartitionByRange("term_id", "chunk_id").sortWithinPartitions("term_id").write.mode("overwrite").parquet(f"{self.path}/vectors")
        chunks.agg(F.countDistinct("chunk_id").alias("n")).write.mode("overwrite").parquet(f"{self.path}/stats")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return S.sparse_dot(self._read("vectors"), S.small(queries), k)


KINDS = {"bm25": Bm25Index, "splade": WeightedIndex}


def opened(spark: SparkSession, path: str, kind: str = "bm25") -> SparseIndex:
    """The index at path; an unknown kind is bm25."""
    return KINDS.get(kind.lower(), Bm25Index)(spark, path)


def described(index: SparseIndex) -> str:
    return json.dumps({"kind": type(index).__name__, "ready": index.is_ready(), "documents": index.document_count()})
