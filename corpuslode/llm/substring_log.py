"""Incremental substring deduplication: a log-structured index of the word windows seen so far.

The index is a table of super-windows (superwindows.py) of earlier documents, a content once with its first place. It is a
list of immutable runs: each batch adds one, a file a bucket, sorted by minimiser. A new batch, of ids not below those before,
is merge-joined with the runs under its own minimisers, bucket by bucket: history is neither dealt nor written again. Equal contents repeat; different ones under one
minimiser are compared by their nodes and windows; spans are verified against the texts, which the log holds too, bucketed
by document. From `most_runs` runs on, the runs are compacted into one. A log is a folder and outlives the job.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

from corpuslode.llm.common import bucketed, drop, freed, id_ranges, id_text, new_path, read_json, result, stage, stage_at, write_json
from corpuslode.llm.superwindows import COMPARE, HISTORY, NEW, ROWS, Units, by_document, claims_of, refined, rows, settled, spans, verified, with_salt

#: Windows of a node.
NODE = 4
TEXTS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("id", LongType()), StructField("salt", LongType())])


class WindowLog:
    """A log at a path, new or reopened. Its settings are those it was made with."""

    def __init__(self, spark: SparkSession, path: str, window: int = 20, k: int = 5, most_runs: int = 4) -> None:
        self.spark, self.path = spark, path
        self.state = read_json(spark, f"{path}/log.json") or {"window": window, "k": k, "most_runs": most_runs, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "texts": f"texts-{uuid.uuid4().hex}", "index": None, "runs": 0}
        self.units = Units(self.state["window"], self.state["k"], NODE, words=True)

    @property
    def runs(self) -> int:
        return self.state["runs"]

    def texts(self) -> DataFrame:
        """(doc_id, text, id, salt) of every document so far."""
        return self.spark.table(bucketed(self.spark, f"{self.path}/{self.state['texts']}", TEXTS, ["id", "salt"], self.state["buckets"]))

    def _table(self, index: str) -> str:
        return bucketed(self.spark, f"{self.path}/{index}", _parse_datatype_string(ROWS), ["m"], self.state["buckets"], ["m", "c"])

    def index(self) -> DataFrame:
        """The rows of all runs."""
        return self.spark.table(self._table(self.state["index"])) if self.state["index"] else self.spark.createDataFrame([], ROWS)

    def met(self, found: DataFrame) -> DataFrame:
        """The rows of the index under minimisers that a batch has: a merge join in which only the batch's are dealt."""
        return self.index().join(found.where(F.col("kind") == NEW).select("m").distinct(), "m", "left_semi").select(*found.columns)

    def add(self, docs: DataFrame) -> DataFrame:
        """Rows of kind REPEAT and COMPARE of docs (doc_id, text) against all before; docs become history."""
        docs = with_salt(id_text(docs))
        texts = self.texts()
        docs.repartition(self.state["buckets"], "id", "salt").select(*texts.columns).write.insertInto(bucketed(self.spark, f"{self.path}/{self.state['texts']}", TEXTS, ["id", "salt"], self.state["buckets"]))
        found, path = stage_at(rows(docs, self.units), "log-batch")
        both = stage(settled(found, self.met(found)), "log-merge")
        drop(self.spark, path)
        index = self.state["index"] or f"index-{uuid.uuid4().hex}"
        unseen = both.where(F.col("kind") == NEW).withColumn("kind", F.lit(HISTORY))
        unseen.repartition(self.state["buckets"], "m").write.insertInto(self._table(index))
        self._keep(index, self.runs + 1)
        if self.runs >= self.state["most_runs"]:
            self.compact()
        return both.where(F.col("kind") != NEW)

    def compact(self) -> None:
        """Merges all runs into one, bucket by bucket; each content keeps its first place."""
        old, new = self.state["index"], f"index-{uuid.uuid4().hex}"
        first = self.index().groupBy("m", "c").agg(F.min(F.struct("id", "start", "salt", "len")).alias("at"))
        zero = [F.lit(0).cast("long").alias(x) for x in ("rid", "rsalt", "rstart")]
        first.select(F.lit(HISTORY).alias("kind"), "m", "c", "at.id", "at.salt", "at.start", "at.len", *zero).write.insertInto(self._table(new))
        self._keep(new, 1)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(old)}")
        drop(self.spark, f"{self.path}/{old}")

    def _keep(self, index: str, runs: int) -> None:
        self.state |= {"index": index, "runs": runs}
        write_json(self.spark, f"{self.path}/log.json", self.state)


def removals(docs: DataFrame, log: WindowLog, batches: int = 1) -> DataFrame:
    """(id, salt, items): the spans (start, len) in words to remove from each document of docs that has some.

    docs are added to the log in `batches` ranges of ascending ids; their ids must not be below those that it holds.
    """
    spark = docs.sparkSession
    ranged = id_ranges(id_text(docs), batches)

    def gone() -> DataFrame:
        both = None
        for i in range(batches):
            more = log.add(ranged.where(F.col("range_id") == i))
            both = more if both is None else both.unionByName(more)
            freed(spark)
        compare = both.where(F.col("kind") == COMPARE).dropDuplicates(["m", "c", "id", "salt", "start"])
        claims = claims_of(both).unionByName(refined(log.texts(), compare, log.units))
        return verified(log.texts(), claims, log.units)

    return by_document(result(spark, "gone", gone), F.col("start"), F.col("len"))


def deduplicate(docs: DataFrame, window: int = 20, k: int = 5, batches: int = 3, most_runs: int = 2, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256) for every row of docs; kept: the words that stay, joined by spaces.

    Every word covered by a window of `window` consecutive words that also starts earlier (smaller doc_id, or same
    document, earlier start) goes. path: of a log that these documents go on with; none: a log of their own, which ends
    with the job. Null and empty texts have no words. A null doc_id counts as the smallest. Of rows that share a doc_id
    equal starts don't precede one another, so repeated rows get one result. Other columns, whatever their names, are left
    out. An empty table gives an empty result.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            total, gone, kept = [], [], []
            for text, items in zip(b.column("text").to_pylist(), b.column("items").to_pylist()):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                total.append(len(own))
                if items:
                    s, e = spans(np.array([x["start"] for x in items]), np.array([x["len"] for x in items]))
                    own = [w for i, j in zip([0, *e.tolist()], [*s.tolist(), len(own)]) for w in own[i:j]]
                gone.append(total[-1] - len(own))
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array([x.decode("utf-8", "surrogatepass") for x in kept], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])], names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"])

    log = WindowLog(docs.sparkSession, path or new_path(docs.sparkSession, "log"), window, k, most_runs)
    items = removals(docs, log, batches)
    # a log of its own has these texts only, bucketed; one at a path may hold more, also of a job that broke off
    own = with_salt(id_text(docs)) if path else log.texts()
    joined = own.join(items, ["id", "salt"], "left").select("doc_id", "text", "items")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
