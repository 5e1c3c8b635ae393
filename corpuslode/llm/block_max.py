"""Ranked lexical search by Block-Max WAND (operators/blockmax.py) in whole numbers.

Impacts depend on the collection's statistics, so these are counted first; then a block stores its greatest impact. A term's
weight needs the number of documents that hold it, which the blocks' own counts add up to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.llm.common import SCRATCH, id_text, read_json, write_json
from corpuslode.operators import blockmax

#: ASCII letters in lower case, digits and all bytes of other characters make terms; whatever else is ASCII separates them.
TERMS = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 128 else 0 for i in range(256)], np.uint8)


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after the other, and where each text's begin and end; a null text has none."""
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    held = column.buffers()[2]
    data = TERMS[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = data > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]  # a term never goes on in the next text
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - starts)])
    values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return values, np.searchsorted(starts, offsets)


class Score:
    """(10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L, n a document's terms of L in N documents."""

    def __init__(self, documents: int, total: int) -> None:
        self.documents, self.total = documents, max(1, total)

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 10 + (90 * length.astype(np.int64) * self.documents) // self.total
        return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 8 * m)


def _rows(docs: DataFrame) -> DataFrame:
    return id_text(docs).select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("terms"))


def _counted(docs: DataFrame) -> tuple[int, int]:
    """Documents with terms, and terms with repeats."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = np.diff(terms(b.column("terms"))[1])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "total"])

    got = _rows(docs).mapInArrow(run, "docs long, total long").agg(F.sum("docs"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


def write(docs: DataFrame, path: str) -> None:
    """The index of docs (doc_id, text) at path, and its statistics.

    Null and empty texts have no terms and are never found. Rows that share a doc_id are documents of their own. Other columns,
    whatever their names, are left out. An empty table gives an index in which nothing is found.
    """
    documents, total = _counted(docs)
    blockmax.build(_rows(docs), terms, Score(documents, total)).write.options(**SCRATCH).option("compression", "zstd").parquet(f"{path}/blocks")
    write_json(docs.sparkSession, f"{path}/statistics.json", {"documents": documents, "total": total})


def search(spark: SparkSession, path: str, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of the index at path for each of items (item_id, text).

    Only scores above 0 count; equal ones rank by ascending doc_id, a null doc_id first. An item's terms count once each; rows
    of one item_id are one item. Items without terms, or whose terms no document holds, give no row.
    """
    stats = read_json(spark, f"{path}/statistics.json")
    index = spark.read.schema(blockmax.SCHEMA).parquet(f"{path}/blocks")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            values, bounds = terms(b.column("text"))
            item = b.column("item_id").take(pa.array(np.repeat(np.arange(b.num_rows), np.diff(bounds))))
            yield pa.RecordBatch.from_arrays([item, values.cast(pa.binary())], names=["item_id", "term"])

    kind = dict(items.dtypes)["item_id"]
    own = items.select("item_id", F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, f"item_id {kind}, term binary")
    own = own.select("item_id", F.col("term").cast("string").alias("term")).distinct()
    held = blockmax.frequencies(index, own)
    weight = F.floor(1000 * F.log(F.lit(2.0 * stats["documents"] + 2) / (2.0 * F.col("df") + 1)))
    asked = own.join(F.broadcast(held), "term").select(F.col("item_id").alias("query_id"), "term", weight.cast("long").alias("weight")).where("weight > 0")
    hits = blockmax.search(index, asked, k, Score(stats["documents"], stats["total"]), exact=True)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.select(F.col("query_id").alias("item_id"), F.row_number().over(best).alias("rank"), F.col("id").alias("doc_id"), "score")
