"""Token ids in ORC files: run-length encoded integers, row indexes, Bloom filters on document ids.

Documents lie in ascending order of ids: over the files, and within each. A file holds its part of the order and counts from
its own start; what lies before a part is the sum of the parts before it, read from a table with a row a part. Readers
take stripes in parallel, and skip files, stripes and row groups by their statistics and Bloom filters (`lookup`).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.llm.common import id_text, partitions
from corpuslode.llm.tokens import encoder, public

OPTIONS = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20), "orc.compress": "ZSTD"}
#: Files whose starts are broadcast; of more, they are joined by a shuffle.
MOST_FILES = 100_000
FILE = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def lists(data: list[bytes]) -> pa.ListArray:
    """Little-endian 32-bit ids as a list column."""
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in data])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(data), "<i4")))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, files: int | None = None) -> None:
    """Encodes every whole text of docs, adds `end` to each, and writes ORC files to path.

    Null texts are empty. Null ids come first; rows of one id come by a hash of their texts, so their starts are the same each
    time. Repeated rows are written as often as they come. Other columns, whatever their names, are left out. An empty
    table gives files without rows.
    """
    place, last = tokenizer or public("word_bpe_49k.json"), np.array([end], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, part, start = encoder(place, False), TaskContext.get().partitionId(), 0
        for b in it:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 500):
                data = [code.encode(t) + last for t in texts[lo : lo + 500]]
                n = np.array([len(x) // 4 for x in data], np.int64)
                starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), b.column("doc_id").slice(lo, len(n)), pa.array(starts), pa.array(n), lists(data)], names=["part", "doc_id", "local_start", "n_tokens", "ids"])

    rows = id_text(docs).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(files or partitions(rows), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(run, FILE).write.options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before it; a row for each row written.

    Null ids are first, repeated ones beside one another. Files without rows give an empty result.
    """
    rows = spark.read.schema(FILE).orc(path)
    before = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # a row a part: few, and one task adds them up
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # a broadcast of 16 bytes a file, up to a checked number of files: the ids then stay where they are read
    if before.count() <= MOST_FILES:
        before = F.broadcast(before)
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents, all of an id that repeats, none of an id that is not there.

    Files, stripes and row groups without them are pruned by their metadata. A null id can't be asked for.
    """
    return spark.read.schema(FILE).orc(path).where(F.col("doc_id").isin(ids))


def digests(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read() returns, row by row; other columns are left out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column("ids")
            offsets = ids.offsets.to_numpy()
            data = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            crc = [zlib.crc32(data[i:j]) for i, j in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
