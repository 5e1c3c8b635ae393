"""SimHash near-duplicates: fingerprints, a grid over per-segment bit counts, exact check by one-bit midpoints.

A fingerprint of 64 bits is mapped to the bit counts of its 16 segments of 4 bits. The Manhattan distance of two such
vectors is a lower bound of the Hamming distance of the fingerprints, so links of at most 2 bits join grid points at most
2 apart: they share a grid point at most 1 from both. Fingerprints that share none with another are out. The rest are
verified exactly: two fingerprints differ in at most 2 bits if and only if some 64-bit word differs from each in at most
one. Of all words that do so for a fingerprint only those in a grid cell that it shares are made. A word has at most 65
fingerprints around it, so no group grows with the input and nothing is paired that does not link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import batches, id_text, partitions, stage
from corpuslode.llm.components import connected

SEGMENTS, WIDTH = 16, 4


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """XXH64 (seed 42) of every n-word shingle, repeats included; fewer words: of the whole sequence; none: nothing."""
    if not words:
        return np.zeros(0, np.uint64)
    text = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(text, 42)], np.uint64)
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(text[i : j - 1], 42) for i, j in zip(starts, starts[n:])), np.uint64, len(words) - n + 1)


def simhash(hashes: np.ndarray) -> int:
    """The word whose bits are those set in over half of the hashes; zero of none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum()) if len(hashes) else 0


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row of docs; a null text has no words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in batches(it, "doc_id", "text"):
            fps = np.array([simhash(shingle_hashes(t.encode().lower().split() if t else [], shingle)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, every: bool = False) -> DataFrame:
    """(a, b): nodes of distinct fingerprints (node, fp) at 2 or fewer differing bits; chains of them keep every component.

    With `every`, all such pairs, a < b: at most 2,080 a fingerprint.
    """
    counts = [F.bit_count(F.shiftrightunsigned("fp", WIDTH * i).bitwiseAND((1 << WIDTH) - 1)).cast("long") for i in range(SEGMENTS)]
    # a few small files hold all fingerprints: dealt out before each becomes 33 rows
    grid = fps.repartition(partitions(fps), "fp").select("node", "fp", F.array(*counts).alias("p"))
    at = sum((F.shiftleft(c, 3 * i) for i, c in enumerate(counts[1:], 1)), counts[0])
    grid = grid.withColumn("at", at)
    near = [F.struct(F.lit(-1).alias("seg"), F.lit(False).alias("up"), F.col("at").alias("cell"))]
    for i in range(SEGMENTS):
        near += [F.when(F.col("p")[i] < WIDTH, F.struct(F.lit(i).alias("seg"), F.lit(True).alias("up"), (F.col("at") + (1 << 3 * i)).alias("cell")))]
        near += [F.when(F.col("p")[i] > 0, F.struct(F.lit(i).alias("seg"), F.lit(False).alias("up"), (F.col("at") - (1 << 3 * i)).alias("cell")))]
    cells = grid.select("node", "fp", F.explode(F.filter(F.array(*near), lambda x: x.isNotNull())).alias("c")).select("node", "fp", "c.*")
    shared = cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    cells = cells.join(shared, "cell", "left_semi")
    # A step up in a segment sets one of its clear bits, a step down clears one of its set bits.
    offsets = F.array(*[F.lit(j) for j in range(WIDTH)])
    flips = F.transform(F.filter(offsets, lambda j: F.bit_get(F.col("fp"), F.col("seg") * WIDTH + j) == F.when(F.col("up"), 0).otherwise(1)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("seg") * WIDTH + j)))
    mid = cells.select("node", F.explode(F.when(F.col("seg") < 0, F.array("fp")).otherwise(flips)).alias("mid"))
    around = mid.groupBy("mid").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
    if every:
        return around.select(F.explode("nodes").alias("a"), "nodes").select("a", F.explode("nodes").alias("b")).where("a < b").distinct()
    return around.select(F.array_min("nodes").alias("a"), F.explode("nodes").alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    Null and empty texts have fingerprint zero and link like any other. Rows with a null doc_id are returned; they take
    part in links through the others of the same fingerprint, and have a null component if there are none. Repeated rows
    are returned as often as they come. Other columns, whatever their names, are left out. An empty table gives an empty
    result.
    """
    fps = stage(fingerprints(docs, shingle), "simhash")
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-distinct")
    found = connected(links(distinct.where("node is not null")), "a", "b")
    named = distinct.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
