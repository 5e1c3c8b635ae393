"""The operators as stages of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.llm import langid, nbsvm, packing, set_join, substring_log
from corpuslode.llm.common import new_path, prepare
from corpuslode.llm.superwindows import spans, with_salt
from corpuslode.llm.tokens import released


def _kept(docs: DataFrame, keep: Callable[[str | None], bool]) -> DataFrame:
    """The rows whose whole text is kept, with all their columns."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in it:
            yield b.filter(pa.array([keep(t) for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or a score below the calibrated one.

    Null and empty texts are rejected. Repeated rows stay or go together; rows with a null doc_id are judged like any other.
    All columns stay as they are. An empty table gives an empty one.
    """
    prepare(spark)
    model = langid.fit(docs, ~langid.held_out("doc_id", 3, 1))
    return _kept(docs, lambda t: not model.predict(t)[2])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score below the threshold; learns from their labels.

    Null and empty texts score as texts without words. Repeated rows stay or go together; rows with a null doc_id are judged
    like any other. All columns stay as they are. Without labels of both classes all rows score alike. An empty table gives
    an empty one.
    """
    prepare(spark)
    model = nbsvm.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~nbsvm.held_out("doc_id", 5, 0))
    return _kept(docs, lambda t: model.score(t) >= nbsvm.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component, once; rows without a doc_id belong to no group and stay.

    Texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more link: operator 1's SimHash fingerprints and
    grid join answer for the pairs within two bits, a set join for all others, and all links are counted exactly. Of rows with
    one doc_id, only those go whose own text is a copy. All columns stay as they are, whatever their names. Null and empty
    texts have no shingles and link with nothing else than equal texts. An empty table gives an empty one.
    """
    prepare(spark)
    found = set_join.near_duplicates(docs, 5, 0.8)
    key, own_id, own_hash = F.struct("doc_id", "text_hash"), *(f"{x}_{uuid.uuid4().hex}" for x in ("id", "hash"))  # names that no table has
    first = found.groupBy("component").agg(F.min(key).alias("first"))
    gone = found.join(first, "component").where(key != F.col("first")).select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash)).distinct()
    out = docs.join(gone, (F.col("doc_id").cast("long") == F.col(own_id)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own_hash)), "left_anti")
    again = found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count()
    return out.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(out.where("doc_id is null")) if again else out


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat earlier ones, joined by spaces; untouched texts stay as they are.

    Null and empty texts stay. A null doc_id counts as the smallest; repeated rows get one text. n_chars becomes the new
    length, all other columns stay as they are, whatever their names. An empty table gives an empty one.
    """
    prepare(spark)
    own = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.struct("*").alias("row"))
    log = substring_log.WindowLog(spark, new_path(spark, "log"), most_runs=2)
    items = substring_log.removals(docs, log, batches=3)
    joined = with_salt(own).join(items, ["id", "salt"], "left").select("text", "items", "row")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = b.column("text").to_pylist()
            for k, items in enumerate(b.column("items").to_pylist()):
                if items:
                    s, e = spans(np.array([x["start"] for x in items]), np.array([x["len"] for x in items]))
                    words = out[k].encode("utf-8", "surrogatepass").split()
                    out[k] = b" ".join(w for i, j in zip([0, *e.tolist()], [*s.tolist(), len(words)]) for w in words[i:j]).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column("row")], names=["text", "row"])

    schema = joined.select("text", "row").schema
    new = joined.mapInArrow(run, schema)
    length = lambda c: F.length("text").cast(docs.schema[c].dataType).alias(c)
    return new.select(*[F.col("text") if c == "text" else length(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequences they are packed into; null texts are empty, repeated rows are packed as
    often as they come, other columns are left out, an empty table gives an empty one."""
    prepare(spark)
    return packing.pack(docs)
