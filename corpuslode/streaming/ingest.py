"""Streaming ingest of extraction records: a folder of JSON files becomes a table of chunks; bad records go to quarantine.

The file source's checkpoint log takes the place of a set of processed files. A micro-batch is written under its batch id,
so one that is run again after a failure replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslode.sources.readers import EXTRACTION, chunk_rows


def incoming(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(source, raw, record) of the JSON files that appear below path, whole files; `record` is null if it can't be read."""
    raw = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw"), F.from_json("value", f"{EXTRACTION}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("record"))


def problem(record: str = "record") -> Column:
    """Why a record can't be ingested; null if it can."""
    r = F.col(record)
    return F.when(r.isNull() | r["_bad"].isNotNull(), "not JSON").when(F.coalesce(r["source_file"], F.lit("")) == "", "no source_file").when(r["headings"].isNull(), "no headings")


def accepted(rows: DataFrame) -> DataFrame:
    """(doc_id, content_hash, headings): good records that have chunks; doc_id: the file's stem and 12 digits of the hash."""
    good = rows.where(problem().isNull()).select("record.*")
    texts = F.flatten(F.transform("headings", lambda h: F.coalesce(F.transform(h["chunks"], lambda c: F.coalesce(c["text"], F.lit(""))), F.array().cast("array<string>"))))
    good = good.where(F.size(texts) > 0).withColumn("content_hash", F.substring(F.sha2(F.array_join(texts, ""), 256), 1, 12))
    stem = F.regexp_replace(F.regexp_extract("source_file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    return good.select(F.concat_ws("_", stem, "content_hash").alias("doc_id"), "content_hash", "headings")


def rejected(rows: DataFrame) -> DataFrame:
    """(source, raw, error): the dead letters."""
    return rows.withColumn("error", problem()).where("error is not null").select("source", "raw", "error")


def attempted(rows: DataFrame, process: Callable[[str], str | None], retries: int = 3) -> DataFrame:
    """rows (source, raw) with `result` and `error`: process(raw) is tried up to `retries` times, the last error is kept."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            results, errors = [], []
            for raw in pdf["raw"]:
                result = error = None
                for _ in range(retries):
                    try:
                        result, error = process(raw), None
                        break
                    except Exception as e:  # noqa: BLE001  whatever a message brings about is its own error
                        error = f"{type(e).__name__}: {e}"
                results.append(result)
                errors.append(error)
            yield pdf.assign(result=results, error=errors)[["source", "raw", "result", "error"]]

    return rows.select("source", "raw").mapInPandas(run, "source string, raw string, result string, error string")


def dead_letters(tried: DataFrame, stream: str, consumer: str) -> DataFrame:
    """What failed every time, as dead letters."""
    kind = F.regexp_extract("error", "^([^:]*): ?", 1)
    message = F.regexp_replace("error", "^[^:]*: ?", "")
    return tried.where("error is not null").select(F.lit(stream).alias("stream"), F.col("source").alias("id"), F.col("raw").alias("data"), kind.alias("error_type"), message.alias("error_message"), F.lit(consumer).alias("consumer"))


def consume(rows: DataFrame, process: Callable[[str], str | None], results: str, letters: str, checkpoint: str, stream: str, consumer: str, retries: int = 3, every: str | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Tries process(raw) on every message of rows (source, raw); results to results/batch=N, what failed `retries` times to letters/batch=N.

    A message that fails every time does not stop the others, and is acknowledged with them. after(N) runs once a batch is written.
    """

    def write(batch: DataFrame, number: int) -> None:
        tried = attempted(batch, process, retries).persist()
        try:
            tried.where("error is null").select("source", "result").write.mode("overwrite").parquet(f"{results}/batch={number}")
            dead_letters(tried, stream, consumer).write.mode("overwrite").parquet(f"{letters}/batch={number}")
        finally:
            tried.unpersist()
        if after:
            after(number)

    out = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def ingest(records: DataFrame, table: str, quarantine: str, checkpoint: str, every: str | None = None, after: Callable[[int], None] | None = None) -> StreamingQuery:
    """Appends the chunks of incoming() to table/batch=N and the dead letters to quarantine/batch=N.

    every: the time between micro-batches ("1 second" debounces as a watcher does); without it, it ends when no record is
    left. after(N) runs once a batch is written, with or without new rows: an index is rebuilt there. The checkpoint is
    what a consumer group's pending list is: a batch that was begun and not ended comes first after a restart.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            once = accepted(batch).dropDuplicates(["content_hash"])
            rows = chunk_rows(once).join(once.select("doc_id", "content_hash"), "doc_id")
            rows.write.mode("overwrite").parquet(f"{table}/batch={number}")
            rejected(batch).write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        finally:
            batch.unpersist()
        if after:
            after(number)

    out = records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def messages(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """(source, raw, record) of the lines of files below path, one message each, bare or in an envelope."""
    raw = spark.readStream.format("text").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return read_messages(raw.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw")))


def read_messages(rows: DataFrame) -> DataFrame:
    """(source, raw, record) of rows (source, raw), stream or not; bad JSON has a null record."""
    options = {"columnNameOfCorruptRecord": "_bad"}
    inner = F.coalesce(F.get_json_object("raw", "$.payload"), F.col("raw"))
    return rows.withColumn("record", F.from_json(inner, f"{EXTRACTION}, _bad string", options))


def current(spark: SparkSession, table: str) -> DataFrame:
    """The chunks of a table that ingest() writes; of equal contents the latest batch's stay."""
    rows = spark.read.parquet(table)
    latest = rows.groupBy("content_hash").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["content_hash", "batch"], "left_semi")
