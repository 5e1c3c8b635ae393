"""Where results go: a folder a document, side outputs with a manifest, envelopes for a stream, reports, nowhere."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of an envelope that a queue takes.
LARGEST = 1 << 20


def write_documents(records: DataFrame, path: str, relative: str = "path") -> None:
    """records as JSON below path, in a folder of each document's relative path."""
    records.withColumn("document", F.regexp_replace(relative, r"\.[^./]*$", "")).write.mode("overwrite").partitionBy("document").json(path)


def low_confidence(records: DataFrame) -> DataFrame:
    return records.where("is_low_confidence")


def manifest(records: DataFrame) -> DataFrame:
    """One row: counts, and the low-confidence records' paths and confidences, least confident first."""
    low = F.when(F.col("is_low_confidence"), F.struct("avg_confidence", "path"))
    return records.agg(
        F.count("*").alias("total"),
        F.sum(F.col("is_low_confidence").cast("int")).alias("low"),
        F.array_sort(F.collect_list(low)).alias("files"),
    )


def write_with_manifest(records: DataFrame, path: str) -> None:
    """records to path/all, the low-confidence ones to path/low_confidence, the manifest to path/manifest."""
    records.write.mode("overwrite").json(f"{path}/all")
    low_confidence(records).write.mode("overwrite").json(f"{path}/low_confidence")
    manifest(records).write.mode("overwrite").json(f"{path}/manifest")


def envelopes(records: DataFrame, service: str, key: str) -> DataFrame:
    """(key, value, oversized): records as JSON messages with an id, a time, their service and the payload."""
    payload = F.struct(*records.columns)
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    body = F.to_json(F.struct(F.uuid().alias("message_id"), at.alias("timestamp"), F.lit(service).alias("source_service"), payload.alias("payload")))
    out = records.select(F.col(key).cast("string").alias("key"), body.alias("value"))
    return out.withColumn("oversized", F.octet_length("value") > LARGEST)


def opened(messages: DataFrame, payload: str) -> DataFrame:
    """(message_id, timestamp, source_service, payload) of envelopes (value); a bare payload is its own envelope."""
    e = F.from_json("value", f"message_id string, timestamp string, source_service string, payload {payload}")
    bare = F.from_json("value", payload)
    own = messages.withColumns({"_e": e, "_b": bare})
    return own.select("_e.message_id", "_e.timestamp", "_e.source_service", F.coalesce("_e.payload", "_b").alias("payload"))


def publish(messages: DataFrame, path: str | None) -> None:
    """Appends messages to a folder of text files, a line each; without a path they go nowhere."""
    if path is None:
        messages.write.format("noop").mode("overwrite").save()
    else:
        messages.select("value").write.mode("append").text(path)


def append_statistics(terms: DataFrame, path: str) -> None:
    """Appends low-confidence terms as lines of JSON."""
    terms.write.mode("append").json(path)


def report(summary: DataFrame, path: str | None = None, most: int = 1000) -> str:
    """A text table of a small summary (a row a dataset), and its rows as JSON at path.

    More than `most` rows are no summary: the table then ends with a line that says how many are left out of it.
    """
    rows = [r.asDict(recursive=True) for r in summary.limit(most + 1).collect()]
    more = summary.count() - most if len(rows) > most else 0
    rows = rows[:most]
    if path:
        summary.coalesce(1).write.mode("overwrite").json(path)
    names = summary.columns
    cells = [names, *[[f"{r[c]:.4f}" if isinstance(r[c], float) else "" if r[c] is None else json.dumps(r[c]) if isinstance(r[c], (list, dict)) else str(r[c]) for c in names] for r in rows]]
    wide = [max(len(x[k]) for x in cells) for k in range(len(names))]
    lines = ["  ".join(v.ljust(n) for v, n in zip(x, wide)).rstrip() for x in cells]
    return "\n".join([*lines, *([f"... {more} more rows"] if more else [])])
