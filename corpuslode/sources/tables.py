"""Writes as whole new versions of a table: upsert, cascade delete, added columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and old's without their keys; columns that one side lacks are null there."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def updated(old: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """old with the non-null values of changes in their columns."""
    own = [c for c in changes.columns if c not in keys]
    joined = old.join(changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in own]), keys, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in own else F.col(c) for c in old.columns])


def delete_by_hash(rows: DataFrame, hashes: DataFrame, key: str) -> DataFrame:
    """rows but those whose key is one or more characters, then one of the hashes (as LIKE '%_hash' reads)."""
    lengths = [r[0] for r in hashes.select(F.length("hash")).distinct().collect()]  # a few lengths
    out = rows
    for n in lengths:
        h = hashes.where(F.length("hash") == n).select(F.col("hash").alias("_hash")).distinct()
        out = out.join(h, (F.expr(f"right(`{key}`, {n})") == F.col("_hash")) & (F.length(key) > n), "left_anti")
    return out


def migrate(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """rows with the columns (name: type) that they lack, null; running it again changes nothing."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c.lower() not in have})


def delete_cascade(documents: DataFrame, headings: DataFrame, chunks: DataFrame, hashes: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents of those hashes and what belongs to them, and one row: how many documents went."""
    kept = delete_by_hash(documents, hashes, key)
    gone = documents.select(key).join(kept.select(key), key, "left_anti").distinct()
    rest = [t.join(gone, key, "left_anti") for t in (headings, chunks)]
    return kept, *rest, gone.agg(F.count("*").alias("deleted"))
