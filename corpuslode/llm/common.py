"""What the operators of this folder share: tables in the shared folder, narrow inputs, ranges of ids."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows and bytes that go to a Python worker at once; whole texts can be long.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20
#: Of tables that only their own job reads: on a local file system no checksum file and no program for permissions beside each
#: file. (Without Hadoop's native library that file system starts programs for every file; other file systems ignore this.)
SCRATCH = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Paths that new_path() has given out and result() has not deleted.
_MADE: list[str] = []


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches, so that a worker's memory does not depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only on one machine whose session names none (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpuslode-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, p = _filesystem(spark, path)
        fs.delete(p, True)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, p = _filesystem(spark, path)
    if not fs.exists(p):
        return None
    return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(fs.open(p))))


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes a small file of the driver's own in one step."""
    fs, p = _filesystem(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value).encode()))
    out.close()


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/corpuslode/{name}-{uuid.uuid4().hex}"
    _MADE.append(path)

    def end() -> None:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: there is nothing to call any more
            return

    atexit.register(end)
    return path


def result(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns, written as a table; every table that make() stages on the way is deleted then."""
    path, before = new_path(spark, name), len(_MADE)
    df = make()
    df.write.options(**SCRATCH).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    drop(spark, *_MADE[before:])
    del _MADE[before:]
    freed(spark)
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it: cuts lineage, and survives lost executors."""
    return stage_at(df, name)[0]


def stage_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**SCRATCH).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def trimmed() -> None:
    """Gives the driver's freed Python memory back to the system, where the C library can."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done with; it does so once the driver collects its garbage."""
    trimmed()
    spark._jvm.System.gc()


def bucketed(spark: SparkSession, path: str, schema: StructType, keys: list[str], n: int, order: list[str] | None = None) -> str:
    """The name of a Parquet table at path, made if missing: n buckets by keys, read without an exchange where these count."""
    name = f"corpuslode_{hashlib.sha256(path.encode()).hexdigest()[:24]}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    by = ", ".join(keys)
    inside = f" SORTED BY ({', '.join(order)})" if order else ""
    options = ", ".join(f"'{k}' '{v}'" for k, v in {"compression": "zstd", **SCRATCH}.items())
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet OPTIONS ({options}) CLUSTERED BY ({by}){inside} INTO {n} BUCKETS LOCATION '{path}'")
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id and text: other columns, whatever their names, don't reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def partitions(df: DataFrame, least: int = 1) -> int:
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def id_ranges(df: DataFrame, n: int, column: str = "doc_id") -> DataFrame:
    """Adds `range_id`: n ranges of about as many rows, ascending with the column; null ids go to the first.

    The bounds are n-1 approximate quantiles of that one column (Greenwald-Khanna, merged from the partitions).
    """
    from pyspark.ml.feature import Bucketizer

    bounds = df.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    splits = [float("-inf"), *sorted(set(bounds)), float("inf")]
    if len(splits) < 3:
        return df.withColumn("range_id", F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="_at", outputCol="_range")
    out = cut.transform(df.withColumn("_at", F.coalesce(F.col(column).cast("double"), F.lit(-1.7e308))))
    return out.withColumn("range_id", F.col("_range").cast("int")).drop("_at", "_range")


def words(text: str | None) -> list[bytes]:
    """[^\\x20\\x09-\\x0D]+ of a text's UTF-8 bytes."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def batches(it: Iterator, *names: str) -> Iterator[tuple[list, ...]]:
    for b in it:
        yield tuple(b.column(n).to_pylist() for n in names)


def runs(it: Iterator, keys: list[str]) -> Iterator[tuple]:
    """Of batches sorted by keys: (batch, bounds), whole groups only; group g has the rows bounds[g] to bounds[g + 1].

    Holds the rows of a batch and of one group at most.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    held: list = []

    def cut(t: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for k in keys:
            c = t.column(k)
            new |= pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.nonzero(new)[0] + 1]).astype(np.int64)

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.concat_batches(held)

    for b in it:
        if not b.num_rows:
            continue
        if held and any(b.column(k)[0] != held[-1].column(k)[held[-1].num_rows - 1] for k in keys):
            t = joined()
            yield t, np.array([0, t.num_rows])
            held = []
        starts = cut(b)
        if len(starts) > 1:
            t = pa.concat_batches([*held, b.slice(0, int(starts[-1]))])
            yield t, np.concatenate([[0], starts[1:-1] + (t.num_rows - starts[-1]), [t.num_rows]]) if held else np.append(starts[:-1], t.num_rows)
            held = [b.slice(int(starts[-1]))]
        else:
            held.append(b)
    if held:
        t = joined()
        yield t, np.array([0, t.num_rows])
