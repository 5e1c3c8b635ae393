"""Tables that a query writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own, removed when the driver ends; in spark.checkpoint.dir, or else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/corpuslode-scratch/{name}-{uuid.uuid4().hex}"

    def end() -> None:
        with contextlib.suppress(Exception):  # the session may have ended
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

    atexit.register(end)
    return path
