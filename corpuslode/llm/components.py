"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import drop, stage_at

#: Parts that the edges of one node are dealt to, so that a hub is not one task's work.
SALTS = 16


def _with_least(edges: DataFrame, own: bool) -> DataFrame:
    """edges (u, v) with `m`, the least v of u (and u itself, if own); sums go up before rows move, hubs are salted."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    if own:
        least = least.withColumn("m", F.least("u", "m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def connected(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the component's smallest node, itself included.

    Each round is written to the shared folder; it ends when a round changes nothing. Nulls and loops are dropped.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e, path = stage_at(e, "edges")
    seen = None
    while True:
        large = _with_least(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))), True)
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large, False)
        pairs = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
        small = small.select(F.explode(pairs).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        e, now = stage_at(small, "edges")
        drop(spark, path)
        path = now
        got = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == seen or got[0] == 0:
            break
        seen = got
    roots = e.groupBy("u").agg(F.min("v").alias("v"))
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
