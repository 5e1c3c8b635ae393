"""Summary trees: vectors are clustered layer by layer, each cluster becomes a node above; search over all nodes, or down the layers."""

from __future__ import annotations

from math import log

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.operators.rollup import mean_vectors
from corpuslode.operators.scratch import scratch
from corpuslode.operators.search import dense, dot, ranked, small


def _clustered(nodes: DataFrame, n: int, dims: int, most: int, seed: int) -> DataFrame:
    """(node_id, cluster) of nodes, soft: every cluster with a probability over 0.1; their number by the least BIC."""
    rows = nodes.select("node_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v")).cache()
    try:
        flat = PCA(k=dims, inputCol="v", outputCol="features").fit(rows).transform(rows)
        best = None
        for k in range(2, max(most, 2) + 1):
            model = GaussianMixture(k=k, seed=seed, maxIter=20).fit(flat)
            free = k * (dims + dims * (dims + 1) / 2) + k - 1
            bic = free * log(n) - 2 * model.summary.logLikelihood
            if best is None or bic < best[0]:
                best = bic, model
        p = best[1].transform(flat).select("node_id", F.posexplode(vector_to_array("probability")).alias("cluster", "p"))
        return p.where("p > 0.1").select("node_id", "cluster")
    finally:
        rows.unpersist()


def build(leaves: DataFrame, layers: int = 5, dims: int = 4, most: int = 6, seed: int = 7) -> DataFrame:
    """(node_id, layer, text, embedding, parents) of leaves (node_id, text, embedding), layer 0 included.

    A node above stands for a cluster: the mean of its children's vectors, and as its summary the first 20 of their first
    sentences in order. A node names its parents, `most` at best, so no row grows with a cluster. It ends with `layers`
    layers or when there are no more than dims + 1 nodes left to cluster. Layers are written to the shared folder.
    """
    spark = leaves.sparkSession
    own = ["node_id", "layer", "text", "embedding"]
    now = leaves.select(F.col("node_id").cast("long").alias("node_id"), F.lit(0).alias("layer"), "text", F.col("embedding").cast("array<double>").alias("embedding"))
    out, none = None, F.array().cast("array<long>")
    for layer in range(1, layers + 1):
        n = now.count()
        if n <= dims + 1:
            break
        member = written(spark, _clustered(now, n, dims, min(most, n - 1), seed).withColumn("up", -(F.lit(layer * 1_000_000) + F.col("cluster") + 1).cast("long")), "tree-members")
        parents = member.groupBy("node_id").agg(F.array_sort(F.collect_set("up")).alias("parents"))
        part = now.join(parents, "node_id", "left").select(*own, F.coalesce("parents", none).alias("parents"))
        out = part if out is None else out.unionByName(part)
        both = member.join(now, "node_id")
        first = F.regexp_extract("text", r"^(.*?[.!?])(?:\s|$)", 1)
        lines = both.select("up", "node_id", F.when(first != "", first).otherwise(F.substring("text", 1, 200)).alias("line"))
        # the first 20 are cut in every task before they are dealt
        lines = lines.withColumn("r", F.row_number().over(Window.partitionBy("up").orderBy("line", "node_id"))).where("r <= 20")
        texts = lines.groupBy("up").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), " ").alias("text"))
        up = mean_vectors(both.select("up", "embedding"), ["up"]).join(texts, "up", "left")
        now = written(spark, up.select(F.col("up").alias("node_id"), F.lit(layer).alias("layer"), F.coalesce("text", F.lit("")).alias("text"), "embedding"), "tree-layer")
    last = now.select(*own, none.alias("parents"))
    return last if out is None else out.unionByName(last)


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collapsed(tree: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best nodes of all layers for each query, by cosine."""
    return dense(tree.select(F.col("node_id").alias("chunk_id"), "embedding"), queries, k, cosine=True)


def descended(tree: DataFrame, queries: DataFrame, k: int, layers: int) -> DataFrame:
    """The k best leaves found from the top layer down: at each, the children of the 2 k best nodes go on."""
    unit = lambda c: F.transform(c, lambda x: x / F.sqrt(dot(c, c)))
    nodes = tree.select(F.col("node_id").alias("chunk_id"), "layer", unit(F.col("embedding").cast("array<double>")).alias("e"), "parents")
    q = small(queries.select("query_id", unit(F.col("embedding").cast("array<double>")).alias("q")))
    at = nodes.where(F.col("layer") == layers).join(q)
    for layer in range(layers, -1, -1):
        scored = at.select("query_id", "chunk_id", F.round(dot(F.col("q"), F.col("e")), 6).alias("score"))
        best = ranked(scored, 2 * k if layer else k)
        if not layer:
            return best
        below = nodes.where(F.col("layer") == layer - 1).withColumn("parent", F.explode("parents"))
        ups = small(best.select("query_id", F.col("chunk_id").alias("parent")))
        at = below.join(ups, "parent").select("query_id", "chunk_id", "e").distinct().join(q, "query_id")
    raise ValueError("layers must be 0 or more")
