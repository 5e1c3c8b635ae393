"""The vector index against brute force."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslode.operators import search as S
from corpuslode.operators import vectors as V

SF = "/root/testdata/sf0.01"


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, embedding array<double>")


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("kind", ["clustered", "random", "one direction"])
def test_recall_against_brute_force(spark, tmp_path, kind, cosine):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 18))
    if kind == "clustered":
        x = rng.normal(size=(40, 18))[rng.integers(0, 40, 3000)] * 3 + x
    if kind == "one direction":
        x[:1000] = x[0]  # a third of all rows are one vector
    rows = table(spark, x).repartition(5)
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    index.build(rows, cosine, sample=1500)
    q = rows.where("id % 50 = 7").select(F.col("id").alias("query_id"), "embedding")
    own = rows.select(F.col("id").alias("chunk_id"), "embedding")
    truth = S.dense(own, q, 10, cosine)
    found = V.VectorIndex(spark, str(tmp_path / "i")).search(q, 10)
    least = truth.groupBy("query_id").agg(F.min("score").alias("least"))
    # of equal scores any may be found: a hit scores no less than the tenth
    good = found.join(least, "query_id").where("score >= least").count()
    assert good >= 0.9 * truth.count() and found.count() == truth.count()
    everything = index.search(q, 10, probes=1 << 20, candidates=3000)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, truth.collect()))
    assert sum(r.n for r in spark.read.parquet(f"{tmp_path}/i/data/*/codes").groupBy().agg(F.countDistinct("id").alias("n")).collect()) == 3000


def test_a_search_reads_a_part_of_the_codes(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 12)) * 10
    x = centres[np.repeat(np.arange(30), 100)] + rng.normal(size=(3000, 12))
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    index.build(table(spark, x))
    state = index.manifests.read()
    assert state["probes"] * 4 < len(V.Books.loaded(state).centres) and state["candidates"] < 1000


def test_empty_and_few_vectors(spark, tmp_path, monkeypatch):
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    with pytest.raises(RuntimeError):
        index.search(table(spark, np.eye(3)).withColumnRenamed("id", "query_id"), 3)
    index.build(table(spark, np.eye(3)).limit(0))
    q = table(spark, np.eye(3)).withColumnRenamed("id", "query_id")
    assert index.search(q, 3).count() == 0
    index.build(table(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, None)], "id long, embedding array<double>")))
    monkeypatch.setattr(V, "PASS", 2)
    got = index.search(q, 1).collect()
    assert {(r.query_id, r.chunk_id, r.score) for r in got} == {(i, i, 1.0) for i in range(3)} and index.search(q.limit(0), 1).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_recall_on_the_embeddings(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    index.build(e)
    q = e.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    assert V.recall(index.search(q, 10), S.dense(e.withColumnRenamed("id", "chunk_id"), q, 10)) >= 0.9


def test_candidates_are_tuned_for_depth_and_all_rows(spark, tmp_path):
    """The sample's neighbours lie farther than those among all rows; small files of codes make no tasks of their own."""
    x = np.random.default_rng(4).normal(size=(6000, 16))
    books = V.Books.trained(x[:600], 20)
    few, many = (V.tuned(books, x[:600], 30, 0.97, n)[1] for n in (600, 6000))
    assert many > 1.5 * few
    rows = table(spark, x)
    index = V.VectorIndex(spark, str(tmp_path / "i"))
    index.build(rows, sample=600, k=30)
    q = rows.where("id % 100 = 0").withColumnRenamed("id", "query_id")
    found = index.search(q, 30)
    assert V.recall(found, S.dense(rows.withColumnRenamed("id", "chunk_id"), q, 30)) >= 0.9
    assert "Coalesce 1" in found._jdf.queryExecution().executedPlan().toString()
