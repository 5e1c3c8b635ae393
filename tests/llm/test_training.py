"""Models are trained in a task: the driver gets them, not the texts they learn from."""

import random
import tracemalloc

import numpy as np
import pytest

from corpuslode.llm import langid, nbsvm

TEXTS, LENGTH = 800, 12_000


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    words = {x: ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(3000)] for x, letters in (("aa", "abcdefghijklm"), ("bb", "ijklmnopqrstuv"))}
    docs = [(i, " ".join(r.choices(words["ab"[i % 2] * 2], k=LENGTH // 6))[:LENGTH], "ab"[i % 2] * 2) for i in range(TEXTS)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(TEXTS)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")


def driver_peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_language_model_is_trained_off_the_driver(tables):
    docs, _ = tables
    use = ~langid.held_out("doc_id", 3, 1)
    model, peak = driver_peak(lambda: langid.fit(docs, use))
    assert peak < 0.6 * TEXTS * LENGTH  # less than the texts of the sample alone, two thirds of all
    texts, langs = langid.sample_of(docs, docs.where(use).select("doc_id", "lang"), "lang", 1500)
    assert len(texts) > TEXTS / 2
    own = langid.train(texts, langs)
    assert np.allclose(model.table, own.table, rtol=1e-3, atol=1e-5) and np.allclose(model.bias, own.bias, rtol=1e-4) and np.allclose([model.temperature, model.reject_below], [own.temperature, own.reject_below], rtol=1e-3)


def test_quality_model_is_trained_off_the_driver(tables):
    docs, labels = tables
    use = ~nbsvm.held_out("doc_id", 5, 0)
    model, peak = driver_peak(lambda: nbsvm.fit(docs, labels, use))
    assert peak < 0.6 * TEXTS * LENGTH
    rows = labels.where(use).withColumnRenamed("quality", "label")
    own = nbsvm.train(*langid.sample_of(docs, rows, "label", 2500), rows.agg({"label": "avg"}).first()[0])
    # a dot product's last bits depend on the threads that it is given: the driver's many, a task's one
    assert np.allclose(model.weights, own.weights, rtol=1e-3, atol=1e-7) and np.allclose([model.bias, model.slope, model.shift], [own.bias, own.slope, own.shift], rtol=1e-4, atol=1e-6)


def test_nothing_to_learn_from(tables):
    docs, labels = tables
    use = ~langid.held_out("doc_id", 3, 1)
    assert langid.fit(docs.limit(0), use).languages == [] and langid.fit(docs.where("lang = 'xx'"), use).predict("abc") == ("und", 0.0, True)
    model = nbsvm.fit(docs.limit(0), labels, use)
    assert model.score("abc") == pytest.approx(0.5) and model.weights.shape == (1 << nbsvm.BITS,)
