from math import log

import pytest
from pyspark.sql import functions as F

from corpuslode.operators import keywords as K

TEXT = "Kubernetes runs pods. A pod is small, and Kubernetes restarts a pod. The API server of Kubernetes stores pods in etcd."


def test_features_by_hand():
    f = K.features(K.tokenized(TEXT))
    assert set(f) == {"kubernetes", "runs", "pods", "pod", "small", "restarts", "api", "server", "stores", "etcd"}
    k = f["kubernetes"]
    # three times in three of three sentences, twice with a capital that is not a sentence's first
    assert (k.tf, k.spread) == (3, 1.0) and k.case == pytest.approx(2 / (1 + log(3)))
    assert k.position == pytest.approx(log(log(3 + 1)))  # the median of sentences 0, 1, 2
    # left: and, of (2 of 2); right: runs, restarts, stores (3 of 3); the most frequent words come three times
    assert k.related == pytest.approx(1 + (1 + 1) * 3 / 3)
    counts = [3, 1, 2, 2, 1, 1, 1, 1, 1, 1]
    mean = sum(counts) / 10
    assert k.frequency == pytest.approx(3 / (mean + (sum((c - mean) ** 2 for c in counts) / 10) ** 0.5))
    assert k.score == pytest.approx(k.related * k.position / (k.case + k.frequency / k.related + k.spread / k.related))
    assert f["api"].case == 1.0 and f["etcd"].position == pytest.approx(log(log(5)))


def test_keywords_fold():
    got = dict(K.keywords(TEXT, top=50, alike=2))
    f = K.features(K.tokenized(TEXT))
    a, b = f["api"].score, f["server"].score
    assert got["api server"] == pytest.approx(a * b / (1 + a + b)) and got["pods"] == pytest.approx(f["pods"].score / (2 * (1 + f["pods"].score)))
    assert "small and" not in got and "small kubernetes" not in got and not any(k.startswith("the ") for k in got)
    apart = [k for k, _ in K.keywords(TEXT, top=50, alike=0.85)]
    assert ("pod" in apart) != ("pods" in apart) and len(apart) < len(got)
    scores = [s for _, s in K.keywords(TEXT)]
    assert scores == sorted(scores) and len(scores) == 10 and K.keywords("") == K.keywords("of the and") == []


def test_extracted(spark):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, "short"), (4, "x" * 100_000), (1, TEXT)], "doc_id long, text string")
    got = K.extracted(d, 3)
    assert got.where("doc_id = 1").count() == 6 and got.where("doc_id in (2, 3)").count() == 0 and got.where("doc_id = 4").count() == 1
    assert got.agg(F.max("rank")).first()[0] == 3 and K.extracted(d.limit(0)).count() == 0


def test_keywords_of_unlike_lengths_are_not_matched(monkeypatch):
    """No string is matched with one whose length alone rules likeness out; the keywords stay the same."""
    from corpuslode.operators import keywords as K

    text = "Spark shuffles partitions. Antidisestablishmentarianism puzzles readers. Spark joins interoperability. Oak trees grow."
    want, own, met = K.keywords(text), K.SequenceMatcher, []
    monkeypatch.setattr(K, "SequenceMatcher", lambda junk, a, b: met.append((a, b)) or own(junk, a, b))
    assert K.keywords(text) == want and want
    assert all(2 * min(len(a), len(b)) >= 0.9 * (len(a) + len(b)) for a, b in met)
