"""Automaton scans against a naive search; similarity joins against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuslode.operators import evaluate as M
from corpuslode.operators import patterns as P
from corpuslode.operators import similar as SIM
from corpuslode.operators import terms as T

R = random.Random(11)


def naive(text, pattern, words):
    low = P.ascii_lower(text)
    at = [m.start() for m in re.finditer(f"(?={re.escape(P.ascii_lower(pattern))})", low)]
    edge = re.compile(r"\b", re.ASCII)
    return [(i, i + len(pattern)) for i in at if not words or (edge.match(text, i) and edge.match(text, i + len(pattern)))]


@pytest.mark.parametrize("words", [True, False])
@pytest.mark.parametrize("most", [1 << 20, 40])
def test_scan_is_a_naive_search(spark, words, most):
    patterns = ["the", "THE", "he", "a.b", ".net", "data set", "ö", "é", "x y", "thething", "", "C++", "aa", "0"]
    texts = ["The thing, the THE.", None, "", "a.b .net x.net aaaa data  set data set", "café É schön C++ x y x", "theThing 0 00 _the the_"] + ["".join(R.choice("thea. b+x") for _ in range(60)) for _ in range(30)]
    d = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    p = spark.createDataFrame([(x,) for x in [*patterns, None]], "pattern string")
    want = {(i, P.ascii_lower(x), *at) for i, t in enumerate(texts) for x in patterns if x and t for at in naive(t, x, words)}
    got = P.scan(d, p, words, most=most).collect()
    assert {(r.id, r.pattern, r.start, r.end) for r in got} == want and len(got) == len(want)
    assert all(r.surface == texts[r.id][r.start : r.end] for r in got)
    first = {}
    for i, x, a, b in sorted(want):
        first.setdefault((i, x), (a, b))
    assert {(r.id, r.pattern): (r.start, r.end) for r in P.scan(d, p, words, first=True, most=most).collect()} == first
    assert P.scan(d, p.limit(0)).count() == 0 and P.scan(d.limit(0), p).count() == 0


def test_terms_within_others_and_long_terms(spark):
    terms = ["a", "ab", "xaby", "long word", "word", "Long Word Here"]
    rows = [(i, t) for i in (1, 2) for t in terms] + [(3, "z" * 20_000), (3, "z" * 9), (4, None), (4, "")]
    d = spark.createDataFrame(rows, "doc_id long, term string")
    got = {(r.doc_id, r.inner, r.outer) for r in P.within(d).collect()}
    assert got == {(i, a, b) for i in (1, 2) for a in terms for b in terms if a != b and a in b} | {(3, "z" * 9, "z" * 20_000)}
    assert ("z" * 9) not in {r.term for r in T.suppressed(d).collect()}


def test_term_index_counts_entities_of_all_documents(spark):
    docs = spark.createDataFrame([(i, "the cat sat") for i in range(12)], "doc_id long, text string")
    r = T.term_index(docs, docs.where("doc_id < 8").select("doc_id", F.lit("Cat").alias("term"))).where("term = 'cat'").first()
    assert (r.entity_count, r.generic_count, len(r.positive), len(r.negative)) == (8, 4, 3, 3)
    assert T.term_index(docs, docs.limit(0).select("doc_id", F.lit("x").alias("term"))).where("term = 'the'").first().generic_count == 5


def variant(t):
    t = list(t)
    for _ in range(R.randint(0, 3)):
        i = R.randrange(len(t) + 1)
        if R.random() < 0.5 and t:
            del t[min(i, len(t) - 1)]
        else:
            t.insert(i, R.choice("abcde"))
    return "".join(t)


def vocabulary(n):
    base = ["".join(R.choice("abcde") for _ in range(R.randint(0, 24))) for _ in range(n // 4)]
    return list({variant(R.choice(base)) for _ in range(n)} | {"", "a", "b", "aaaaaaaaaaaa", "aaaaaaaaaaa", "abababababab", "bababababab", "Über-Größe", "über größe"})


@pytest.mark.parametrize("least", [85.0, 90.0, 100.0])
def test_similar_is_all_pairs(spark, least):
    a, b = vocabulary(150), vocabulary(150)
    frame = lambda x: spark.createDataFrame([(t,) for t in [*x, *x[:5], None]], "term string")
    want = {(x, y, round(M.lcs_ratio(x.lower(), y.lower()), 6)) for x in a for y in b if M.lcs_ratio(x.lower(), y.lower()) >= least}
    got = SIM.similar(frame(a), frame(b), least=least).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 10
    with pytest.raises(ValueError):
        SIM.similar(frame(a), frame(b), least=60)


def test_fuzzy_is_all_pairs(spark):
    words = ["Kubernetes Pod", "kubernetes pods", "pods", "pod", "HorizontalPodAutoscaler", "horizontal pod autoscalers", "api", "REST api v2", "policies", "policy", "load-balancer", "load_balancers", "the load balancer of it", "", " ", "s", "caches", "cache", "redis cache", "cachex redis"]
    a, b = words + vocabulary(60), words + vocabulary(60)
    rows = lambda x: spark.createDataFrame([(k, t) for k in (1, 2, None) for t in x[k or 0 :]], "k long, term string")
    want = {(k, x, y) for k in (1, 2) for x in a[k:] for y in b[k:] if M.fuzzy_match(x, y)}
    assert {tuple(r)[:3] for r in SIM.fuzzy(rows(a), rows(b), ["k"]).collect()} == want


def test_spans_like_is_every_stretch(spark):
    terms = ["redis cache", "Pod lifecycle", "x", "one two three", ""]
    texts = {1: "The redis caches are warm", 2: "pod life cycle and pods", 3: "one  two thre", 4: "", 5: "X"}
    got = SIM.spans_like(spark.createDataFrame([(k, t) for k in texts for t in terms], "k long, term string"), spark.createDataFrame([*texts.items()], "k long, text string"), ["k"])
    assert {(r.k, r.term): r.found for r in got.collect()} == {(k, t): M.fuzzy_span(t, x) for k, x in texts.items() for t in terms}
