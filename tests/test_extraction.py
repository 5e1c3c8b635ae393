import pytest
from pyspark.sql import functions as F

from corpuslode.functions import answers as A
from corpuslode.functions import extraction as E
from corpuslode.operators import evaluate as M
from corpuslode.operators import judgement as J
from corpuslode.operators import terms as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "term, text, span",
    [
        ("recv", "call recv(int x, (y)) now", "recv(int x, (y))"),
        ("close()", "use self.sock.close() here", "self.sock.close()"),
        ("SQL", "on SQL 2019 Server today", "SQL 2019 Server"),
        ("error 500", "an internal server error 500 came", "internal server error 500"),
        ("bin", "see /usr/bin/ruby there", "/usr/bin/ruby"),
        ("Maps", "the Maps Android API is", "Maps Android API is"),
        ("plain", "a plain word", "plain"),
        ("absent", "nothing here", "absent"),
    ],
)
def test_expanded_spans(spark, term, text, span):
    assert E.expanded_span(term, text) == span
    assert value(spark, E.expanded_spans(F.lit(term), F.lit(text))) == span


def test_versions_and_noise(spark):
    check = lambda term, text, neg=False, keep=False: value(spark, E.noise_rule(F.lit(term), F.lit(text), F.lit(neg), F.lit(keep)))
    assert check("2.7", "python 2.7.1 only") == "reject_version" and check("3.1", "at 3.1 of it") == "keep_structural"
    assert check("1.5", "(1.5)") == "reject_version" and check("1.5", "v1.5") == "keep_structural"
    assert check("1.2.3", "(1.2.3)") == "keep_structural" and check("the", "x") == "reject_stop_word" and check("7", "x") == "reject_short"
    assert check("hidden field", "x") == "reject_adjective" and check("tree items", "x") == "reject_category" and check("some more words", "x") == "reject_phrase"
    assert check("ABC-12", "x") == "reject_ticket" and check("image", "x", True) == "reject_negative" and check("Enter key", "x") == "keep_structural"
    assert check("https://a.b", "x") == "reject_url" and check("loading", "x") == "reject_gerund" and check("image", "x", keep=True) == "keep_bypass"


def test_context_and_braces(spark):
    assert value(spark, E.technical_context(F.lit("foo"), F.lit("install foo today")))
    assert not value(spark, E.technical_context(F.lit("foo"), F.lit("install " + "x " * 100 + "foo")))
    assert value(spark, E.embedded_in_braces(F.lit("ri"), F.lit("/bin/{erb,ri}"))) and not value(spark, E.embedded_in_braces(F.lit("ri"), F.lit("/bin/{erb,ri} and ri")))
    assert value(spark, E.seed_surface(F.lit("a.b"), F.lit("xa.b A.B"))) == "A.B"
    assert value(spark, E.parsed_terms(F.lit('x {"entities": ["a b", "c"]} y'))) == ["a b", "c"] and value(spark, E.parsed_terms(F.lit("- one\n2. two\n\nx"))) == ["one", "two"]


def test_sub_spans_and_protection(spark):
    rows = [(1, x) for x in ("getInputSizes", "getInputSizes(ImageFormat)", "arrow right", "right", "key", "big arrow right", "image")] + [(2, "right")]
    got = T.suppressed(spark.createDataFrame(rows, "doc_id long, term string"))
    assert {r.term for r in got.where("doc_id = 1").collect()} == {"getInputSizes(ImageFormat)", "key", "big arrow right"}
    kept = T.suppressed(spark.createDataFrame(rows, "doc_id long, term string"), F.col("term") == "right")
    assert "right" in {r.term for r in kept.where("doc_id = 1").collect()} and T.suppressed(got.limit(0)).count() == 0


def test_html_and_quotes(spark):
    kinds = lambda html: {k: [x.text for x in value(spark, A.html_texts(F.lit(html))) if x.kind == k] for k in A.HTML_TEXTS}
    assert kinds("<code>kubectl get pods</code>")["code"] == ["kubectl get pods"] and kinds("<pre>#!/bin/bash\necho</pre>")["code"] == ["#!/bin/bash\necho"]
    got = kinds("<p>Text with <code>code inside</code></p><p>  </p><code></code><blockquote>A quote</blockquote><p>This is prose</p>")
    assert got == {"code": ["code inside"], "blockquote": ["A quote"], "prose": ["This is prose"]}
    quotes = lambda html, text: value(spark, A.quote_matches(F.lit(html), F.lit(text)))
    assert quotes("<code>Kubectl  get pods --all-namespaces --show-labels</code>", "x kubectl get   pods --all-namespaces --show-labels")[0].kind == "code"
    assert not quotes("<code>short text</code>", "short text") and not quotes("<code>run the following command</code>", "run the following command")
    twenty = " ".join(f"w{i}" for i in range(20))
    pair = lambda html, text: tuple(spark.range(1).select(*[c.alias(n) for c, n in zip(A.reciprocal_match(F.lit(html), F.lit(text)), "dn")]).first())
    assert pair(f"<p>so: {twenty}, yes</p>", twenty) == ("chunk_in_answer", 20) and pair(twenty, f"{twenty} and more") == ("answer_in_chunk", 20) and pair("a", "a") == (None, None)


@pytest.mark.parametrize("given, want", [("#Pod_Life-Cycle", "pod-life-cycle"), ("#Pod--Life__Cycle", "pod-life-cycle"), ("#pod@lifecycle", "podlifecycle"), ("#-pod-lifecycle-", "pod-lifecycle"), ("#Pod Life-Cycle!", "pod-life-cycle")])
def test_anchors(spark, given, want):
    assert value(spark, A.anchor(F.lit(given))) == want


def test_paths_and_slugs(spark):
    for url, path in (("https://k.io/docs/home/", "/docs/home"), ("https://k.io/docs/home#s", "/docs/home"), ("https://k.io/", "/"), ("https://k.io", "")):
        assert value(spark, A.url_path(F.lit(url))) == path
    for head, slug in (("## Introduction", "introduction"), ("Heading with !@#$%^&*() symbols", "heading-with-symbols"), ("  Multiple   Spaces  ", "multiple-spaces"), ("---Leading and Trailing---", "leading-and-trailing")):
        assert value(spark, A.heading_slug(F.lit(head))) == slug


def test_trust(spark):
    def tier(fragment=False, quote=0, reciprocal=0, url=True, upvotes=5, accepted=False, same=0):
        t = value(spark, A.trust(*map(F.lit, (fragment, quote, reciprocal, url, upvotes, accepted, same))))
        return t.tier, t.reason, t.confidence, t.signals

    assert tier(fragment=True, quote=34)[:3] == ("gold", "fragment_anchor_match", 1.0)
    assert tier(quote=34)[:3] == ("gold", "quote_match_34_chars", 0.9) and tier(quote=61)[2] == 1.0 and tier(quote=16)[0] == "bronze"
    assert tier(reciprocal=22)[1] == "reciprocal_containment_22_words" and tier(reciprocal=40)[2] > tier(reciprocal=20)[2] == 0.85
    assert tier(upvotes=10, accepted=True)[:2] == ("silver", "url_high_trust") and tier(upvotes=25)[0] == "silver" and tier(upvotes=15, accepted=True)[2] == 0.85
    assert tier(upvotes=6, same=3)[:3] == ("silver", "url_corroborated", 0.7) and tier(upvotes=9)[0] == "bronze" and tier(upvotes=10)[2] > 0.6
    assert tier(url=False, upvotes=100)[:3] == ("exclude", "insufficient_signal", 0.0) and tier(upvotes=4)[0] == "exclude" and tier(upvotes=100)[2] <= 0.75
    assert "url_high_trust" in tier(quote=34, upvotes=30, accepted=True)[3]


def test_generated_cases(spark):
    assert value(spark, A.fenced_json(F.lit('x\n```json\n{"query": "t"}\n```\ny'))) == '{"query": "t"}' and value(spark, A.fenced_json(F.lit("no json"))) is None
    chunk = "This is a long enough chunk to contain a thirty character quote for gold tier."
    problem = lambda q, quote: value(spark, A.case_problem(F.lit(q), F.lit(quote), F.lit("gold"), F.lit(chunk)))
    long = "How do I test this component with a long query?"
    assert problem(long, "thirty character quote for gold tier") is None and problem("Too short", "x") == "query too short"
    assert problem(long, "not in chunks at all anywhere") == "quote not found verbatim" and problem(long, "long enough chunk") == "gold quote too short"


def test_likeness_and_assignment(spark):
    assert M.lcs_length("abcbdab", "bdcaba") == 4 and M.lcs_ratio("", "") == 100 and M.lcs_ratio("abc", "abd") == pytest.approx(400 / 6)
    assert M.partial_ratio("data", "the database") == 100 and M.rouge_l("a b c d", "a x c d") == 0.75 and M.rouge_l("", "a") == 0
    yes = [("Pods", "pod"), ("getElementById", "get element by id"), ("python script", "python"), ("api", "the api server"), ("kubernetes", "kuberntes")]
    assert all(M.fuzzy_match(a, b) for a, b in yes) and not M.fuzzy_match("redis", "kafka") and M.fuzzy_span("data lakes", "in the data lake here")
    import numpy as np

    gain = np.array([[7.0, 5.0, 0.0], [6.0, 1.0, 0.0]])
    assert sorted(M.assigned(gain)) == [(0, 1), (1, 0)]
    rng = np.random.default_rng(0)
    from itertools import permutations

    for n, m in ((4, 4), (3, 5), (5, 3)):
        g = rng.random((n, m))
        best = max(sum(g[i, p[i]] for i in range(n) if p[i] < m) for p in permutations(range(max(n, m)), n))
        assert sum(g[i, j] for i, j in M.assigned(g)) == pytest.approx(best)
    found = spark.createDataFrame([(1, "pods"), (1, "redis"), (2, "x")], "doc_id long, term string")
    true = spark.createDataFrame([(1, "pod"), (1, "kafka"), (3, "y")], "doc_id long, term string")
    for how in ("many", "greedy", "best"):
        got = {r.doc_id: (r.found_hits, r.true_hits, r.f1) for r in M.term_scores(found, true, how).collect()}
        assert got == {1: (1, 1, 0.5), 2: (0, 0, 0.0), 3: (0, 0, 0.0)}


def test_resampling(spark):
    d = spark.range(400).select(F.col("id"), ((F.col("id") * 37 % 100) / 100 - 0.2).alias("d"))
    r = M.sign_flip(d, "d", 500).first()
    assert r.p < 0.01 and r.mean == pytest.approx(0.295)
    flat = M.sign_flip(d.withColumn("d", F.when(F.col("id") % 2 == 0, 1.0).otherwise(-1.0)), "d", 500).first()
    assert flat.p > 0.5 and M.sign_flip(d.repartition(7), "d", 500).first().p == r.p
    b = M.bootstrap(d, "d", 400).first()
    assert b.low < b.mean < b.high and b.high - b.low < 0.12


def test_nearest_ranks(spark):
    rows = [("a", float(i % 50)) for i in range(97)] + [("b", 5.0)] * 30 + [("c", None)]
    got = {r.g: (r.p50, r.p95) for r in M.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95}, cuts=8).collect()}
    a = sorted(v for g, v in rows if g == "a")
    assert got == {"a": (a[48], a[min(int(0.95 * 97), 96)]), "b": (5.0, 5.0)}


def test_recommendations():
    assert J.recommendations(0.5, 0.2, 0.5, 0.8, 0.05) == ["All stages contribute effectively"]
    got = " ".join(J.recommendations(0.8, 0.5, 0.2, 0.4, 0.005))
    assert all(x in got for x in ("High error correlation", "High overlap", "Low fusion potential", "Low BM25 recall", "Reranker contributes less than 2%"))
