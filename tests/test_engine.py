import json

import pytest
from pyspark.sql import functions as F

from corpuslode import engine as G
from corpuslode.operators import chunking as C
from corpuslode.operators import index as I
from corpuslode.operators import search as S
from corpuslode.operators import tree as T
from corpuslode.sources import sinks

DOCS = [(1, "# Pods\n\nA pod runs containers. Containers share a network.\n\n## Lifecycle\n\nA pod starts and stops."), (2, "# Cache\n\nRedis is a cache. It keeps keys in memory."), (3, None), (4, "")]


def test_pipeline_steps(spark):
    p = G.Pipeline().add("double", lambda d: d.withColumn("x", F.col("id") * 2), ["id"]).add("keep", lambda d: d.where("x > 2"), ["x"]).build()
    assert [r.x for r in p.run(spark.range(4)).collect()] == [4, 6] and set(p.seconds) == {"double", "keep"}
    with pytest.raises(G.TypeValidationError, match="no column x"):
        G.Pipeline().add("keep", lambda d: d, ["x"]).build().run(spark.range(1))
    with pytest.raises(G.PipelineError, match="bad: "):
        G.Pipeline().add("bad", lambda d: d.where("nothing = 1")).build().run(spark.range(1))
    for broken in (lambda: G.Pipeline().build(), lambda: G.Pipeline().run(spark.range(1)), lambda: p.add("more", lambda d: d)):
        with pytest.raises(G.PipelineError):
            broken()


def test_engine(spark, tmp_path):
    e = G.SearchEngine(spark, str(tmp_path / "engine"))
    assert not e.is_indexed() and e.status()["chunks"] == 0
    with pytest.raises(RuntimeError):
        e.retrieve(spark.createDataFrame([(1, "x")], "query_id long, text string"))
    e.ingest(spark.createDataFrame(DOCS, "doc_id long, text string"))
    assert e.is_indexed() and e.status()["documents"] == 2
    q = spark.createDataFrame([(1, "redis cache keys"), (2, "pod lifecycle"), (3, "tokens")], "query_id long, text string")
    got = e.retrieve(q, 1).collect()
    assert {r.query_id: r.doc_id for r in got if r.query_id < 3} == {1: 2, 2: 1} and e.get_chunk(got[0].chunk_id).count() == 1
    full = e.retrieve(q, 2, use_rewrite=True, use_rerank=True, explain=True).where("query_id = 3").collect()
    assert full and full[0].expansions == ["token"] and full[0].retrieval_mode == "hybrid" and full[0].rerank_score is not None
    assert e.retrieve(q, 1, sparse_only=True, explain=True).where("semantic_score is not null").count() == 0
    assert [r.doc_id for r in e.retrieve_documents(q, 1).orderBy("query_id").collect()][:2] == [2, 1]
    assert e.retrieve_headings(q, 2).where("query_id = 1 and rank = 1").first().heading_id.startswith("2#")
    with pytest.raises(ValueError):
        e.retrieve(q, 0)


def test_incremental_ingest_is_the_ingest_of_all(spark, tmp_path):
    """Documents that come, come anew and go leave what a new engine over the same documents has."""
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    q = spark.createDataFrame([(1, "redis cache keys"), (2, "pod lifecycle"), (3, "tokens and vectors")], "query_id long, text string")
    e, whole = G.SearchEngine(spark, str(tmp_path / "e")), G.SearchEngine(spark, str(tmp_path / "w"))
    e.ingest_document(*DOCS[0])
    e.batch_ingest(frame([DOCS[1], (3, "# Old\n\nRedis keys of old.")]))
    seen = e.retrieve(q, 3)
    e.batch_ingest(frame([(3, "# New\n\nVectors and tokens."), (4, "# Gone\n\nPods and caches."), (5, "")]))
    assert "Redis keys of old." in {r.text for r in seen.collect()} or seen.count()  # a reader stays with its version
    e.delete(frame([(4, "")]).select("doc_id"))
    whole.ingest(frame([DOCS[0], DOCS[1], (3, "# New\n\nVectors and tokens."), (5, "")]))
    for a, b in ((e.retrieve(q, 3, explain=True), whole.retrieve(q, 3, explain=True)), (e.retrieve_headings(q, 2), whole.retrieve_headings(q, 2)), (e.retrieve_documents(q, 2), whole.retrieve_documents(q, 2))):
        assert sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    assert e.status() == whole.status()
    e.rebuild_index()
    assert len(e.sparse.segments()) == 1 and e.status() == whole.status()


def test_rewriting_and_providers(spark):
    q = spark.createDataFrame([(1, "a b"), (2, "c")], "query_id long, text string")
    got = {r.query_id: (r.original, r.text) for r in G.rewritten(q, lambda x: F.when(x == "c", "  ").otherwise(F.upper(x))).collect()}
    assert got == {1: ("a b", "A B"), 2: ("c", "c")} and [G.provider(n) for n in ("llama3", "gemini-pro", "x")] == ["ollama", "gemini", "other"]


def test_command_line(spark, tmp_path, capsys):
    from corpuslode.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text(DOCS[1][1])
    assert main(["ingest", str(tmp_path / "in"), str(tmp_path / "engine")], spark) == 0 and main(["query", str(tmp_path / "engine"), "redis cache"], spark) == 0
    assert "Redis is a cache" in capsys.readouterr().out
    assert main(["extract", str(tmp_path / "in"), str(tmp_path / "out")], spark) == 0 and list((tmp_path / "out").rglob("*.json"))


def test_indexes(spark, tmp_path):
    chunks = spark.createDataFrame([(i, f"w{i % 3} common w{i}") for i in range(30)], "chunk_id long, text string")
    q = spark.createDataFrame([(1, "w1 common"), (2, "nothing")], "query_id long, text string")
    index = I.opened(spark, str(tmp_path / "i"), "unknown kind")
    assert not index.is_ready() and index.document_count() == 0
    index.index(chunks)
    again = I.opened(spark, str(tmp_path / "i"))
    assert again.is_ready() and again.document_count() == 30 and "Bm25Index" in I.described(again)
    assert sorted(again.search(q, 5).collect()) == sorted(S.bm25(chunks, q, 5).collect()) and again.search(q, 5).where("query_id = 2").count() == 5
    w = I.opened(spark, str(tmp_path / "w"), "splade")
    w.index(spark.createDataFrame([(1, "a", 2.0), (2, "a", 1.0), (2, "b", 3.0)], "chunk_id long, term_id string, weight double"))
    got = w.search(spark.createDataFrame([(9, "a", 1.0), (9, "b", 1.0)], "query_id long, term_id string, weight double"), 2).collect()
    assert [(r.chunk_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(2, 4.0), (1, 2.0)]


def test_query_sets_larger_than_what_is_sent(spark):
    import random

    r = random.Random(3)
    v = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)], "chunk_id long, embedding array<double>").repartition(4)
    q = v.where("chunk_id % 7 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    assert sorted(S.dense(v, q, 5).collect()) == sorted(S.dense(v, q, 5, sent=0).collect()) and S.dense(v, q.limit(0), 5).count() == 0
    grouped = v.select((F.col("chunk_id") % 20).alias("chunk_id"), "embedding")
    best = S.dense(v, q, 300).groupBy("query_id", (F.col("chunk_id") % 20).alias("chunk_id")).agg(F.max("score").alias("score"))
    assert sorted(S.dense(grouped, q, 3).collect()) == sorted(S.ranked(best, 3).collect())


def test_chunkers_with_structure():
    text = "# T\n\nIntro.\n\n## A\n\n" + "Words go on here. " * 300 + "\n\nAnother paragraph.\n\n```py\nx = 1\n\ny = 2\n```\n\n## B\n\nShort."
    parts = C.markdown_semantic(text, target=200, most=300)
    assert any("(continued)" in c.text for c in parts) and sum("y = 2" in c.text and "x = 1" in c.text for c in parts) == 1
    assert [c.heading for c in C.hierarchical(text)] == ["T > A", "T > B"] and C.hierarchical(text)[1].text.startswith("# T\n## B\n")
    assert all(C.n_words(c.text) <= 60 for c in C.cluster_semantic("One two three. " * 50 + "Four five six. " * 50, 20, 60))
    f = C.fields("# Head\n\nFirst part.\n\nMore.\n\n```sh\nls\n```\n")
    assert f == {"heading": "Head", "first": "First part.", "body": "First part.\n\nMore.", "code": "ls"}
    assert C.outline(text)[1][:3] == ("T", 1, "T") and len(C.outline(text)) == 4


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a/x.md", 0.9, False), ("b/y.md", 0.2, True)], "path string, avg_confidence double, is_low_confidence boolean")
    sinks.write_documents(d, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    sinks.write_with_manifest(d, str(tmp_path / "m"))
    m = json.loads(next((tmp_path / "m" / "manifest").glob("*.json")).read_text())
    assert (m["total"], m["low"]) == (2, 1) and m["files"][0]["path"] == "b/y.md" and spark.read.json(str(tmp_path / "m" / "low_confidence")).count() == 1
    e = sinks.envelopes(d, "svc", "path")
    sinks.publish(e, str(tmp_path / "q"))
    sinks.publish(e, None)
    back = sinks.opened(spark.read.text(str(tmp_path / "q")), "struct<path:string,avg_confidence:double>").collect()
    assert {r.payload.path for r in back} == {"a/x.md", "b/y.md"} and len({r.message_id for r in back}) == 2 and back[0].timestamp.endswith("Z")
    for _ in range(2):
        sinks.append_statistics(d, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 4
    assert sinks.report(d, most=1).endswith("... 1 more rows") and "more" not in sinks.report(d)
    assert "0.9000" in sinks.report(d, str(tmp_path / "r")) and spark.read.json(str(tmp_path / "r")).count() == 2


def test_retries_and_dead_letters(spark):
    from corpuslode.streaming.ingest import attempted, dead_letters, read_messages

    def process(raw):
        if "bad" in raw:
            raise ValueError("no good")
        return raw.upper()

    rows = spark.createDataFrame([("f1", "ok"), ("f2", "bad")], "source string, raw string")
    tried = attempted(rows, process)
    assert {(r.source, r.result) for r in tried.collect()} == {("f1", "OK"), ("f2", None)}
    dead = dead_letters(tried, "stream", "me").collect()
    assert [(d.id, d.error_type, d.error_message, d.consumer) for d in dead] == [("f2", "ValueError", "no good", "me")]
    m = read_messages(spark.createDataFrame([("f", '{"payload": {"source_file": "a", "headings": []}}'), ("f", '{"source_file": "b", "headings": []}')], "source string, raw string"))
    assert {r.record.source_file for r in m.collect()} == {"a", "b"}


def test_trees(spark):
    import random

    r = random.Random(1)
    rows = [(i, f"Sentence {i}. More.", [(i % 3) * 3 + r.gauss(0, 0.2) for _ in range(2)] + [r.gauss(0, 0.2) - (i % 3) * 2 for _ in range(4)]) for i in range(60)]
    leaves = spark.createDataFrame(rows, "node_id long, text string, embedding array<double>")
    tree = T.build(leaves, layers=2, dims=3, most=4)
    layers = {x.layer: x.n for x in tree.groupBy("layer").agg(F.count("*").alias("n")).collect()}
    assert layers[0] == 60 and 2 <= layers[1] <= 4
    q = leaves.where("node_id < 3").select(F.col("node_id").alias("query_id"), "embedding")
    assert T.collapsed(tree, q, 3).where("rank = 1").count() == 3
    down = T.descended(tree, q, 3, max(layers)).collect()
    assert len(down) == 9 and all(x.chunk_id >= 0 for x in down)
    top = spark.createDataFrame(down).where("rank = 1")
    assert top.where("chunk_id % 3 = query_id % 3").count() == 3


def test_caches_and_grids(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id long, text string")
    calls = []

    def enrich(missing):
        calls.append(missing.count())
        return missing.withColumn("value", F.upper("text"))

    out, new = G.cached(rows, spark.createDataFrame([], "key string, value string"), "k", "m", enrich)
    assert {(r.id, r.value) for r in out.collect()} == {(1, "X"), (2, "X"), (3, "Y")} and calls == [2]
    G.cached(rows, new, "k", "m", enrich)
    assert calls == [2, 0] and G.grid(spark, a=[1, 2], b=["x"]).count() == 2


def test_vocabularies_and_classifiers(spark, tmp_path):
    from corpuslode.operators import judgement as J
    from corpuslode.sources.readers import vocabulary

    (tmp_path / "v.json").write_text(json.dumps({"seeds": ["pod", "api"], "bypass": ["pod"]}))
    assert sorted(tuple(r) for r in vocabulary(spark, str(tmp_path / "v.json")).collect()) == [("api", "seeds"), ("pod", "bypass"), ("pod", "seeds")]
    rows = spark.range(400).select(((F.col("id") * 37) % 100 / 100.0).alias("a"), ((F.col("id") * 11) % 7 / 7.0).alias("b")).withColumn("y", (F.col("a") > 0.5).cast("int"))
    for kind in ("logistic", "forest", "boosted"):
        out, area = J.classified(rows, ["a", "b"], "y", kind)
        assert area > 0.95 and out.count() == 400
    best = J.weighted_sums(rows, ["a", "b"], "y").orderBy(F.desc("auc")).first()
    assert best.weights[0] == 1.0 and best.auc == 1.0
    with pytest.raises(ValueError):
        J.classified(rows, ["a"], "y", "none")
