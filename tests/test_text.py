from pyspark.sql import functions as F

from corpuslode.functions import text as X
from corpuslode.operators import evaluate as M
from corpuslode.operators import search as S
from corpuslode.sources import readers, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_enriched_and_expanded(spark):
    entities = F.array(F.struct(F.lit("library").alias("label"), F.array(F.lit("React"), F.lit("Vue")).alias("texts")), F.struct(F.lit("framework").alias("label"), F.array(F.lit("Next.js")).alias("texts")))
    keywords = F.array(F.lit("key1"), F.lit("key2"), F.lit("key3"))
    assert one(spark, X.enriched(F.lit("Test content here"), keywords, entities)) == "key1, key2, key3 | React, Vue, Next.js\n\nTest content here"
    keys, text = X.expansions(F.lit("token auth"))
    assert one(spark, keys) == ["token"] and "JWT" in one(spark, text)
    assert one(spark, X.expansions(F.lit("random query"))[1]) == "random query"


def test_spans_and_identifiers(spark):
    assert one(spark, X.verify_span(F.lit("React"), F.lit("Use React for UI"))) == "exact"
    assert one(spark, X.verify_span(F.lit("Vue"), F.lit("Use React for UI"))) == "none"
    assert one(spark, X.normalize_term(F.lit("Hello-World"))) == "hello world"
    assert {"HelloWorld", "FooBar"} <= set(one(spark, X.heuristic_terms(F.lit("Use HelloWorld and FooBar"))))
    assert {"React.Component", "os.path.join"} <= set(one(spark, X.heuristic_terms(F.lit("Import React.Component and os.path.join"))))
    path, fragment = X.normalize_url(F.lit("https://kubernetes.io/docs/home/"))
    assert (one(spark, path), one(spark, fragment)) == ("/docs/home", None)


def test_bm25_pads_to_k(spark):
    docs = spark.createDataFrame([(0, "kubernetes pod definition"), (1, "docker container"), (2, "kubernetes deployment")], "chunk_id long, text string")
    q = spark.createDataFrame([(7, "kubernetes pod")], "query_id long, text string")
    rows = S.bm25(docs, q, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [0, 2, 1] and rows[2].score == 0


def test_rrf_and_cosine(spark):
    leg = spark.createDataFrame([(1, 5, 1)], "query_id long, chunk_id long, rank int")
    assert abs(S.rrf([(leg, 1.0), (leg, 1.0)], rank_base=1).first().score - 2 / 61) < 1e-8
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "chunk_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.score for r in S.dense(v, q, 2, cosine=True).orderBy("rank").collect()] == [1.0, 0.0]


def test_metrics(spark):
    r = spark.createDataFrame([("a", 1, 100.0), ("a", 2, 200.0)], "dataset string, rank int, latency_ms double")
    got = M.summary(r, ["dataset"]).where("dataset is null").first()
    assert (got.hit_1, got.hit_5, got.mrr, got.mean_ms) == (0.5, 1.0, 0.75, 150.0)
    spans = lambda *x: spark.createDataFrame([(1, a, b) for a, b in x], "doc long, start int, end int")
    s = M.span_scores(spans((0, 10), (5, 15)), spans((10, 20)), "doc").first()
    assert (s.recall, s.precision, s.iou) == (0.5, 0.333333, 0.25)
    low = M.bootstrap(spark.range(200).select((F.col("id") % 2).cast("double").alias("v"), "id"), "v", 200).first()
    assert low.low < 0.5 < low.high
    assert M.matched_terms(["kubernetes", "pods"], ["Kubernetes", "pod"], one_to_one=True)[2] == 2


def test_sources(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sorted(map(tuple, tables.upsert(old, spark.createDataFrame([(2, "c")], "id int, v string"), ["id"]).collect())) == [(1, "a"), (2, "c")]
    assert tables.migrate(old, {"v": "string", "w": "double"}).columns == ["id", "v", "w"]
    (tmp_path / "a.md").write_bytes("é".encode("latin-1"))
    (tmp_path / "b.txt").write_text("é")
    assert [r.text for r in readers.text_files(spark, str(tmp_path)).collect()] == ["é", "é"]
    lines = spark.createDataFrame([("INSERT INTO t VALUES (1,'it''s',NULL),(2,'b, c',3);",), ("x",)], "value string")
    assert sorted(map(tuple, readers.dump_rows(lines, ["a", "b", "c"], "a").collect())) == [("1", "it's", None), ("2", "b, c", "3")]
    tags = [("d", 0, "Use", "O"), ("d", 1, "React", "B-L"), ("d", 2, "Native", "I-L"), ("d", 3, "Vue", "B-L")]
    got = readers.tagged_sentences(spark.createDataFrame(tags, "doc string, line int, token string, tag string"))
    assert sorted(r.entity for r in got.collect()) == ["React Native", "Vue"]
