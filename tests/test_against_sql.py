"""Queries against their SQL on small tables made to hold what the given ones seldom do."""

import duckdb
import pandas as pd


def rows_of(spark, folder, name, **tables):
    """(Spark's rows, DuckDB's rows) of a query over those tables, in order, as text."""
    from corpuslode.plans import catalog

    con = duckdb.connect()
    for t, pdf in tables.items():
        pdf.to_parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(folder)).select(*want.columns).collect()
    return sorted(repr(list(r)) for r in got), sorted(repr(list(r)) for r in want.fetchall())


def test_means_that_round_to_zero_keep_their_sign(spark, tmp_path):
    e = pd.DataFrame({"vec_id": range(100), "embedding": [[-1e-7, 1e-7, 0.0, 0.25]] * 100, "label": [i % 3 for i in range(100)]})
    for name in ("agg2_document_vectors", "agg5_mean_vectors"):
        got, want = rows_of(spark, tmp_path, name, embeddings=e)
        assert got == want and "-0.0" in got[0]


def test_cascade_leaves_documents_that_share_six_digits_of_a_hash(spark, tmp_path):
    ids = [10760, 4982, 10, 11, 30, 31]  # the first two have the same six
    got, want = rows_of(spark, tmp_path, "snk3_cascade", documents=pd.DataFrame({"doc_id": ids}))
    assert got == want


SPARSE = ("spr6_okapi", "spr7_weighted_fields", "spr8_bmx", "spr2_without_index", "hyb6_contextual")


def _texts():
    docs = ["  b a a\nc", None, "", "   ", "a a a a", "c b\n\nx é É", "a", "a", "b c ä", "z " * 50] * 3
    d = pd.DataFrame({"doc_id": range(len(docs)), "text": docs, "lang": "en", "source": "s"})
    return {"documents": d, "benchmark": pd.DataFrame({"item_id": [7, 3, 9, 5, 1], "text": ["a b b É", "q", None, "  C a", "c z x b a"]})}


def test_sparse_scores_of_odd_texts(spark, tmp_path):
    for name in SPARSE:
        got, want = rows_of(spark, tmp_path, name, **_texts())
        assert got == want and got, name


def test_sparse_scores_in_parts(spark, tmp_path, monkeypatch):
    """Query sets too large for one pass, and batches that are scored a few chunks at a time."""
    from corpuslode.operators import search as S

    monkeypatch.setattr(S, "MOST_TERMS", 4)
    monkeypatch.setattr(S, "CELLS", 5)
    for name in SPARSE:
        got, want = rows_of(spark, tmp_path, name, **_texts())
        assert got == want, name


def test_sparse_scores_stay_in_their_tasks(spark, tmp_path):
    """Only each task's best hits are dealt, by query: no posting, no sum of a query and a chunk."""
    from corpuslode.plans import catalog

    for name, t in _texts().items():
        t.to_parquet(f"{tmp_path}/{name}.parquet")
    for name in ("spr6_okapi", "spr7_weighted_fields"):
        plan = catalog.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan


def test_pages_are_lowered_once(spark, tmp_path):
    """Not once a candidate; and terms are grounded as in SQL, in pages that are null, empty or in capitals too."""
    html = ["<title>Some TITLES here</title> Alpha beta-gamma word words ALPHA Beta gammas", None, "", "<TITLE>X</TITLE> MARGIN Margin margins", "<title>Query</title> queries Querying"]
    got, want = rows_of(spark, tmp_path, "agg7_grounding", pages=pd.DataFrame({"page_id": range(5), "html": html, "url": "u"}))
    assert got == want and got
    from corpuslode.plans import catalog

    plan = catalog.queries()["agg7_grounding"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(body" in plan and "Contains(lower(" not in plan


def test_validated_terms_lower_pages_once(spark, tmp_path):
    from corpuslode.plans import catalog

    html = ["<title>Some Titles here</title> Alpha beta words Alpha titles", None, "", "Margin margins class"]
    got, want = rows_of(spark, tmp_path, "agg11_validated_terms", pages=pd.DataFrame({"page_id": range(4), "html": html, "url": "u"}))
    assert got == want and got
    plan = catalog.queries()["agg11_validated_terms"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(body" in plan and "Contains(lower(" not in plan


def test_tiers_need_no_snippets_and_terms_are_made_once(spark, tmp_path):
    """The index's counts without texts, terms that no decision makes again, rules of structure once a term; rows as in SQL."""
    from corpuslode.plans import catalog

    html = ["<title>Some Titles HERE</title> Alpha beta_x words Alpha titles class article", None, "", "Margin margins class Alpha doctype", "<title>Query Alpha</title> queries Querying alphas charset"]
    for name in ("agg10_tiers", "agg11_validated_terms", "agg12_term_index"):
        got, want = rows_of(spark, tmp_path, name, pages=pd.DataFrame({"page_id": range(5), "html": html, "url": "u"}))
        assert got == want and got, name
    plan = catalog.queries()["agg11_validated_terms"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") + plan.count("Relation[") <= 6 and "locate(" not in plan and plan.count("Ctrl") == 1, plan


def test_decisions_as_a_frame_or_a_column(spark):
    from pyspark.sql import functions as F

    from corpuslode.operators import terms as T

    rows = [(1, "a", "A", "HIGH", 0.1), (1, "b", "b", "MEDIUM", 0.95), (2, "c", "c", "MEDIUM", 0.5), (3, "c", "c", "MEDIUM", 0.5), (4, "d", "d", "LOW", 1.0)]
    terms = spark.createDataFrame(rows, "doc_id long, key string, term string, tier string, ratio double")
    decision = F.when(F.col("doc_id") == 3, "GENERIC").otherwise("ENTITY")
    for d in (decision, terms.select("doc_id", "term", decision.alias("decision"))):
        assert sorted((r.doc_id, r.key) for r in T.validated(terms, T.Strategy(), d).collect()) == [(1, "a"), (1, "b"), (2, "c")]


def test_counts_are_those_of_the_term_index(spark):
    from corpuslode.operators import terms as T

    docs = spark.createDataFrame([(i, f"the cat sat on w{i % 3}") for i in range(12)], "doc_id long, text string")
    entities = docs.where("doc_id < 8").selectExpr("doc_id", "'Cat' as term")
    got = T.term_counts(docs, entities)
    assert sorted(got.collect()) == sorted(T.term_index(docs, entities).select(*got.columns).collect()) and got.count() == 7
