from pyspark.sql import functions as F

from corpuslode.functions import complexity as C
from corpuslode.operators import judgement as J
from corpuslode.operators.headings import with_parents


def test_parents_are_the_last_smaller_level(spark):
    levels = [1, 2, 3, 3, 2, 4, 1, 3]
    rows = [("a", i, n) for i, n in enumerate(levels)] + [("b", 0, 2), ("b", 1, 1), ("b", 2, None)]
    got = {(r.page, r.pos): r.parent_pos for r in with_parents(spark.createDataFrame(rows, "page string, pos int, level int"), "page").collect()}
    assert [got["a", i] for i in range(8)] == [None, 0, 1, 1, 0, 4, None, 6]
    assert [got["b", i] for i in range(3)] == [None, None, None]


def test_questions(spark):
    asked = {"Compare pods and jobs": "multi", "how does etcd work": "complex", "how many pods": "simple", "one two three": "simple", "one two three four five six seven": "complex", "pod stuck": "complex", "": "simple"}
    got = spark.createDataFrame([(q,) for q in asked], "q string").select("q", C.query_complexity(F.col("q")).alias("c")).collect()
    assert {r.q: r.c for r in got} == asked


def test_facts_levels_and_weights(spark):
    rows = [("big lake", "a Big Lake"), ("big lake", "lake so big"), ("lake", "la ke"), ("big sea", "big")]
    exact, fuzzy = C.fact_match(F.col("f"), F.col("t"))
    assert [tuple(r) for r in spark.createDataFrame(rows, "f string, t string").select(exact, fuzzy).collect()] == [(True, True), (False, True), (False, False), (False, False)]
    levels = [("HIGH", 0.2), ("MEDIUM", 0.9), ("MEDIUM", 0.1), ("LOW", 0.9)]
    assert [r[0] for r in spark.createDataFrame(levels, "l string, c double").select(C.level_score(F.col("l"), F.col("c"))).collect()] == [0.8, 0.79, 0.5, 0.49]
    assert [r[0] for r in spark.createDataFrame([(1,), (2,), (5,), (6,), (None,)], "r int").select(C.position_weight(F.col("r"))).collect()] == [1.0, 0.95, 0.85, 0.6, 0.6]


def test_ranks_and_areas_are_counted_in_ranges(spark):
    """One group of many rows, with ties: several ranges, and the ranks and area of a plain count."""
    rows = [("a", float((i * 7) % 50), i % 2 if i % 5 else 1) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y long")
    assert J._ranged(df, "x").select("_range").distinct().count() > 1
    ranked = J.ranks(df, "x", "r", "g").select("x", "r").distinct().collect()
    assert all(r.r == sum(x < r.x for _, x, _ in rows) + (sum(x == r.x for _, x, _ in rows) + 1) / 2 for r in ranked) and len(ranked) == 50
    up, down = ([x for _, x, y in rows if y == k] for k in (1, 0))
    want = sum((p > q) + (p == q) / 2 for p in up for q in down) / len(up) / len(down)
    assert J.auc(df, "x", "y", "g").first()["auc"] == round(want, 6)
