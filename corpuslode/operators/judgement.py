"""What tells systems apart: complementarity of legs, stages of a cascade, ablations, correlations, confusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _correlation(a: str, b: str) -> Column:
    """Pearson's, 0 where a column is constant."""
    return F.coalesce(F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)), F.lit(0.0))


def complementarity(a: DataFrame, b: DataFrame, relevant: DataFrame, ks: tuple[int, int] = (10, 50)) -> DataFrame:
    """One row: overlaps of ranked lists a and b (query_id, chunk_id, rank), hits that only one has, correlation of misses,
    and the share of queries that either finds but the better one alone does not."""
    both = a.select("query_id", "chunk_id", F.col("rank").alias("ra")).join(b.select("query_id", "chunk_id", F.col("rank").alias("rb")), ["query_id", "chunk_id"], "full")
    both = both.join(relevant.withColumn("good", F.lit(1)), ["query_id", "chunk_id"], "left")
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    n = lambda x: F.sum(x.cast("int"))
    shared = [F.sum((within("ra", k) & within("rb", k)).cast("int")).alias(f"s{k}") for k in ks]
    either = [F.sum((within("ra", k) | within("rb", k)).cast("int")).alias(f"e{k}") for k in ks]
    k = ks[0]
    good = F.col("good").isNotNull()
    q = both.groupBy("query_id").agg(*shared, *either, (n(within("ra", k) & good) > 0).cast("double").alias("ha"), (n(within("rb", k) & good) > 0).cast("double").alias("hb"))
    q = relevant.select("query_id").distinct().join(q, "query_id", "left").na.fill(0)
    r = lambda c, name: F.round(c, 6).alias(name)
    hits = F.sum(F.greatest("ha", "hb"))
    return q.agg(
        *[r(F.coalesce(F.sum(f"s{x}") / F.nullif(F.sum(f"e{x}"), F.lit(0)), F.lit(0.0)), f"overlap_at_{x}") for x in ks],
        F.sum(((F.col("ha") == 1) & (F.col("hb") == 0)).cast("int")).alias("unique_a"),
        F.sum(((F.col("ha") == 0) & (F.col("hb") == 1)).cast("int")).alias("unique_b"),
        r(_correlation("ha", "hb"), "error_correlation"),
        r((hits - F.greatest(F.sum("ha"), F.sum("hb"))) / F.count("*"), "fusion_potential"),
    )


def cascade(stages: dict[str, tuple[DataFrame, int]], relevant: DataFrame) -> DataFrame:
    """(stage, recall, mrr, gain) of ranked lists, each cut at its own k; gain: of the MRR over the stage before."""
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n"))
    out = None
    for place, (name, (rows, k)) in enumerate(stages.items()):
        hit = rows.where(F.col("rank") <= k).join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"))
        one = n.join(hit, "query_id", "left").agg(F.avg(F.coalesce(F.col("found"), F.lit(0)) / F.col("n")).alias("recall"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
        one = one.select(F.lit(place).alias("place"), F.lit(name).alias("stage"), "recall", "mrr")
        out = one if out is None else out.unionByName(one)
    w = Window.orderBy("place")  # a row a stage
    r = lambda c, name: F.round(c, 6).alias(name)
    return out.select("stage", r(F.col("recall"), "recall"), r(F.col("mrr"), "mrr"), r(F.col("mrr") - F.coalesce(F.lag("mrr").over(w), F.lit(0.0)), "gain"))


def recommendations(overlap: float, correlation: float, potential: float, first_recall: float, rerank_gain: float) -> list[str]:
    """What the figures advise; one line that all works where none of the thresholds is passed."""
    rules = [
        (correlation > 0.4, "High error correlation: the legs miss the same queries"),
        (overlap > 0.7, "High overlap: one leg may do"),
        (potential < 0.3, "Low fusion potential: fusing adds little"),
        (first_recall < 0.5, "Low BM25 recall: mend the sparse leg first"),
        (rerank_gain < 0.02, "Reranker contributes less than 2%"),
    ]
    return [text for hit, text in rules if hit] or ["All stages contribute effectively"]


def ranks(rows: DataFrame, column: str, name: str, by: str) -> DataFrame:
    """Adds the average rank (ties share it) of a column, in ascending order, over `by` groups.

    Ranks are counted within ranges of the column, after the rows of the ranges before: no group is one task's work.
    """
    ranged = _ranged(rows, column)
    counts = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_at")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("_by").orderBy("_at")) - F.col("_n")).drop("_n")  # a row a range
    w = Window.partitionBy(by, "_range").orderBy(column)
    ties = Window.partitionBy(by, "_range", column)
    own = ranged.withColumn(name, F.rank().over(w) + (F.count("*").over(ties) - 1) / 2)
    own = own.join(F.broadcast(before), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return own.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_by", "_at", "_before")


def spearman(rows: DataFrame, a: str, b: str, by: str) -> DataFrame:
    """(by, rho): rank correlation of two columns in each group."""
    both = ranks(ranks(rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra", by), b, "_rb", by)
    return both.groupBy(by).agg(F.round(_correlation("_ra", "_rb"), 6).alias("rho"))


def auc(rows: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """(by, auc): the area under the ROC curve, by the rank sum of the positives; null where a class is missing.

    Equal scores are counted first. Ranks are running sums of the counts within ranges of scores, after the sums of the ranges
    before: no group's rows are one task's work.
    """
    y = F.col(label)
    ties = rows.where(F.col(score).isNotNull()).groupBy(by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"), F.sum(y).alias("_p"), F.sum(1 - y).alias("_q"))
    ties = _ranged(ties, "_s")
    within = Window.partitionBy(by, "_range").orderBy("_s")
    # of a range: rows, classes, and the positives' rank sum (doubled, so that it is whole) if nothing came before it
    own = ties.withColumn("_2r", F.col("_p") * (2 * F.sum("_n").over(within) - F.col("_n") + 1))
    ranges = own.groupBy(by, "_range").agg(*[F.sum(c).alias(c) for c in ("_n", "_p", "_q", "_2r")])
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_range")) - F.col("_n")  # a row a range
    whole = ranges.withColumn("_2r", F.col("_2r") + 2 * F.col("_p") * before)
    p, q = F.sum("_p"), F.sum("_q")
    return whole.groupBy(by).agg(F.round((F.sum("_2r") / 2 - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0)), 6).alias("auc"))


def _ranged(rows: DataFrame, column: str) -> DataFrame:
    """rows with `_range`: ascending numbers of about as many ranges of the column as there are shuffle partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(rows.select(F.col(column).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    if not cuts:
        return rows.withColumn("_range", F.lit(0))
    at = F.array(*[F.lit(c) for c in cuts])
    return rows.withColumn("_range", F.size(F.filter(at, lambda c: c < F.col(column))))


def confusion(rows: DataFrame, truth: str, predicted: str, by: Column) -> DataFrame:
    """(group, tp, fp, fn, tn, precision, recall) of two boolean columns."""
    t, p = F.col(truth), F.col(predicted)
    n = lambda x: F.sum(x.cast("int"))
    c = rows.groupBy(by.alias("group")).agg(n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"), n(~t & ~p).alias("tn"))
    part = lambda a, b: F.round(F.coalesce(F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0)), F.lit(0.0)), 6)
    return c.withColumns({"precision": part("tp", "fp"), "recall": part("tp", "fn")})


def classified(rows: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 7) -> tuple[DataFrame, float]:
    """(rows with `score`, area under the curve on the held-out fifth) of one of Spark ML's classifiers on named columns."""
    from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    kinds = {"logistic": LogisticRegression, "forest": RandomForestClassifier, "boosted": GBTClassifier}
    if kind not in kinds:
        raise ValueError(f"unknown kind {kind!r}; {', '.join(sorted(kinds))}")
    data = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip").transform(rows.withColumn("_label", F.col(label).cast("double")))
    held = F.pmod(F.xxhash64(*features, F.lit(seed)), F.lit(5)) == 0
    more = {} if kind == "logistic" else {"seed": seed}
    model = kinds[kind](featuresCol="_features", labelCol="_label", **more).fit(data.where(~held))
    scored = model.transform(data)
    area = BinaryClassificationEvaluator(labelCol="_label", rawPredictionCol="rawPrediction").evaluate(scored.where(held))
    return scored.select(*rows.columns, vector_to_array("probability")[1].alias("score")), area


def weighted_sums(rows: DataFrame, signals: list[str], label: str, steps: int = 5) -> DataFrame:
    """(weights, auc) of every split of 1 into `steps` parts over up to three signals: the search for a weighted sum."""
    if not 2 <= len(signals) <= 3:
        raise ValueError("two or three signals")
    grid = [(i, j, steps - i - j) for i in range(steps + 1) for j in range(steps + 1 - i)] if len(signals) == 3 else [(i, steps - i) for i in range(steps + 1)]
    options = F.array(*[F.array(*[F.lit(w / steps) for w in g]) for g in grid])
    wide = rows.withColumn("weights", F.explode(options)).withColumn("_s", F.round(sum((F.col("weights")[k] * F.col(c) for k, c in enumerate(signals)), F.lit(0.0)), 6))
    return auc(wide, "_s", label, "weights")
