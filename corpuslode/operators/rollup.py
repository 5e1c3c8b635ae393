"""Roll-ups from chunks to headings to documents, term voting, tiers, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_vectors(rows: DataFrame, by: list[str], column: str = "embedding") -> DataFrame:
    """Element-wise means, not normalised again: partial sums by place before anything moves."""
    parts = rows.select(*by, F.posexplode(column).alias("i", "x")).groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(column))


def rounded(vector: str, digits: int = 6) -> Column:
    """A vector's components to so many digits; a negative one that rounds to zero keeps its sign, as in SQL."""
    return F.transform(vector, lambda x: F.round(F.abs(x), digits) * F.signum(x))


def spans_of(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char"), F.count("*").alias("n"))


def distinct_terms(rows: DataFrame, by: list[str], term: str, order: str) -> DataFrame:
    """Terms of each group, one a lower-cased form in its first-seen casing, in code-point order."""
    w = Window.partitionBy(*by, F.lower(term)).orderBy(order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return first.groupBy(*by).agg(F.sort_array(F.collect_list(term)).alias("terms"))


def votes(rows: DataFrame, by: list[str], least: int = 2, repeats: bool = False) -> DataFrame:
    """Terms that at least `least` sources (or mentions, with repeats) of (by, source, term) give, by lower-cased form."""
    count = F.count("*") if repeats else F.countDistinct("source")
    out = rows.groupBy(*by, F.lower("term").alias("key")).agg(count.alias("n"), F.min(F.struct("source", "term")).alias("f"))
    return out.where(F.col("n") >= least).select(*by, "key", F.col("f.term").alias("term"), "n")


def vocabulary(words: DataFrame, entities: DataFrame) -> DataFrame:
    """(term, entity_docs, text_docs, ratio, list) of words and entities (doc_id, term); the first rule that holds names the list."""
    a = entities.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("entity_docs"))
    b = words.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("text_docs"))
    t = b.join(a, "term", "full").na.fill(0, ["entity_docs", "text_docs"])
    t = t.withColumn("ratio", F.round(F.col("entity_docs") / F.greatest("text_docs", F.lit(1)), 6))
    e, n, r = F.col("entity_docs"), F.col("text_docs"), F.col("ratio")
    which = F.when((e >= 2) & (r >= 0.55), "bypass").when((e >= 2) & (r >= 0.5), "seeds").when((e >= 3) & (r >= 0.2) & (r < 0.5), "contextual")
    return t.withColumn("list", which.when((n >= 5) & (r > 0) & (r < 0.15), "low_precision").when((n >= 5) & (r == 0), "negatives").otherwise("none"))


def parent_child(results: DataFrame, chunks: DataFrame, top: int) -> DataFrame:
    """Parents of ranked chunks, best first, with all their chunks' texts; chunks (chunk_id, parent_id, pos, text)."""
    best = results.join(chunks.select("chunk_id", "parent_id"), "chunk_id").groupBy("query_id", "parent_id").agg(F.min("rank").alias("best"))
    w = Window.partitionBy("query_id").orderBy("best", "parent_id")
    best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    text = chunks.join(best.select("parent_id").distinct(), "parent_id", "left_semi").groupBy("parent_id")
    text = text.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n").alias("text"))
    return best.join(text, "parent_id").select("query_id", "parent_id", "rank", "text")


def auto_merged(results: DataFrame, chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """(query_id, parent_id, chunk_id, rank): a parent instead of its chunks where at least that share of several is ranked."""
    r = results.join(chunks.select("chunk_id", "parent_id"), "chunk_id")
    n = chunks.groupBy("parent_id").agg(F.count("*").alias("siblings"))
    got = r.groupBy("query_id", "parent_id").agg(F.count("*").alias("got"), F.min("rank").alias("best")).join(n, "parent_id")
    got = got.withColumn("merge", (F.col("siblings") > 1) & (F.col("got") / F.col("siblings") >= least))
    whole = got.where("merge").select("query_id", "parent_id", F.lit(None).cast("long").alias("chunk_id"), F.col("best").alias("rank"))
    return r.join(got.where("not merge").select("query_id", "parent_id"), ["query_id", "parent_id"]).select("query_id", "parent_id", "chunk_id", "rank").unionByName(whole)


def level_of_detail(doc_hits: DataFrame, sections: DataFrame, chunks: DataFrame, docs: int, per: int, k: int) -> DataFrame:
    """Best documents, then best sections within them, then best chunks within those; each level is (query_id, id, parent, score)."""
    from corpuslode.operators.search import ranked

    d = ranked(doc_hits.withColumnRenamed("doc_id", "chunk_id"), docs).select("query_id", F.col("chunk_id").alias("doc_id"))
    s = sections.join(d, ["query_id", "doc_id"], "left_semi").withColumnRenamed("section_id", "chunk_id")
    s = ranked(s, per).select("query_id", F.col("chunk_id").alias("section_id"))
    return ranked(chunks.join(s, ["query_id", "section_id"], "left_semi"), k)


def keywords(docs: DataFrame, most: int = 10) -> DataFrame:
    """(doc_id, keyword, score, rank): words that are frequent, early and often capitalised; a stand-in for a keyword library.

    score: count * (1 + share of capitalised ones) / ln(3 + first place), words of four letters or more.
    """
    w = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("i", "w"))
    big = F.count(F.when(F.col("w").rlike("^[A-Z]"), 1))
    s = w.groupBy("doc_id", F.lower("w").alias("keyword")).agg(F.round(F.count("*") * (1 + big / F.count("*")) / F.log(F.min("i") + 4), 6).alias("score"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "keyword")
    return s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def distinct_entities(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """(by, entities) of rows (by, label, term): for each label its terms, one a lower-cased form, sorted; labels sorted."""
    w = Window.partitionBy(*by, "label", F.lower("term")).orderBy(order)
    first = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    labels = first.groupBy(*by, "label").agg(F.sort_array(F.collect_list("term")).alias("texts"))
    return labels.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("label", "texts"))).alias("entities"))


def labels_of(entities: Column) -> Column:
    """label and texts of entities (label, text), each text once; labels and texts in the order they are first seen."""
    every = F.array_distinct(F.transform(entities, lambda e: F.coalesce(e["label"], F.lit("unknown"))))
    own = lambda label: F.array_distinct(F.transform(F.filter(entities, lambda e: F.coalesce(e["label"], F.lit("unknown")) == label), lambda e: e["text"]))
    return F.transform(every, lambda label: F.struct(label.alias("label"), own(label).alias("texts")))


def headings(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, heading_id, start_char, end_char, keywords, entities, embedding) rolled up to their headings.

    Spans as their ends, keywords and entities once each in sorted order, vectors as means that are not normalised again.
    """
    by = ["doc_id", "heading_id"]
    return _rolled(chunks, by)


def documents(rolled: DataFrame) -> DataFrame:
    """Rolled-up headings as documents: the mean of the headings' means, whatever their numbers of chunks."""
    return _rolled(rolled.drop("heading_id", "n"), ["doc_id"])


def _rolled(rows: DataFrame, by: list[str]) -> DataFrame:
    place = rows.withColumn("_o", F.struct("start_char", "end_char"))
    words = distinct_terms(place.select(*by, "_o", F.explode("keywords").alias("term")), by, "term", "_o").withColumnRenamed("terms", "keywords")
    labels = place.select(*by, "_o", F.explode("entities").alias("e")).select(*by, "_o", "e.label", F.explode("e.texts").alias("term"))
    out = spans_of(rows, by).join(words, by, "left").join(distinct_entities(labels, by, "_o"), by, "left")
    return out.join(mean_vectors(rows, by), by, "left")


def run_totals(files: DataFrame) -> DataFrame:
    """One row for a batch of (path, n_chunks, n_entities, n_keywords, seconds, low_confidence)."""
    s = F.col("seconds")
    return files.agg(F.count("*").alias("files"), F.sum("n_chunks").alias("chunks"), F.sum("n_entities").alias("entities"), F.sum("n_keywords").alias("keywords"), F.sum(F.col("low_confidence").cast("int")).alias("low_confidence"), F.round(F.avg(s), 6).alias("mean_seconds"), F.min(s).alias("min_seconds"), F.max(s).alias("max_seconds"))
