"""Term extraction as DataFrames: grounding, noise, tiers, sub-span suppression, evidence, term statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.functions import extraction as E
from corpuslode.functions import text as X
from corpuslode.operators.patterns import within


@dataclass(frozen=True)
class Strategy:
    """Thresholds and switches of the tiers; the defaults are those of the candidate-verifying preset."""

    high_sources: int = 3
    some_sources: int = 2
    high_ratio: float = 0.95
    some_ratio: float = 0.5
    skip_ratio: float = 0.9
    corroborated_caps: bool = True
    voted_structure: bool = True
    low_precision: bool = False
    single_votes: bool = True


def grounded(candidates: DataFrame) -> DataFrame:
    """(doc_id, key, term, sources, n_sources) of candidates (doc_id, source, term, text) that their text bears out.

    A text that many candidates share comes better as `body`, in lower case, made before there is a row for each candidate.
    Of a term's casings a capitalised one wins over a lower-cased one, then the earliest source's and then the least. A
    candidate counts once a source and key.
    """
    body = F.col("body") if "body" in candidates.columns else F.lower("text")
    own = candidates.withColumn("key", X.normalize_term(F.col("term"))).where(~X.verify_span(F.col("term"), body=body).isin("none", "too_short"))
    best = F.min(F.struct((~F.col("term").rlike("^[A-Z]")).cast("int").alias("low"), "source", "term"))
    out = own.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("source")).alias("sources"), best.alias("best"))
    return out.select("doc_id", "key", F.col("best.term").alias("term"), "sources", F.size("sources").alias("n_sources"))


def listed(terms: DataFrame, vocabulary: DataFrame, lists: list[str], key: str = "low") -> DataFrame:
    """terms with a boolean column for each list of vocabulary (term, list) that has its lower-cased form."""
    wide = vocabulary.groupBy(F.lower("term").alias(key)).agg(F.collect_set("list").alias("_lists"))
    out = terms.withColumn(key, F.lower(F.trim("term"))).join(wide, key, "left")
    return out.withColumns({x: F.coalesce(F.array_contains("_lists", x), F.lit(False)) for x in lists}).drop("_lists")


def tier(s: Strategy, voted: Column, seeded: Column, contextual: Column, in_context: Column, structure: Column | None = None) -> Column:
    """HIGH, MEDIUM or LOW by the first rule that decides; reads term, n_sources, ratio, seeds, bypass, low_precision_list.

    structure: keep_structural() of the term, better made before a join: a filter by tier repeats what it is made of.
    """
    term, n, ratio = F.col("term"), F.col("n_sources"), F.col("ratio")
    vouched = F.col("seeds") | F.col("bypass")
    caps = F.lit(s.corroborated_caps) & term.rlike("^[A-Z][A-Z0-9_]+$") & ~voted & ~vouched & (ratio < s.high_ratio)
    vague = F.lit(s.low_precision) & F.col("low_precision_list") & (n < s.high_sources)
    structure = E.keep_structural(term) if structure is None else structure
    return (
        F.when(caps | vague, "LOW")
        .when(structure & (ratio == 0) & ~vouched, "MEDIUM")
        .when(structure & F.lit(s.voted_structure) & ~voted, "MEDIUM")
        .when(structure, "HIGH")
        .when(F.col("seeds") & seeded & ((n >= s.some_sources) | in_context), "HIGH")
        .when((n >= s.high_sources) | (ratio >= s.high_ratio), "HIGH")
        .when(contextual | (n >= s.some_sources) | (ratio >= s.some_ratio), "MEDIUM")
        .when(F.lit(s.single_votes) & voted, "MEDIUM")
        .otherwise("LOW")
    )


def suppressed(terms: DataFrame, protected: Column | None = None) -> DataFrame:
    """terms (doc_id, term) without those within a longer term of the same document.

    Terms of three or fewer characters, protected ones, and single words within two-word terms stay. One automaton of a
    document's terms finds those that lie within others (patterns.within()): no pairs, no substrings are made.
    """
    own = terms.withColumns({"_low": F.lower("term"), "_safe": F.coalesce(F.lit(False) if protected is None else protected, F.lit(False))})
    words = lambda c: F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    inside = within(own.select("doc_id", F.col("_low").alias("term"))).where(F.length("inner") > 3)
    gone = inside.where(~((words(F.col("inner")) == 1) & (words(F.col("outer")) == 2))).select("doc_id", F.col("inner").alias("_low")).distinct().withColumn("_gone", F.lit(True))
    out = own.join(gone, ["doc_id", "_low"], "left").where(F.col("_gone").isNull() | F.col("_safe") | (F.length("term") <= 3))
    return out.select(*terms.columns)


def _indexed(docs: DataFrame, entities: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The distinct (doc_id, term) of entities, and the generic documents of each term with their rank `n`."""
    gt = entities.select("doc_id", F.lower(F.trim("term")).alias("term")).where(F.length("term") >= 2).distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\b[\w#+.]+\b"), F.lit(0)))).alias("term")).where(F.length("term") >= 2)
    # rows below a rank are cut in every task before they are dealt, so a frequent term is never one task's work
    return gt, words.join(gt, ["doc_id", "term"], "left_anti").withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where(F.col("n") <= most)


def _counts(gt: DataFrame, generic: DataFrame) -> DataFrame:
    count = lambda df, e: df.groupBy("term").agg(F.count("*").alias("c")).withColumn("entity", F.lit(e))
    counts = count(gt, 1).unionByName(count(generic, 0)).groupBy("term").agg(F.sum(F.col("c") * F.col("entity")).alias("entity_count"), F.sum(F.col("c") * (1 - F.col("entity"))).alias("generic_count"))
    return counts.withColumn("entity_ratio", F.round(F.col("entity_count") / (F.col("entity_count") + F.col("generic_count")), 6))


def term_counts(docs: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """term_index() without its snippets, (term, entity_count, generic_count, entity_ratio): no text is dealt or met again."""
    return _counts(*_indexed(docs, entities, most))


def term_index(docs: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """(term, entity_count, generic_count, entity_ratio, positive, negative) of docs (doc_id, text), entities (doc_id, term).

    A term's generic documents are those that have it as a word but not as an entity, the first `most` by id; three
    snippets of either kind are kept.
    """
    gt, generic = _indexed(docs, entities, most)
    first = gt.withColumn("n", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).where("n <= 3").withColumn("entity", F.lit(1))
    shown = first.unionByName(generic.where("n <= 3").withColumn("entity", F.lit(0))).join(docs, "doc_id").select("term", "entity", "n", X.snippet(F.col("term"), F.col("text")).alias("s"))
    pick = lambda e: F.transform(F.array_sort(F.collect_list(F.when(F.col("entity") == e, F.struct("n", "s")))), lambda x: x["s"])
    shown = shown.groupBy("term").agg(pick(1).alias("positive"), pick(0).alias("negative"))
    return _counts(gt, generic).join(shown, "term").select("term", "entity_count", "generic_count", "entity_ratio", "positive", "negative")


def validated(terms: DataFrame, s: Strategy, decisions: DataFrame | Column | None = None) -> DataFrame:
    """The terms that stay after validation (doc_id, term, key, tier, ratio, ...), one a document and key.

    HIGH stays; MEDIUM stays with enough evidence, else by decisions (doc_id, term, decision), ENTITY where there is none.
    Decisions that the terms' own columns give come as a column: a frame made from terms would make all of them twice.
    """
    rows = terms.where("tier <> 'LOW'")
    if decisions is None:
        rows = rows.withColumn("_d", F.lit("ENTITY"))
    elif isinstance(decisions, Column):
        rows = rows.withColumn("_d", decisions)
    else:
        rows = rows.join(decisions.select("doc_id", "term", F.col("decision").alias("_d")), ["doc_id", "term"], "left")
    keep = (F.col("tier") == "HIGH") | (F.col("ratio") >= s.skip_ratio) | (F.coalesce("_d", F.lit("ENTITY")) == "ENTITY")
    w = Window.partitionBy("doc_id", "key").orderBy((F.col("tier") != "HIGH").cast("int"), "term")
    return rows.where(keep).drop("_d").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def sentence_statistics(docs: DataFrame, entities: DataFrame, tiers: tuple[int, ...] = (1000, 500, 200, 100)) -> DataFrame:
    """(word, n_docs, entity_docs, sentences, entity_sentences, tier) of words that are hardly ever entities.

    Candidates: words of no entity in 5 documents or more, or of entities in at most 5 % of 10 or more. tier: `safe_N` for
    the largest N of sentences reached without an entity one, else `candidate`.
    """
    parts = docs.select("doc_id", F.posexplode(F.split(F.lower("text"), r"[.!?\n]+")).alias("s", "sentence"))
    words = parts.select("doc_id", "s", F.explode(F.array_distinct(F.regexp_extract_all("sentence", F.lit(r"[a-z]{3,}"), F.lit(0)))).alias("word"))
    gt = entities.select("doc_id", F.lower("term").alias("word")).distinct().withColumn("e", F.lit(1))
    by_doc = words.select("doc_id", "word").distinct().join(gt, ["doc_id", "word"], "left").groupBy("word").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("e"), F.lit(0)).alias("entity_docs"))
    n, e = F.col("n_docs"), F.col("entity_docs")
    chosen = by_doc.where(((e == 0) & (n >= 5)) | ((e / n <= 0.05) & (n >= 10)))
    counts = words.join(gt, ["doc_id", "word"], "left").groupBy("word").agg(F.count("*").alias("sentences"), F.coalesce(F.sum("e"), F.lit(0)).alias("entity_sentences"))
    name = F.lit("candidate")
    for least in sorted(tiers):
        name = F.when((F.col("sentences") >= least) & (F.col("entity_sentences") == 0), f"safe_{least}").otherwise(name)
    return chosen.join(counts, "word").withColumn("tier", name)


def folded_negatives(stats: DataFrame, folds: int, key: str = "doc_id") -> DataFrame:
    """Of (doc_id, word, entity): how each fold's negatives hold up on the others: (fold, negatives, wrong, share_wrong)."""
    f = stats.withColumn("fold", F.pmod(F.col(key), F.lit(folds)))
    by = f.groupBy("fold", "word").agg(F.count("*").alias("n"), F.sum("entity").alias("e"))
    total = by.groupBy("word").agg(F.sum("n").alias("all_n"), F.sum("e").alias("all_e"))
    rest = by.join(total, "word").withColumns({"train_n": F.col("all_n") - F.col("n"), "train_e": F.col("all_e") - F.col("e")})
    negative = rest.where("train_n >= 3 and train_e = 0")
    out = negative.groupBy("fold").agg(F.count("*").alias("negatives"), F.sum((F.col("e") > 0).cast("int")).alias("wrong"))
    return out.withColumn("share_wrong", F.round(F.col("wrong") / F.col("negatives"), 6))
