"""Source divergence audit: how far the word use of a source is from that of the other sources of its language.

For every language the terms that at least `least` of its documents hold are kept. Each (language, source) group and each
language gives each kept term a smoothed share p in billionths. A pair of groups differs by the sum of |p - q| over all kept
terms, most of which neither group or only one of them has. So the sum is taken by inclusion and exclusion over supports:

* a term of one group prices as if the other lacked it: the group's histogram of counts is enough, as all terms of one count
  have one p, and all terms that a group lacks have one z;
* terms that both have are joined as sparse postings; each corrects the two prices it was given;
* terms that neither has differ by a constant, |z_a - z_b|, times their number.

Work grows with the postings and the histograms, not with sources x terms.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslode.llm.common import partitions, stage

#: Documents that hold a kept term at least; the smoothing of counts; the ranks of a group's terms that are returned.
LEAST, SMOOTH, TOP = 30, 5, 50
#: Distinct (group, term) that a worker adds up before it hands them on.
HELD = 200_000
#: Groups that are broadcast at most; more are joined by a shuffle.
MOST_GROUPS = 100_000
#: ASCII letters in lower case and all bytes of other characters stay; whatever else is ASCII separates terms.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def named(docs: DataFrame) -> DataFrame:
    """(lang, source, text): nulls are empty strings; other columns, whatever their names, are left out."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, df): parts of the occurrences of each term, and of the documents that hold it."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        lang, source, term, n, df = [], [], [], [], []
        for (a, b), (every, once) in held.items():
            lang += [a] * len(every)
            source += [b] * len(every)
            term += every
            n += every.values()
            df += map(once.__getitem__, every)
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((lang, source, term, n, df), kinds)], names=["lang", "source", "term", "n", "df"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        for b in it:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                every, once = held[lang, source]
                own = Counter(text.translate(LETTERS).split())
                every.update(own)
                once.update(own.keys())
            if sum(len(x) for x, _ in held.values()) > HELD:
                yield rows(held)
                held.clear()
        if held:
            yield rows(held)

    parts = named(docs).withColumn("text", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term binary, n long, df long")
    return parts.withColumn("term", F.col("term").cast("string"))


def postings(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, source, n, total, lead) of the kept terms: n in the group, total in the language; lead: a term's first row."""
    # dealt once, by language and term: the sums by source and those over all sources need no other exchange
    parts = counts(docs)
    by = parts.repartition(partitions(parts), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    term = Window.partitionBy("lang", "term")
    own = by.withColumns({"held": F.sum("df").over(term), "total": F.sum("n").over(term), "lead": F.row_number().over(term.orderBy("source")) == 1})
    return own.where(F.col("held") >= least).select("lang", "term", "source", "n", "total", "lead")


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 (n + 5) / total), exactly; null if total is 0."""
    whole = (n + SMOOTH).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(total > 0, 1 + F.call_function("div", whole, total.cast("decimal(20,0)")))


def groups(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """(lang, source, support, size, vocab, lang_size, zero) of every group; sizes are smoothed; zero: p of a term it lacks."""
    every = named(docs).select("lang", "source").distinct()
    own = posts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("support"), F.sum(F.col("lead").cast("long")).alias("leads"))
    own = every.join(own, ["lang", "source"], "left").fillna(0, ["n", "support", "leads"])
    lang = Window.partitionBy("lang")  # a row a group
    own = own.withColumn("vocab", F.sum("leads").over(lang))
    own = own.withColumns({"size": F.col("n") + SMOOTH * F.col("vocab"), "lang_size": F.sum("n").over(lang) + SMOOTH * F.col("vocab")})
    return own.select("lang", "source", "support", "size", "vocab", "lang_size", F.coalesce(share(F.lit(0), F.col("size")), F.lit(0)).alias("zero"))


def pairs(own: DataFrame) -> DataFrame:
    """(lang, a, b, za, zb, both_lack): groups of one language, a < b; a language's groups are dealt over all tasks."""
    n = partitions(own)
    left = own.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), F.col("support").alias("sa"), "vocab", F.pmod(F.xxhash64("source"), F.lit(n)).alias("deal"))
    right = own.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"), F.col("support").alias("sb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("deal"))
    return left.join(right, ["lang", "deal"]).where("a < b").select("lang", "a", "b", "za", "zb", (F.col("vocab") - F.col("sa") - F.col("sb")).alias("both_lack"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of docs.

    part `pair`: item is each other source of the language, value the sum of |p - q| over all kept terms. part `term`: item
    is a kept term that the group uses more than its language does, value p - q, at most `top` ranks. Ranks are by descending
    value, then ascending item, from 1 in each group and part. Null texts, languages and sources are empty strings; groups
    without terms count; a language without kept terms has pairs of value 0 and no terms. Repeated rows count as often as
    they come. Other columns, whatever their names, are left out. An empty table gives an empty result.
    """
    posts = stage(postings(docs, least), "divergence-postings")
    own = stage(groups(docs, posts), "divergence-groups")
    known = own.select("lang", "source", "size", "lang_size", "zero")
    if known.count() <= MOST_GROUPS:
        known = F.broadcast(known)
    priced = posts.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("size")))

    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    pair = stage(pairs(own), "divergence-pairs")
    both_ways = pair.select("lang", F.col("a").alias("source"), "a", "b", F.col("zb").alias("zero")).unionByName(pair.select("lang", F.col("b").alias("source"), "a", "b", F.col("za").alias("zero")))
    one_sided = histogram.join(both_ways, ["lang", "source"]).select("lang", "a", "b", (F.col("terms") * F.abs(F.col("p") - F.col("zero"))).alias("value"))

    x = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    y = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    gap = lambda i, j: F.abs(F.col(i) - F.col(j))
    shared = x.join(y, ["lang", "term"]).where("a < b").select("lang", "a", "b", (gap("pa", "pb") - gap("pa", "zb") - gap("pb", "za") + gap("za", "zb")).alias("value"))

    lacking = pair.select("lang", "a", "b", (F.col("both_lack") * gap("za", "zb")).alias("value"))
    add = lambda df: df.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sums = add(add(one_sided).unionByName(add(shared)).unionByName(lacking))
    turned = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    other = sums.select("lang", turned.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    over = priced.withColumn("q", share(F.col("total"), F.col("lang_size"))).where("p > q")
    term = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    # a group's best are cut in every task before they are dealt, so a frequent source is not one task's work
    term = term.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return other.withColumn("rank", F.row_number().over(best)).unionByName(term)
