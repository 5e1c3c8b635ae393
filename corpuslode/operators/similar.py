"""Similarity joins of short texts: candidates share a rare q-gram, and are verified exactly.

The likeness is the indel ratio: 2 x longest common subsequence / both lengths. A pair at `least` or more differs by few
insertions and deletions; each spoils at most two (a deletion) or one (an insertion) of the shorter text's pairs of
characters. So of the shorter text's rarest such pairs, one more than can be spoilt, at least one is in the longer text, not
further off than the difference allows. Only texts that meet so are compared; no pairs of all texts of a group are made.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.operators.evaluate import _normal, _singular, _spaced, fuzzy_match, lcs_ratio

#: Distinct q-grams whose counts order them; all further ones count as rarest.
MOST_GRAMS = 200_000
SHORT, LONG, EQUAL = 0, 1, 2


@functools.lru_cache(4096)
def allowed(n: int, least: float) -> tuple[int, int]:
    """Of a text of n characters and one at least as long that is `least` alike: (pairs of characters that can be spoilt, edits)."""
    miss, spoilt, edits = 1 - least / 100, 0, 0
    for gone in range(n + 1):
        # gone + more <= miss * (2 n + more - gone), so that much can be put in; the other text is not shorter
        more = int((miss * (2 * n - gone) - gone) / (1 - miss) + 1e-9) if miss < 1 else n
        if more < gone:
            break
        spoilt, edits = max(spoilt, 2 * gone + more), max(edits, gone + more)
    return spoilt, edits


def grams(text: str) -> list[tuple[str, int]]:
    """The pairs of neighbouring characters with their places; of one that comes again, the number of times so far is part of it."""
    seen: Counter = Counter()
    out = []
    for i in range(len(text) - 1):
        g = text[i : i + 2]
        out.append((f"{g}{seen[g]}" if seen[g] else g, i))
        seen[g] += 1
    return out


def _order(*sides: DataFrame) -> dict[str, int]:
    """How often the pairs of characters come in distinct terms, of the most frequent ones."""
    every = None
    for s in sides:
        one = s.select("term").distinct()
        every = one if every is None else every.unionByName(one)
    at = F.sequence(F.lit(1), F.length("term") - 1)
    pairs = every.where(F.length("term") >= 2).select(F.explode(F.transform(at, lambda i: F.substring(F.col("term"), i, 2))).alias("g"))
    top = pairs.groupBy("g").count().orderBy(F.desc("count"), "g").limit(MOST_GRAMS).collect()
    return {r[0]: r[1] for r in top}


def _tokens(side: DataFrame, keys: list[str], order, least: float, form: Callable[[str], str], more: Callable[[str], list[str]]) -> DataFrame:  # noqa: ANN001
    """(keys, term, size, kind, token, place): what a term meets others by."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = order.value
        for b in it:
            row, size, kind, token, place = [], [], [], [], []

            def put(k: int, n: int, what: int, t: str, at: int) -> None:
                row.append(k), size.append(n), kind.append(what), token.append(t), place.append(at)

            for k, raw in enumerate(b.column("term").to_pylist()):
                term = form(raw)
                for t in more(raw):
                    put(k, len(term), EQUAL, t, 0)
                own = grams(term)
                rare = sorted(own, key=lambda g: (count.get(g[0][:2], 0), g))
                for t, at in rare[: allowed(len(term), least)[0] + 1]:
                    put(k, len(term), SHORT, t, at)
                for t, at in own:
                    put(k, len(term), LONG, t, at)
            at = pa.array(row, pa.int64())
            columns = [b.column(c).take(at) for c in (*keys, "term")]
            columns += [pa.array(size, pa.int32()), pa.array(kind, pa.int32()), pa.array(token, pa.string()), pa.array(place, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "term", "size", "kind", "token", "place"])

    kinds = dict(side.dtypes)
    own = side.where("term is not null").select(*keys, "term").distinct()
    return own.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, "term")), "size int", "kind int", "token string", "place int"]))


def _verified(pairs: DataFrame, keys: list[str], test: Callable[[str, str], float | None]) -> DataFrame:
    """pairs (keys, a, b) with the `ratio` that test gives them, where it gives one."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ratio = pa.array([test(x, y) for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist())], pa.float64())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keys, "a", "b")), ratio], names=[*keys, "a", "b", "ratio"])
            yield out.filter(ratio.is_valid())

    kinds = dict(pairs.dtypes)
    return pairs.select(*keys, "a", "b").mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, "a", "b")), "ratio double"]))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], least: float, form: Callable[[str], str], more: Callable[[str], list[str]], far: bool) -> DataFrame:
    """Distinct (keys, a, b) that share an equal token, or a rare pair of characters of the shorter one. far: at any place."""
    order = left.sparkSession.sparkContext.broadcast(_order(left.select(F.lower("term").alias("term")), right.select(F.lower("term").alias("term"))))
    a, b = (_tokens(x, keys, order, least, form, more) for x in (left, right))
    a = a.select(*keys, F.col("term").alias("a"), F.col("size").alias("na"), F.col("kind").alias("ka"), "token", F.col("place").alias("pa"))
    b = b.select(*keys, F.col("term").alias("b"), F.col("size").alias("nb"), F.col("kind").alias("kb"), "token", F.col("place").alias("pb"))
    # the shorter one brings its rare pairs, the longer one all of its own
    roles = F.when(F.col("na") <= F.col("nb"), (F.col("ka") == SHORT) & (F.col("kb") == LONG)).otherwise((F.col("ka") == LONG) & (F.col("kb") == SHORT))
    miss = 1 - least / 100
    near = F.lit(True) if far else (F.abs(F.col("pa") - F.col("pb")) <= miss * (F.col("na") + F.col("nb"))) & (F.abs(F.col("na") - F.col("nb")) <= miss * (F.col("na") + F.col("nb")))
    meet = ((F.col("ka") == EQUAL) & (F.col("kb") == EQUAL)) | (roles & near)
    return a.join(b, [*keys, "token"]).where(meet).select(*keys, "a", "b").distinct()


def similar(left: DataFrame, right: DataFrame, keys: list[str] = (), least: float = 85.0) -> DataFrame:  # type: ignore[assignment]
    """(keys, a, b, ratio): terms of left and right (keys, term) with equal keys that are `least` or more alike in lower case.

    Null terms and null keys meet nothing; repeated rows count once; empty terms are alike.
    """
    keys = list(keys)
    if least < 85:
        raise ValueError("least is 85 or more: below that, short texts can be alike without a common pair of characters")

    def test(x: str, y: str) -> float | None:
        found = lcs_ratio(x.lower(), y.lower())
        return round(found, 6) if found >= least else None

    pairs = _joined(left, right, keys, least, str.lower, lambda t: [t.lower()] if len(t) < 2 else [], False)
    return _verified(pairs, keys, test)


def _forms(term: str) -> list[str]:
    """What fuzzy terms meet by besides likeness: singular forms, words, and short words' singulars."""
    own = _normal(term)
    return list({f"= {_singular(own)}", f"= {_singular(_spaced(term))}", *own.split(), *_singular(own).split()})


def fuzzy(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, ratio) of the pairs with equal keys that evaluate.fuzzy_match() takes for one thing."""

    def test(x: str, y: str) -> float | None:
        return round(lcs_ratio(_normal(x), _normal(y)), 6) if fuzzy_match(x, y) else None

    # 85 alike as wholes; or the shorter one 90 with a stretch of the longer one: that spoils no more of its pairs
    return _verified(_joined(left, right, keys, 85.0, _normal, _forms, True), keys, test)


def spans_like(terms: DataFrame, texts: DataFrame, keys: list[str], least: float = 90.0) -> DataFrame:
    """(keys, term, found) of terms (keys, term): whether the texts (keys, text) with their keys have a like stretch of words.

    A stretch has as many words as the term or one more (evaluate.fuzzy_span()).
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    own = terms.where("term is not null").select(*keys, "term").distinct()
    size = F.size(F.filter(F.split("term", r"\s+"), lambda w: w != ""))
    sized = own.withColumn("_words", F.explode(F.array(size, size + 1))).where(size > 0)
    wanted = sized.select(*keys, "_words").distinct()
    text = texts.where("text is not null").select(*keys, words.alias("w")).join(wanted, keys).where(F.size("w") >= F.col("_words"))
    spans = text.select(*keys, "_words", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("_words") + 1), lambda i: F.array_join(F.slice("w", i, F.col("_words")), " "))).alias("term"))
    hits = similar(sized.select(*keys, "_words", "term"), spans, [*keys, "_words"], least).select(*keys, F.col("a").alias("term")).distinct()
    return own.join(hits.withColumn("found", F.lit(True)), [*keys, "term"], "left").withColumn("found", F.coalesce("found", F.lit(False)))
