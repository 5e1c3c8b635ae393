"""Answers and what they quote: texts of HTML, quotes, containment, anchors, trust tiers, checks of generated cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslode.functions.text import normalize_answer

#: Sentences that say nothing about their source.
GENERIC = ("run the following command", "see the documentation for more details", "the following example shows", "for more information, see", "this is an example of how to")
QUOTE, RECIPROCAL = 30, 20
#: kind: (pattern, whether texts with code or quotes inside are left out)
HTML_TEXTS = {
    "code": (r"(?s)<(?:code|pre)(?:\s[^>]*)?>(.*?)</(?:code|pre)>", False),
    "blockquote": (r"(?s)<blockquote(?:\s[^>]*)?>(.*?)</blockquote>", False),
    "prose": (r"(?s)<p(?:\s[^>]*)?>(.*?)</p>", True),
}
INNER = r"<(?:code|pre|blockquote)"


def html_texts(html: Column) -> Column:
    """(kind, text) of the code, quotes and prose of HTML, tags stripped and entities read; empty ones are left out."""

    def of(kind: str, pattern: str, plain: bool) -> Column:
        found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
        if plain:
            found = F.filter(found, lambda x: ~x.rlike(INNER))
        texts = F.transform(found, lambda x: F.trim(unescaped(F.regexp_replace(x, "<[^>]*>", ""))))
        return F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("text")))

    return F.concat(*[of(k, *rule) for k, rule in HTML_TEXTS.items()])


def unescaped(text: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def is_generic(text: Column) -> Column:
    return F.lower(F.trim(text)).isin(*GENERIC)


def quote_matches(html: Column, content: Column, least: int = QUOTE) -> Column:
    """(kind, text, length) of an answer's texts that a chunk quotes: as normalised, not generic, of `least` characters."""
    body = normalize_answer(content)
    own = F.transform(html_texts(html), lambda x: F.struct(x["kind"].alias("kind"), normalize_answer(x["text"]).alias("text"), F.length(normalize_answer(x["text"])).alias("length")))
    return F.filter(own, lambda x: (x["length"] >= least) & ~is_generic(x["text"]) & F.contains(body, x["text"]))


def plain_words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def reciprocal_match(html: Column, content: Column, least: int = RECIPROCAL) -> tuple[Column, Column]:
    """(direction, words): which of answer and chunk holds all the other's words in a row, if these are `least` or more."""
    a, c = plain_words(F.regexp_replace(html, "<[^>]*>", " ")), plain_words(content)
    text = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    inside = (F.size(c) >= least) & F.contains(text(a), text(c))
    around = (F.size(a) >= least) & F.contains(text(c), text(a))
    return F.when(inside, "chunk_in_answer").when(around, "answer_in_chunk"), F.when(inside, F.size(c)).when(around, F.size(a))


def anchor(text: Column) -> Column:
    """A fragment as headings' anchors are written."""
    x = F.regexp_replace(F.lower(F.regexp_replace(text, "^#", "")), r"[_\s]", "-")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^a-z0-9-]", ""), "-+", "-"), "^-+|-+$", "")


def url_path(url: Column) -> Column:
    """The path without a trailing slash; the root stays `/`, no path is empty."""
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(path == "/", "/").otherwise(F.regexp_replace(path, "/+$", ""))


def heading_slug(heading: Column) -> Column:
    """A heading's anchor: marks and symbols out, blanks and hyphens as one hyphen, none at either end."""
    x = F.regexp_replace(F.lower(heading), r"[^a-z0-9\s-]", "")
    return F.regexp_replace(F.regexp_replace(F.trim(x), r"[\s-]+", "-"), "^-+|-+$", "")


def trust(fragment: Column, quote: Column, reciprocal: Column, url: Column, upvotes: Column, accepted: Column, same_url: Column) -> Column:
    """(tier, reason, confidence, signals) by the strongest signal; quote: longest match in characters, reciprocal: in words.

    Gold: a fragment that is a heading (1), a quote of 30 characters (0.9; of over 50: 1), 20 words in a row (0.85, 0.005 more
    for each further word, at most 1). Silver: 10 votes and accepted, or 25 (0.75; 15 and accepted 0.85), or three answers
    with one URL and 5 votes (0.7). Bronze: a URL and 5 votes (0.6, 0.01 more for each further vote, at most 0.75).
    """
    quote, reciprocal = F.coalesce(quote, F.lit(0)), F.coalesce(reciprocal, F.lit(0))
    high = url & ((accepted & (upvotes >= 10)) | (upvotes >= 25))
    rules = [
        ("gold", "fragment_anchor_match", F.lit("fragment_anchor_match"), fragment, F.lit(1.0)),
        ("gold", "quote_match", F.concat(F.lit("quote_match_"), quote, F.lit("_chars")), quote >= QUOTE, F.when(quote > 50, 1.0).otherwise(0.9)),
        ("gold", "reciprocal_containment", F.concat(F.lit("reciprocal_containment_"), reciprocal, F.lit("_words")), reciprocal >= RECIPROCAL, F.least(F.lit(1.0), 0.85 + 0.005 * (reciprocal - RECIPROCAL))),
        ("silver", "url_high_trust", F.lit("url_high_trust"), high, F.when(accepted & (upvotes >= 15), 0.85).otherwise(0.75)),
        ("silver", "url_corroborated", F.lit("url_corroborated"), url & (same_url >= 3) & (upvotes >= 5), F.lit(0.7)),
        ("bronze", "url_community_validated", F.lit("url_community_validated"), url & (upvotes >= 5), F.least(F.lit(0.75), 0.6 + 0.01 * (upvotes - 5))),
    ]
    signals = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for _, name, _, hit, _ in rules]))
    made = lambda tier, reason, score: F.struct(F.lit(tier).alias("tier"), reason.alias("reason"), F.round(score, 6).alias("confidence"), signals.alias("signals"))
    out = None
    for tier, _, reason, hit, score in rules:
        out = F.when(hit, made(tier, reason, score)) if out is None else out.when(hit, made(tier, reason, score))
    return out.otherwise(made("exclude", F.lit("insufficient_signal"), F.lit(0.0)))


def fenced_json(answer: Column) -> Column:
    """The JSON object of a model's answer, bare or in a code fence; null if there is none."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(F.trim(answer), r"(?s)^(\{.*\})$", 1)
    found = F.when(fenced != "", fenced).when(bare != "", bare)
    return F.when(F.from_json(found, "map<string,string>").isNotNull(), found)


def case_problem(query: Column, quote: Column, tier: Column, content: Column, least_words: int = 6) -> Column:
    """Why a generated case is no good; null if it is."""
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    n = F.size(F.filter(F.split(query, r"\s+"), lambda w: w != ""))
    return (
        F.when(F.coalesce(n, F.lit(0)) < least_words, "query too short")
        .when(~F.contains(squeezed(content), squeezed(F.coalesce(quote, F.lit("")))), "quote not found verbatim")
        .when((tier == "gold") & (F.length(F.coalesce(quote, F.lit(""))) < QUOTE), "gold quote too short")
    )
