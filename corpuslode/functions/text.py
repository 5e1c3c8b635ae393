"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
CAMEL_CASE = r"(?U)\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b"
ALL_CAPS = r"(?U)\b[A-Z][A-Z_]{2,}\b"
DOT_PATH = r"(?U)\b[a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+\b"
BACKTICK = r"`([^`]+)`"
FUNCTION_CALL = r"(?U)\b[a-zA-Z_]\w*\(\)"
TECHNICAL_PATTERNS = [r"[a-z]+[A-Z][a-z]+", r"[A-Z][a-z]+[A-Z]", r"[a-z]+_[a-z]+", r"(?U)\b[A-Z]{2,}\b", r"/[a-z]+", r"\d+[a-z]+"]
TECHNICAL_KEYWORDS = ["configuration", "parameter", "endpoint", "yaml", "json", "api", "database", "cache", "pool", "replica", "timeout", "kubernetes", "docker", "nginx", "redis", "kafka", "postgresql"]
QUERY_TYPES = {
    "negation": ["not", "without", "except", "exclude", "never"],
    "comparative": ["vs", "versus", "difference", "compare", "better", "worse"],
    "temporal": ["when", "sequence", "order", "timeline", "after", "before", "during"],
    "multi-hop": ["compare", "relate", "both", "and", "between"],
}
NEGATIONS = {
    "prohibition": [r"\bshould(?:n't| not)\b", r"\bavoid\b", r"\bnever\b"],
    "failure": [r"\bdoes(?:n't| not)\s+work\b", r"\bwhy\s+can't\b"],
    "limitation": [r"\bcan(?:n't| not)\b", r"\bminimum\b", r"\bmaximum\b"],
    "consequence": [r"\bwhat\s+happens\s+if\s+(?:i\s+)?(?:don't|do not)\b"],
}
EXPANSIONS = {
    "rpo": "recovery point objective RPO data loss backup",
    "recovery point objective": "RPO data loss backup disaster recovery",
    "rto": "recovery time objective RTO downtime recovery restore",
    "recovery time objective": "RTO downtime recovery restore disaster",
    "jwt": "JSON web token JWT authentication iat exp issued claims",
    "token": "JWT authentication token iat exp issued claims expiration",
    "database stack": "PostgreSQL Redis Kafka database storage data layer",
    "database": "PostgreSQL Redis Kafka storage data layer",
    "monitoring stack": "Prometheus Grafana Jaeger observability metrics tracing",
    "monitoring": "Prometheus Grafana Jaeger observability metrics tracing",
    "observability": "Prometheus Grafana Jaeger monitoring metrics tracing",
    "hpa": "horizontal pod autoscaler HPA scaling replicas CPU utilization",
    "autoscaling": "horizontal pod autoscaler HPA scaling replicas CPU utilization",
    "autoscaler": "horizontal pod autoscaler HPA scaling replicas CPU",
}


def words(text: Column) -> Column:
    """The white-space-separated words of a text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")


def tokens(text: Column) -> Column:
    """Lower-cased words: no stop-words, no stemming, punctuation stays."""
    return words(F.lower(text))


def heuristic_terms(text: Column) -> Column:
    """Distinct identifiers of five shapes, in order of their text."""
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (CAMEL_CASE, ALL_CAPS, DOT_PATH)]
    found += [F.regexp_extract_all(text, F.lit(BACKTICK), F.lit(1)), F.regexp_extract_all(text, F.lit(FUNCTION_CALL), F.lit(0))]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def normalize_term(term: Column) -> Column:
    return F.translate(F.trim(F.lower(term)), "-_", "  ")


def camel_to_words(term: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(term, "([a-z])([A-Z])", "$1 $2")))


def depluralize(term: Column) -> Column:
    n = F.length(term)
    cut = lambda k: F.substring(term, F.lit(1), n - k)
    return F.when(term.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y"))).when(term.endswith("es") & (n > 4), cut(2)).when(term.endswith("s") & (n > 3), cut(1)).otherwise(term)


def verify_span(term: Column, content: Column | None = None, body: Column | None = None) -> Column:
    """How a term is grounded in a text: the first rule that holds, else `none`. body: the text in lower case, if it is there."""
    body, t = F.lower(content) if body is None else body, F.trim(F.lower(term))
    n = F.length(t)
    camel = F.lower(F.regexp_replace(term, "([a-z])([A-Z])", "$1 $2"))
    return (
        F.when(F.length(F.coalesce(term, F.lit(""))) < 2, "too_short")
        .when(F.contains(body, t), "exact")
        .when(F.contains(F.translate(body, "-_", "  "), F.translate(t, "-_", "  ")), "normalized")
        .when((camel != t) & F.contains(body, camel), "camelcase")
        .when(t.endswith("s") & (n > 3) & F.contains(body, F.substring(t, F.lit(1), n - 1)), "singular_of_plural")
        .when(~t.endswith("s") & F.contains(body, F.concat(t, F.lit("s"))), "plural_of_singular")
        .when(t.endswith("es") & (n > 4) & F.contains(body, F.substring(t, F.lit(1), n - 2)), "singular_of_plural_es")
        .otherwise("none")
    )


def technical_score(query: Column) -> Column:
    """0.1 for each pattern and each keyword that occurs, at most 0.5 of either."""
    count = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    a = F.least(count([query.rlike(p) for p in TECHNICAL_PATTERNS]) * 0.1, F.lit(0.5))
    b = F.least(count([F.contains(F.lower(query), F.lit(k)) for k in TECHNICAL_KEYWORDS]) * 0.1, F.lit(0.5))
    return F.least(a + b, F.lit(1.0))


def query_type(query: Column) -> Column:
    """The first type that has a keyword in the query, as a substring."""
    out = None
    for name, keys in QUERY_TYPES.items():
        hit = F.lower(query).rlike("|".join(keys))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("implicit")


def negation_types(query: Column) -> Column:
    every = [F.when(F.lower(query).rlike("|".join(p)), F.lit(name)) for name, p in NEGATIONS.items()]
    return F.filter(F.array(*every), lambda x: x.isNotNull())


def expansions(query: Column, known: dict[str, str] | None = None) -> tuple[Column, Column]:
    """(matched keys, expanded query): the query and the new terms of all keys it holds, in code-point order."""
    known = EXPANSIONS if known is None else known
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.split(F.lit(v), " ").alias("terms")) for k, v in known.items()])
    hits = F.filter(pairs, lambda p: F.contains(F.lower(query), p["key"]))
    have = tokens(query)
    new = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda p: p["terms"]))), lambda t: ~F.array_contains(have, F.lower(t)))
    text = F.when(F.size(hits) > 0, F.concat(query, F.lit(" "), F.array_join(F.array_sort(new), " "))).otherwise(query)
    return F.transform(hits, lambda p: p["key"]), text


def enriched(content: Column, keywords: Column, entities: Column) -> Column:
    """`keywords | entities`, a blank line, the content: 7 keywords; 2 entities a label, 5 in all, labels in their order."""
    kept = F.slice(F.flatten(F.transform(entities, lambda e: F.slice(e["texts"], 1, 2))), 1, 5)
    parts = F.filter(F.array(F.array_join(F.slice(keywords, 1, 7), ", "), F.array_join(kept, ", ")), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.concat(F.array_join(parts, " | "), F.lit("\n\n"), content)).otherwise(content)


def snippet(term: Column, text: Column, around: int = 60, fallback: int = 150) -> Column:
    """The text around a term's first place, with ellipses where it is cut; without the term, the text's start."""
    at = F.call_function("locate", F.lower(term), F.lower(text))
    lo = F.greatest(at - 1 - around, F.lit(0))
    hi = F.least(at - 1 + F.length(term) + around, F.length(text))
    cut = F.concat(F.when(lo > 0, "...").otherwise(""), F.substring(text, lo + 1, hi - lo), F.when(hi < F.length(text), "...").otherwise(""))
    return F.when(at > 0, cut).otherwise(F.substring(text, 1, fallback))


def confidence(sources: Column, ratio: Column) -> Column:
    return F.least(sources / 3, F.lit(1.0)) * 0.6 + ratio * 0.4


def level(score: Column, high: float = 0.8, medium: float = 0.5) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def shingle_jaccard(a: Column, b: Column, n: int = 13) -> Column:
    """Jaccard similarity of the distinct character n-grams of two texts; 0 if neither has any."""
    grams = lambda x: F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - n + 1, F.lit(1))), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array())
    x, y = grams(a), grams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def normalize_url(url: Column) -> tuple[Column, Column]:
    """(path without a trailing slash, fragment or null)."""
    path = F.regexp_replace(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return path, F.parse_url(url, F.lit("REF"))


def slug(heading: Column) -> Column:
    """A heading's anchor: lower case, marks out, blanks to hyphens."""
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(heading)), r"[^a-z0-9\s-]", ""), r"[\s-]+", "-")


def normalize_answer(text: Column) -> Column:
    """Entities unescaped, white space collapsed, trimmed, lower case."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


FENCE = r"(?s)```.*?```"


def code_ratio(text: Column) -> Column:
    """The share of a text's characters within code fences."""
    total = F.aggregate(F.regexp_extract_all(text, F.lit(FENCE), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.coalesce(total / F.nullif(F.length(text), F.lit(0)), F.lit(0.0))


def without_code(text: Column, most: float = 0.3, least: int = 50) -> Column:
    """The text that keywords are taken from: without code if there is too much of it; null if too little is left."""
    kept = F.trim(F.when(code_ratio(text) > most, F.regexp_replace(text, FENCE, " ")).otherwise(text))
    return F.when(F.length(kept) >= least, kept)
