"""Rules of term extraction as native column expressions: what is found, kept, rejected, or sent on for validation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
STOP_WORDS = (
    "the a an is are was were be been have has had do does did will would could should may might can shall "
    "i you he she it we they my your his her its our their this that these those what which who "
    "to of in for on with at by from and or but not so if than about up out no just also more "
    "some any all each every both"
).split()
GERUNDS = "appending serializing deserializing floating wrapping loading downloading subscribing referencing toggling de-serialized cross-platform cross-compile".split()
ADJECTIVES = (
    "hidden visible vertical horizontal floating absolute relative nested multiple various specific general dynamic static custom "
    "native proper basic simple complex actual original current previous following hardware software entropy random external "
    "internal main local global primary secondary default existing standard typical generic certain optional required initial final "
    "entire single separate different additional"
).split()
CATEGORIES = (
    "items elements values settings parameters options properties fields catalog orientation behavior handling management compatibility "
    "content position libraries events factors pool level keys engine mode navigation access support system design architecture "
    "configuration implementation specification"
).split()
NOT_ACRONYMS = (
    "THE AND BUT NOT FOR ARE WAS HAS HAD SO IT IS OR MY IN TO OF AT BY ON AN AS IF NO DO UP BE AM HE "
    "OUTPUT UPDATE EDIT OK ERROR WARNING INFO DEBUG TRUE FALSE NULL NONE TODO FIXME NOTE CODE LEVEL NEW END SET GET ADD "
    "PUT DELETE POST THEN ELSE CASE WHEN WITH FROM INTO LIKE WHERE ORDER GROUP"
).split()
STRUCTURE = [
    r"[().\[\]_:<>+]",
    r"[a-z][A-Z]",
    r"^[A-Z][A-Z0-9_]+$",
    r"(?i)^(Left|Right|Up|Down|Ctrl|Alt|Shift|Tab|Enter|Esc|PgUp|PgDn|PageUp|PageDown|Home|End|F\d+)(\s+(arrow|key))?$",
    r"(?i)^(arrow|page|up|down|left|right)(\s+(up|down|left|right|arrow|key|keys))(\s+(up|down|left|right|arrow|key|keys))?$",
    r"(?i)^(up/down|left/right)\s+(arrow|key|keys)$",
]
NO_VALIDATION = [r"[().\[\]_:<>]", *STRUCTURE[1:]]
INDICATORS = (
    r"\b(?:install|import|require|using|library|framework|module|package|gem|plugin|extension|dependency|sdk|api|cli|command|tool|app|"
    r"programming\s+language|written\s+in|built\s+with|powered\s+by|"
    r"\.(?:js|py|rb|java|cs|cpp|go|rs|ts|swift|kt|ex|sh|yaml|yml|json|xml|html|css|scss|sass|less|sql|md|txt|cfg|ini|conf|config|"
    r"dll|so|jar|whl|gem|egg|tar|gz|zip))\b"
)
#: name: (pattern, group, least length)
EXTRACTORS = {
    "camel": (r"\b[A-Z][a-z]+(?:[A-Z][a-z0-9]*)+\b", 0, 4),
    "lower_camel": (r"\b[a-z]+[A-Z][a-zA-Z0-9]*\b", 0, 4),
    "dotted": (r"(?U)\b\w+(?:\.\w+){1,5}\b", 0, 4),
    "call": (r"(?U)\b[\w.]+\(\)", 0, 4),
    "caps": (r"\b[A-Z][A-Z0-9_]{1,15}\b", 0, 2),
    "backtick": (r"`([^`]{2,50})`", 1, 2),
    "css_class": (r"(?U)(?<!\w)\.[a-zA-Z][a-zA-Z0-9_-]*\b", 0, 3),
    "brace_path": (r"/[^\s]*\{[^}]+\}[^\s]*", 0, 1),
    "path": (r"(?U)/(?:[\w.+-]+/)+[\w.+-]*", 0, 4),
}
NUMBER_DOTS = r"^\d+\.\d+(\.\d+)*$"
ENTITY_KINDS = {"api_paths": r"/[a-z0-9_-]+(?:/[a-z0-9_{}-]+)+", "functions": r"\b[a-z_][a-z0-9_]*\(\)", "configs": r"\b[a-z]+(?:[_.][a-z]+)+\b"}
ROUTES = {"negation": "negation_aware", "comparative": "bm25f_hybrid", "temporal": "synthetic_variants", "multi-hop": "adaptive_hybrid", "implicit": "adaptive_hybrid"}
NEGATION_WORDS = {"prohibition": ["avoid", "never", "prohibited", "anti-pattern"], "failure": ["error", "fails", "broken", "issue"], "limitation": ["limit", "maximum", "minimum", "restriction"], "consequence": ["impact", "result", "consequence", "effect"]}


def escaped(term: Column) -> Column:
    """A term as a pattern that matches it."""
    return F.regexp_replace(term, r"([^A-Za-z0-9_ ])", r"\\$1")


def any_of(term: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | term.rlike(p)
    return out


def structural_terms(text: Column) -> Column:
    """Distinct (kind, term) of nine shapes of identifiers and paths, with their lengths and exclusions."""
    excluded = {"caps": lambda t: t.isin(NOT_ACRONYMS), "dotted": lambda t: t.rlike(NUMBER_DOTS), "path": lambda t: t.rlike(r"^/\d+(/\d+)*$")}

    def of(kind: str, pattern: str, group: int, least: int) -> Column:
        terms = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda t: F.trim(t))
        kept = F.filter(terms, lambda t: F.length(t) >= least)
        if kind in excluded:
            kept = F.filter(kept, lambda t: ~excluded[kind](t))
        return F.transform(F.array_distinct(kept), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    return F.concat(*[of(kind, *rule) for kind, rule in EXTRACTORS.items()])


def seed_surface(seed: Column, text: Column) -> Column:
    """The first whole-word place of a seed in a text, as it is written there; null if there is none."""
    return F.nullif(F.call_function("regexp_extract", text, F.concat(F.lit(r"(?i)\b"), escaped(seed), F.lit(r"\b")), F.lit(0)), F.lit(""))


def keep_structural(term: Column) -> Column:
    return any_of(term, STRUCTURE)


def version_fragment(term: Column, text: Column) -> Column:
    """A version that the text has only as the start of a longer one."""
    v = escaped(term)
    return F.regexp_like(text, F.concat(v, F.lit(r"\.\d+"))) & ~F.regexp_like(text, F.concat(v, F.lit(r"(?!\.\d)")))


def version_orphan(term: Column, text: Column) -> Column:
    """A version without a name, `v` or `version` before it."""
    v = escaped(term)
    return ~F.regexp_like(text, F.concat(F.lit(r"(?i)(?:[A-Za-z][\w.-]*\s+)"), v, F.lit(r"|(?:v|version\s+)"), v))


def version_noise(term: Column, text: Column) -> Column:
    """Of versions of two numbers those that are fragments or orphans."""
    return F.when(term.rlike(r"^\d+\.\d+$"), version_fragment(term, text) | version_orphan(term, text)).otherwise(False)


def noise_rule(term: Column, text: Column, negative: Column, bypass: Column) -> Column:
    """The first rule that decides: `reject_...` or `keep_...`; `keep` if none does. negative, bypass: whether it is listed."""
    t = F.trim(term)
    low = F.lower(t)
    n = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    first, second = F.regexp_extract(low, r"^(\S+)", 1), F.regexp_extract(low, r"(\S+)$", 1)
    plain = ~F.substring(t, F.lit(2), F.length(t)).rlike("[A-Z]") & ~t.rlike(r"[()._:<>\[\]]")
    return (
        F.when(F.length(t) <= 1, "reject_short")
        .when(t.rlike(r"^\d+$"), "reject_number")
        .when(low.isin(STOP_WORDS), "reject_stop_word")
        .when(low.isin(GERUNDS), "reject_gerund")
        .when(t.rlike(r"^www\.") | t.rlike(r"https?://\S+") | t.rlike(r"^https?://"), "reject_url")
        .when(version_noise(t, text), "reject_version")
        .when(negative, "reject_negative")
        .when(keep_structural(t), "keep_structural")
        .when(bypass, "keep_bypass")
        .when(t.rlike(r"^[A-Z]+-\d+$"), "reject_ticket")
        .when((n == 2) & first.isin(ADJECTIVES), "reject_adjective")
        .when((n == 2) & second.isin(CATEGORIES), "reject_category")
        .when((n >= 3) & plain, "reject_phrase")
        .otherwise("keep")
    )


def needs_context(term: Column, bypass: Column) -> Column:
    """Single lower-case words of three letters or more that no list vouches for."""
    return ~bypass & term.rlike(r"^[a-z]{3,}$")


def needs_evidence(term: Column, bypass: Column) -> Column:
    """Whatever no list and no structure vouches for."""
    return ~bypass & ~any_of(term, NO_VALIDATION)


def technical_context(term: Column, text: Column, around: int = 120) -> Column:
    """Whether a technical indicator stands within `around` characters of a whole-word place of the term, or in it."""
    word = F.concat(F.lit(r"\b"), escaped(F.lower(term)), F.lit(r"\b"))
    gap = F.lit(f".{{0,{around}}}")
    near = lambda *parts: F.regexp_like(F.lower(text), F.concat(F.lit("(?s)"), *parts))
    return near(F.lit(INDICATORS), gap, word) | near(word, gap, F.lit(INDICATORS)) | (F.lower(term).rlike(INDICATORS) & near(word))


def embedded_in_braces(term: Column, text: Column) -> Column:
    """A term that the text has as a word only within braces."""
    word = F.concat(F.lit(r"\b"), escaped(F.lower(term)), F.lit(r"\b"))
    body = F.lower(text)
    inside = F.regexp_like(body, F.concat(F.lit(r"\{[^}]*"), word, F.lit(r"[^}]*\}")))
    return inside & ~F.regexp_like(F.regexp_replace(body, r"\{[^}]+\}", ""), word)


def regex_entities(text: Column, each: int = 5) -> Column:
    """Up to `each` distinct ones of API paths, functions and settings, as an array of (label, texts)."""
    return F.array(*[F.struct(F.lit(k).alias("label"), F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(p), F.lit(0))), 1, each).alias("texts")) for k, p in ENTITY_KINDS.items()])


def negation_expanded(query: Column, types: Column) -> Column:
    """The query and the words of its negation types that it lacks."""
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in NEGATION_WORDS.items()])
    new = F.flatten(F.transform(F.filter(pairs, lambda p: F.array_contains(types, p["k"])), lambda p: p["v"]))
    return F.concat_ws(" ", query, F.array_join(F.filter(new, lambda w: ~F.contains(F.lower(query), w)), " "))


def route(query_type: Column) -> Column:
    """The search strategy of a query type."""
    out = None
    for k, v in ROUTES.items():
        out = F.when(query_type == k, v) if out is None else out.when(query_type == k, v)
    return out


def occurrences(term: Column, text: Column) -> Column:
    """How often a term occurs in a text, without overlaps, in any case."""
    t, body = F.lower(term), F.lower(text)
    return F.when(F.length(t) > 0, (F.length(body) - F.length(F.replace(body, t, F.lit("")))) / F.length(t)).otherwise(0).cast("long")


def parsed_terms(answer: Column) -> Column:
    """Terms of a model's answer: the first JSON object's `terms` or `entities`, else its lines without bullets."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    schema = "terms array<string>, entities array<string>"
    got = F.from_json(inner, schema)
    lines = F.filter(F.transform(F.split(answer, "\n"), lambda x: F.regexp_replace(F.trim(x), r"^(?:[-*•]|\d+[.)])\s*", "")), lambda x: (F.length(x) > 1) & ~x.rlike(r"[{}\[\]]"))
    return F.coalesce(got["terms"], got["entities"], lines)


def _in_order(pattern: str, text: str) -> Iterator[re.Match]:
    return re.finditer(pattern, text, re.IGNORECASE)


def expanded_span(term: str, text: str) -> str:
    """The longer span of the text that a term is part of: a call's parentheses, a dotted prefix, a versioned server or client,
    an error's name, a slash compound, or up to three words that end in a kind of software; else the term."""
    own = term.strip()
    at = text.lower().find(own.lower())
    if at < 0:
        return term
    end = at + len(own)
    written, after = text[at:end], text[end:]
    if own.endswith(")"):
        prefix = re.search(r"(?:[\w:]+\.)+$", text[:at])
        if prefix and len(prefix.group() + written) <= 80:
            return prefix.group() + written
    elif after.startswith("("):
        depth = stop = 0
        for stop, c in enumerate(after, 1):
            depth += (c == "(") - (c == ")")
            if not depth:
                break
        if len(written) + stop <= 80:
            return written + after[:stop]
    version = re.match(r"\s+\d+[A-Za-z]*(?:\s+\w+)?", after)
    if version and (written + version.group()).lower().endswith((" server", " client")):
        return written + version.group()
    if re.match(r"(?:error|internal)\s+\d+", own, re.IGNORECASE):
        name = re.search(r"(?:server\s+)?(?:internal\s+)?(?:server\s+)?$", text[:at], re.IGNORECASE).group()
        if name.strip() and len(name + written) <= 80:
            return name + written
    for m in _in_order(rf"(\S+/)?{re.escape(own)}(/\S+)?", text):
        if (m.group(1) or m.group(2)) and len(m.group()) <= 100:
            return m.group()
        break
    if " " not in own and not own.endswith(")"):
        more = re.match(r"(?:\s+\w+){1,3}", after[:50])
        if more and re.search(r"\b(?:API|SDK|framework|library|protocol)\b", written + more.group(), re.IGNORECASE):
            return (written + more.group()).strip()
    return term


def expanded_spans(term: Column, text: Column) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([expanded_span(p or "", q or "") for p, q in zip(t, x)])

    return run(term, text)
