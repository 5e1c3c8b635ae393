"""Queries of the text functions, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslode.functions import text as X
from corpuslode.plans.registry import query, table

TOKENS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda t: t <> '')"
TERMS = "select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{4,}'))) as term, text from documents"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))).alias("term"), "text")


@query("str1_tokens", f"select term, count(*) as n from (select unnest({TOKENS}) as term from documents) group by term")
def str1(spark, sf):
    return table(spark, sf, "documents").select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_PLAIN = "regexp_replace(text, '[^\\x00-\\x7F]', '0', 'g')"


@query(
    "str2_identifiers",
    f"""select doc_id, len(regexp_extract_all(t, '\\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\\b')) as n_camel, len(regexp_extract_all(t, '\\b[A-Z][A-Z_]{{2,}}\\b')) as n_caps,
len(regexp_extract_all(t, '`([^`]+)`', 1)) as n_backtick, len(regexp_extract_all(t, '\\b[a-zA-Z_]\\w*\\(\\)')) as n_calls, len(regexp_extract_all(t, '\\b[a-zA-Z_]\\w*(?:\\.[a-zA-Z_]\\w*)+\\b')) as n_dotted
from (select doc_id, {_PLAIN} as t from documents)""",
)
def str2(spark, sf):
    n = lambda p, g=0: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(g))).cast("long")
    return table(spark, sf, "documents").select("doc_id", n(X.CAMEL_CASE).alias("n_camel"), n(X.ALL_CAPS).alias("n_caps"), n(X.BACKTICK, 1).alias("n_backtick"), n(X.FUNCTION_CALL).alias("n_calls"), n(X.DOT_PATH).alias("n_dotted"))


@query("str7_heuristic_terms")
def str7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(X.heuristic_terms(F.col("text"))).alias("term"))


_FOUND = ", ".join(f"regexp_extract_all(t, {quoted(p.removeprefix('(?U)'))}, {g})" for p, g in ((X.CAMEL_CASE, 0), (X.ALL_CAPS, 0), (X.DOT_PATH, 0), (X.BACKTICK, 1), (X.FUNCTION_CALL, 0)))


@query("str7_plain_terms", f"select doc_id, n, term from (select doc_id, unnest(x) as term, unnest(range(1, len(x) + 1))::int as n from (select doc_id, list_sort(list_distinct(flatten([{_FOUND}]))) as x from (select doc_id, {_PLAIN} as t from documents)))")
def str7b(spark, sf):
    """str7 with its order, on texts whose other letters than ASCII's are 0, as SQL's patterns know ASCII words only."""
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "0")
    own = table(spark, sf, "documents").select("doc_id", F.posexplode(X.heuristic_terms(plain)).alias("i", "term"))
    return own.select("doc_id", (F.col("i") + 1).alias("n"), "term")


@query("str10_normalize_term", "select distinct translate(trim(lower(source || '-' || lang || '_X')), '-_', '  ') as term from documents")
def str10(spark, sf):
    return table(spark, sf, "documents").select(X.normalize_term(F.concat("source", F.lit("-"), "lang", F.lit("_X"))).alias("term")).distinct()


_SPAN = """case when length(term) < 2 then 'too_short'
when contains(b, t) then 'exact'
when contains(translate(b, '-_', '  '), translate(t, '-_', '  ')) then 'normalized'
when lower(regexp_replace(term, '([a-z])([A-Z])', '\\1 \\2', 'g')) <> t and contains(b, lower(regexp_replace(term, '([a-z])([A-Z])', '\\1 \\2', 'g'))) then 'camelcase'
when t like '%s' and length(t) > 3 and contains(b, t[:-2]) then 'singular_of_plural'
when t not like '%s' and contains(b, t || 's') then 'plural_of_singular'
when t like '%es' and length(t) > 4 and contains(b, t[:-3]) then 'singular_of_plural_es' else 'none' end"""


@query(
    "str11_verify_span",
    f"""select reason, count(*) as n from (select {_SPAN} as reason from
(select term, trim(lower(term)) as t, lower(text) as b from (
 select d.text, v.term from documents d, (values ('thes'), ('inOf'), ('the-erthes'), ('x'), ('andes'), ('ofThe'), ('zzz')) v(term)))) group by reason""",
)
def str11(spark, sf):
    terms = F.explode(F.array(*[F.lit(x) for x in ("thes", "inOf", "the-erthes", "x", "andes", "ofThe", "zzz")]))
    d = table(spark, sf, "documents").select("text", terms.alias("term"))
    return d.select(X.verify_span(F.col("term"), F.col("text")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "str12_term_forms",
    f"""select term, case when term like '%ies' and length(term) > 4 then term[:-4] || 'y' when term like '%es' and length(term) > 4 then term[:-3]
when term like '%s' and length(term) > 3 then term[:-2] else term end as singular, trim(lower(regexp_replace(term, '([a-z])([A-Z])', '\\1 \\2', 'g'))) as spaced
from (select distinct term from ({TERMS}))""",
)
def str12(spark, sf):
    t = F.col("term")
    return _terms(spark, sf).select("term").distinct().select("term", X.depluralize(t).alias("singular"), X.camel_to_words(t).alias("spaced"))


@query(
    "str20_snippets",
    """select doc_id, case when p > 0 then (case when greatest(p - 61, 0) > 0 then '...' else '' end) || substr(text, greatest(p - 61, 0) + 1, least(p + 64, length(text)) - greatest(p - 61, 0))
|| (case when least(p + 64, length(text)) < length(text) then '...' else '' end) else substr(text, 1, 150) end as snippet
from (select doc_id, text, strpos(lower(text), 'ention') as p from (select doc_id, text from documents)) where true""".replace("p + 64", "p + 65"),
)
def str20(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.lit("ention"), F.col("text")).alias("snippet"))


@query("str23_code_ratio", "select page_id, round(coalesce(list_sum(list_transform(regexp_extract_all(html, '<[^>]*>'), lambda x: length(x))), 0) / length(html), 6) as ratio from pages")
def str23(spark, sf):
    total = F.aggregate(F.regexp_extract_all("html", F.lit("<[^>]*>"), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return table(spark, sf, "pages").select("page_id", F.round(total / F.length("html"), 6).alias("ratio"))


@query(
    "str25_frequent_words",
    """with w as (select doc_id, lower(word) as word, i from (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as i from (select doc_id, regexp_extract_all(text, '[a-zA-Z]{3,}') as l from documents)))
, c as (select doc_id, word, count(*) as n, min(i) as first from w where word not in ('the', 'and', 'for', 'that', 'with', 'this', 'are', 'was', 'from') group by all)
select doc_id, word, n, rank from (select doc_id, word, n, row_number() over (partition by doc_id order by n desc, first) as rank from c) where rank <= 10""",
)
def str25(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), F.lit(0))).alias("i", "word"))
    stop = ["the", "and", "for", "that", "with", "this", "are", "was", "from"]
    c = d.withColumn("word", F.lower("word")).where(~F.col("word").isin(stop)).groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "first")
    return c.withColumn("rank", F.row_number().over(w)).where("rank <= 10").select("doc_id", "word", "n", "rank")


@query(
    "str27_enrichment",
    """select doc_id, case when len(k) > 0 then array_to_string(k[:7], ', ') || ' | ' || source || ', ' || lang || chr(10) || chr(10) || text else source || ', ' || lang || chr(10) || chr(10) || text end as enriched
from (select doc_id, source, lang, text, list_distinct_in_order as k from (select *, list_filter(l, lambda x, i: list_position(l, x) = i) as list_distinct_in_order from (select *, regexp_extract_all(text, '[A-Z][a-z]{5,}') as l from documents)))""",
)
def str27(spark, sf):
    keywords = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{5,}"), F.lit(0)))
    label = lambda n: F.struct(F.lit(n).alias("label"), F.array(F.col(n)).alias("texts"))
    return table(spark, sf, "documents").select("doc_id", X.enriched(F.col("text"), keywords, F.array(label("source"), label("lang"))).alias("enriched"))


_EXP = X.EXPANSIONS
#: Some of the queries ask for what the dictionary knows.
EXPANDABLE = "text || case item_id % 4 when 0 then ' tokens of the Database Stack' when 1 then ' HPA and autoscalers' when 2 then ' monitoring' else '' end"


def expandable(spark, sf) -> DataFrame:
    more = F.when(F.col("item_id") % 4 == 0, " tokens of the Database Stack").when(F.col("item_id") % 4 == 1, " HPA and autoscalers").when(F.col("item_id") % 4 == 2, " monitoring").otherwise("")
    return table(spark, sf, "benchmark").select("item_id", F.concat("text", more).alias("text"))


@query(
    "str28_expansion",
    f"""with e as (select * from (values {', '.join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(_EXP.items()))}) e(i, k, v)),
q as (select item_id, {EXPANDABLE} as text from benchmark), h as (select item_id, text, i, k, v from q join e on contains(lower(text), k)),
t as (select distinct item_id, text, unnest(string_split(v, ' ')) as t from h)
select b.item_id, coalesce((select string_agg(k, ',' order by i) from h where h.item_id = b.item_id), '') as keys,
b.text || coalesce((select ' ' || coalesce(string_agg(t, ' ' order by encode(t)) filter (not list_contains({TOKENS.replace('text', 't.text')}, lower(t))), '') from t where t.item_id = b.item_id having count(*) > 0), '') as expanded from q b""",
)
def str28(spark, sf):
    keys, text = X.expansions(F.col("text"))
    return expandable(spark, sf).select("item_id", F.array_join(keys, ",").alias("keys"), text.alias("expanded"))


_USER = "conversations where role = 'user'"


def _users(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'")


@query(
    "str29_technical_score",
    f"""select conv_id, turn, round(least(least(({' + '.join(f"regexp_matches({_PLAIN if '(?U)' in p else 'text'}, {quoted(p.replace('(?U)', ''))})::int" for p in X.TECHNICAL_PATTERNS)}) * 0.1::double, 0.5) + least(({' + '.join(f"contains(lower(text), {quoted(k)})::int" for k in X.TECHNICAL_KEYWORDS)}) * 0.1::double, 0.5), 1.0), 6) as score from {_USER}""",
)
def str29(spark, sf):
    return _users(spark, sf).select("conv_id", "turn", F.round(X.technical_score(F.col("text")), 6).alias("score"))


@query("str30_negation", f"""select conv_id, turn, array_to_string(list_filter([{', '.join(f"case when regexp_matches(lower(text), {quoted('|'.join(p))}) then {quoted(n)} end" for n, p in X.NEGATIONS.items())}], lambda x: x is not null), ',') as types from {_USER}""")
def str30(spark, sf):
    return _users(spark, sf).select("conv_id", "turn", F.array_join(X.negation_types(F.col("text")), ",").alias("types"))


@query("str32_query_type", f"""select conv_id, turn, case {' '.join(f"when regexp_matches(lower(text), {quoted('|'.join(k))}) then {quoted(n)}" for n, k in X.QUERY_TYPES.items())} else 'implicit' end as query_type from {_USER}""")
def str32(spark, sf):
    return _users(spark, sf).select("conv_id", "turn", X.query_type(F.col("text")).alias("query_type"))


@query(
    "str34_signals",
    """select doc_id, round(avg(length(term)), 6) as avg_term_length, round(100.0 * count(*) / max(n_words), 6) as entity_density, round(avg(case when length(term) >= 2 and (regexp_matches(term, '^[a-z]+[A-Z][a-zA-Z]*$') or regexp_matches(term, '^[A-Z][a-z]+[A-Z][a-zA-Z]*$')) then 1.0 else 0.0 end), 6) as technical_ratio
from (select doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z]{4,}'))) as term, len(list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')) as n_words from documents) group by doc_id""",
)
def str34(spark, sf):
    terms = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)))
    d = table(spark, sf, "documents").select("doc_id", terms.alias("terms"), F.size(X.words(F.col("text"))).alias("n_words"))
    d = d.repartition("doc_id").select("doc_id", "n_words", F.explode("terms").alias("term"))
    shape = F.col("term").rlike("^[a-z]+[A-Z][a-zA-Z]*$|^[A-Z][a-z]+[A-Z][a-zA-Z]*$")
    return d.groupBy("doc_id").agg(F.round(F.avg(F.length("term")), 6).alias("avg_term_length"), F.round(100.0 * F.count("*") / F.max("n_words"), 6).alias("entity_density"), F.round(F.avg(F.when(shape, 1.0).otherwise(0.0)), 6).alias("technical_ratio"))


@query(
    "str35_shingle_jaccard",
    """with g as (select item_id, list_distinct(list_transform(range(1, length(text) - 11), lambda i: substr(text, i, 13))) as g from benchmark)
select a.item_id as a, b.item_id as b, round(coalesce(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0), 6) as jaccard from g a join g b on b.item_id = a.item_id + 1""",
)
def str35(spark, sf):
    b = table(spark, sf, "benchmark")
    other = b.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("b"), F.col("text").alias("other"))
    return b.join(other, "item_id").select(F.col("item_id").alias("a"), "b", F.round(X.shingle_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


@query("str38_content_hash", "select doc_id, substr(sha256(text), 1, 12) as content_hash from documents")
def str38(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("content_hash"))


@query("str39_url_parts", "select page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') as path, nullif(regexp_extract(url, '#(.*)$', 1), '') as fragment from pages")
def str39(spark, sf):
    path, fragment = X.normalize_url(F.col("url"))
    return table(spark, sf, "pages").select("page_id", path.alias("path"), fragment.alias("fragment"))


@query("sbt8_heading_slugs", "select page_id, regexp_replace(regexp_replace(trim(lower(h)), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g') as slug from (select page_id, unnest(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)) as h from pages)")
def sbt8(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h1>([^<]*)</h1>"), F.lit(1))).alias("h"))
    return h.select("page_id", X.slug(F.col("h")).alias("slug"))


@query("sbt1_normalize_answer", "select page_id, md5(lower(trim(regexp_replace(replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')))) as digest from pages")
def sbt1(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(X.normalize_answer(F.col("html"))).alias("digest"))


@query("src5_scan_in_order", "select row_number() over (order by doc_id) as pos, doc_id from documents")
def src5(spark, sf):
    """Positions come from counts of id ranges, added up, and numbers within a range: no global sort in one task."""
    from corpuslode.operators.order import with_position

    return with_position(table(spark, sf, "documents").select("doc_id"), "doc_id", "pos").select("pos", "doc_id")


@query("src6_point_lookup", "select doc_id, text, source from documents where doc_id = 17")
def src6(spark, sf):
    return table(spark, sf, "documents").where("doc_id = 17").select("doc_id", "text", "source")


@query("src7_turns_of_a_conversation", "select conv_id, turn, role, row_number() over (partition by conv_id order by turn, role desc) as pos from conversations")
def src7(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", F.desc("role"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.row_number().over(w).alias("pos"))


@query("src8_counts", "select 'documents' as name, count(*) as n from documents union all select 'pages', count(*) from pages")
def src8(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("documents").unionByName(one("pages"))


_LINE = "'[' || user_id || '] stage=' || event_type || ' | value ' || value"


@query("src11_trace_lines", "select user_id::varchar as request_id, event_type as stage, 'value ' || event_id as message, row_number() over (partition by user_id order by event_id) as seq from events")
def src11(spark, sf):
    """Log lines `[request] stage=S | message`, built of events, parsed and numbered per request."""
    from corpuslode.sources.readers import parse_trace

    line = F.concat(F.lit("["), F.col("user_id"), F.lit("] stage="), F.col("event_type"), F.lit(" | value "), F.col("event_id"))
    return parse_trace(table(spark, sf, "events").select(line.alias("value"), F.col("event_id").alias("line")))


@query("snk1_upsert", "select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source from documents union all select doc_id + 1000000, 'new' from documents where doc_id % 10 = 0")
def snk1(spark, sf):
    from corpuslode.sources.tables import upsert

    d = table(spark, sf, "documents").select("doc_id", "source")
    changed = d.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("source"))
    added = d.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("source"))
    return upsert(d, changed.unionByName(added), ["doc_id"])


@query("snk3_delete_by_hash", "select doc_id from documents where ('doc_' || substr(sha256(text), 1, 12)) not in (select 'doc_' || substr(sha256(text), 1, 12) from documents where doc_id < 5)")
def snk3(spark, sf):
    from corpuslode.sources.tables import delete_by_hash

    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("doc_"), F.substring(F.sha2("text", 256), 1, 12)).alias("id"))
    return delete_by_hash(d, d.where("doc_id < 5").select(F.substring("id", 5, 12).alias("hash")), "id").select("doc_id")


@query("stm9_latest_of_a_hash", "select content_hash, max(doc_id) as doc_id from (select sha256(text) as content_hash, doc_id from documents) group by content_hash")
def stm9(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.max("doc_id").alias("doc_id"))
