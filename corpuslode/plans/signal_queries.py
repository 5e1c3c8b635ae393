"""Queries of answers' signals, of what tells systems apart, and of further metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.functions import answers as A
from corpuslode.functions import text as X
from corpuslode.operators import evaluate as M
from corpuslode.operators import judgement as J
from corpuslode.operators import keywords as K
from corpuslode.operators import rollup as R
from corpuslode.operators import similar as SIM
from corpuslode.operators import search as S
from corpuslode.plans.registry import query, table
from corpuslode.plans.search_queries import COSINE, DOT, VOTES, _votes, vector_queries, vectors
from corpuslode.plans.text_queries import quoted

UNESCAPED = "replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')"
NORMAL = f"lower(trim(regexp_replace({UNESCAPED}, '\\s+', ' ', 'g')))"


def _html_sql(kind: str, source: str) -> str:
    pattern, plain = A.HTML_TEXTS[kind]
    inner = f"where not regexp_matches(x, '{A.INNER}')" if plain else ""
    return f"select page_id, '{kind}' as kind, trim({UNESCAPED.format(chr(39).join(['regexp_replace(x, ', '<[^>]*>', ', ', '', ', ', 'g', ')']))}) as text from (select page_id, unnest(regexp_extract_all(html, {quoted(pattern)}, 1)) as x from {source}) {inner}"


HTML = "select * from (" + " union all ".join(_html_sql(k, "pages") for k in A.HTML_TEXTS) + ") where text <> ''"


@query("sbt2_html_texts", HTML)
def sbt2(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(A.html_texts(F.col("html"))).alias("x")).select("page_id", "x.*")


@query("sbt3_generic_texts", f"select text, lower(trim(text)) in ({', '.join(map(quoted, A.GENERIC))}) as generic from (select distinct {UNESCAPED.format('text')} as text from (select unnest([text, '{A.GENERIC[0].upper()}']) as text from benchmark))")
def sbt3(spark, sf):
    b = table(spark, sf, "benchmark").select(F.explode(F.array("text", F.lit(A.GENERIC[0].upper()))).alias("text"))
    return b.select(A.unescaped(F.col("text")).alias("text")).distinct().select("text", A.is_generic(F.col("text")).alias("generic"))


#: A page's answer is its HTML, its chunk the same page's text without tags, of even pages.
PAIRS = "pr as (select page_id, html, case when page_id % 2 = 0 then 'In  short: ' || regexp_replace(html, '<[^>]*>', ' ', 'g') else html end as content from pages)"


def _pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", "html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("In  short: "), F.regexp_replace("html", "<[^>]*>", " "))).otherwise(F.col("html")).alias("content"))


@query("sbt4_quote_matches", f"with {PAIRS}, q as ({HTML}), n as (select page_id, kind, {NORMAL.format('text')} as text from q) select page_id, kind, n.text, length(n.text)::int as length from n join pr using (page_id) where length(n.text) >= 30 and contains({NORMAL.format('content')}, n.text)")
def sbt4(spark, sf):
    found = _pairs(spark, sf).select("page_id", F.explode(A.quote_matches(F.col("html"), F.col("content"))).alias("x"))
    return found.select("page_id", "x.kind", "x.text", F.col("x.length").cast("int").alias("length"))


_W = "regexp_extract_all(regexp_replace(lower({}), '[^\\x00-\\x7F]', '0', 'g'), '\\w+')"
_TEXT = "' ' || array_to_string({}, ' ') || ' '"


@query(
    "sbt5_reciprocal_matches",
    f"""with x as (select page_id, {_W.format("regexp_replace(html, '<[^>]*>', ' ', 'g')")} as a, {_W.format("case when page_id % 2 = 0 then regexp_replace(substr(html, length(html) // 2 + 1), '<[^>]*>', ' ', 'g') else html || ' and more' end")} as c from pages)
select page_id, case when len(c) >= 20 and contains({_TEXT.format('a')}, {_TEXT.format('c')}) then 'chunk_in_answer' when len(a) >= 20 and contains({_TEXT.format('c')}, {_TEXT.format('a')}) then 'answer_in_chunk' end as direction, case when direction = 'chunk_in_answer' then len(c) when direction = 'answer_in_chunk' then len(a) end as words from x""",
)
def sbt5(spark, sf):
    plain = F.regexp_replace(F.lower("html"), r"[^\x00-\x7F]", "0")
    d = table(spark, sf, "pages").select("page_id", plain.alias("html"))
    content = F.when(F.col("page_id") % 2 == 0, F.regexp_replace(F.expr("substring(html, cast(length(html) / 2 as int) + 1)"), "<[^>]*>", " ")).otherwise(F.concat("html", F.lit(" and more")))
    direction, n = A.reciprocal_match(F.col("html"), content)
    return d.select("page_id", direction.alias("direction"), n.cast("long").alias("words"))


_ANCHOR = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({}, '^#', '')), '[_\\s]', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("sbt6_anchors", f"select distinct {_ANCHOR.format('x')} as anchor from (select unnest(['#' || regexp_extract(html, '<title>(.*?)</title>', 1), nullif(regexp_extract(url, '#(.*)$', 1), '')]) as x from pages) where x is not null")
def sbt6(spark, sf):
    title = F.concat(F.lit("#"), F.regexp_extract("html", "<title>(.*?)</title>", 1))
    x = table(spark, sf, "pages").select(F.explode(F.array(title, F.nullif(F.regexp_extract("url", "#(.*)$", 1), F.lit("")))).alias("x")).where("x is not null")
    return x.select(A.anchor(F.col("x")).alias("anchor")).distinct()


_TRUST = "select event_id, event_id % 11 = 0 as fragment, case when event_id % 5 = 0 then (event_id % 70)::int end as quote, case when event_id % 7 = 0 then (event_id % 45)::int end as reciprocal, event_id % 13 <> 0 as url, floor(value / 4)::int as upvotes, event_type = 'view' as accepted, (user_id % 5)::int as same_url from events"


@query(
    "sbt7_trust_tiers",
    f"""select event_id, case when gold1 or gold2 or gold3 then 'gold' when s1 or s2 then 'silver' when b1 then 'bronze' else 'exclude' end as tier,
case when gold1 then 'fragment_anchor_match' when gold2 then 'quote_match_' || quote || '_chars' when gold3 then 'reciprocal_containment_' || reciprocal || '_words' when s1 then 'url_high_trust' when s2 then 'url_corroborated' when b1 then 'url_community_validated' else 'insufficient_signal' end as reason,
round(case when gold1 then 1.0 when gold2 then (case when quote > 50 then 1.0 else 0.9 end) when gold3 then least(1.0, 0.85 + 0.005 * (reciprocal - 20)) when s1 then (case when accepted and upvotes >= 15 then 0.85 else 0.75 end) when s2 then 0.7 when b1 then least(0.75, 0.6 + 0.01 * (upvotes - 5)) else 0.0 end::double, 6) as confidence,
array_to_string(list_filter([case when gold1 then 'fragment_anchor_match' end, case when gold2 then 'quote_match' end, case when gold3 then 'reciprocal_containment' end, case when s1 then 'url_high_trust' end, case when s2 then 'url_corroborated' end, case when b1 then 'url_community_validated' end], lambda x: x is not null), ',') as signals
from (select *, fragment as gold1, coalesce(quote >= 30, false) as gold2, coalesce(reciprocal >= 20, false) as gold3, url and ((accepted and upvotes >= 10) or upvotes >= 25) as s1, url and same_url >= 3 and upvotes >= 5 as s2, url and upvotes >= 5 as b1 from ({_TRUST}))""",
)
def sbt7(spark, sf):
    e = table(spark, sf, "events")
    i, pick = F.col("event_id"), lambda m, n: F.when(F.col("event_id") % m == 0, (F.col("event_id") % n).cast("int"))
    t = A.trust(i % 11 == 0, pick(5, 70), pick(7, 45), i % 13 != 0, F.floor(F.col("value") / 4).cast("int"), F.col("event_type") == "view", (F.col("user_id") % 5).cast("int"))
    return e.select("event_id", t.alias("t")).select("event_id", "t.tier", "t.reason", "t.confidence", F.array_join("t.signals", ",").alias("signals"))


_PATH = "case when p = '/' then '/' else regexp_replace(p, '/+$', '') end"
_SLUG = "regexp_replace(regexp_replace(trim(regexp_replace(lower({}), '[^a-z0-9\\s-]', '', 'g')), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("sbt8_url_mappings", f"select path, list(distinct page_id order by page_id) as docs, count(*) as n, min(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) as first_heading from (select page_id, html, {_PATH} as path from (select *, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as p from pages)) group by path")
def sbt8b(spark, sf):
    """url to documents; urls without a scheme have an empty path: the unmapped ones."""
    return table(spark, sf, "pages").groupBy(A.url_path(F.col("url")).alias("path")).agg(F.sort_array(F.collect_set("page_id")).alias("docs"), F.count("*").alias("n"), F.min(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)).alias("first_heading"))


@query("sbt8_anchor_mappings", f"select {_SLUG.format('h')} as anchor, list(distinct page_id order by page_id) as docs from (select page_id, unnest(regexp_extract_all(html, '<h[1-6]>([^<]*)</h[1-6]>', 1)) as h from pages) group by anchor")
def sbt8c(spark, sf):
    h = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<h[1-6]>([^<]*)</h[1-6]>"), F.lit(1))).alias("h"))
    return h.groupBy(A.heading_slug(F.col("h")).alias("anchor")).agg(F.sort_array(F.collect_set("page_id")).alias("docs"))


@query("sbt9_corpus_version", "select lang, sha256(string_agg(sha256(doc_id::varchar || ':' || text), '' order by sha256(doc_id::varchar || ':' || text))) as version from documents group by lang")
def sbt9(spark, sf):
    """A hash of a group's chunks that their order doesn't change: of the sorted hashes, 64 characters a chunk."""
    one = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "text"), 256)
    return table(spark, sf, "documents").groupBy("lang").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(one)), ""), 256).alias("version"))


@query(
    "sbt10_generated_cases",
    """select item_id, tier, case when len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) < 6 then 'query too short' when not contains(trim(regexp_replace(text, '\\s+', ' ', 'g')), trim(regexp_replace(quote, '\\s+', ' ', 'g'))) then 'quote not found verbatim'
when tier = 'gold' and length(quote) < 30 then 'gold quote too short' end as problem from (select item_id, text, case when item_id % 3 = 0 then 'Too short' else left(text, 60) end as q, case when item_id % 2 = 0 then 'gold' else 'silver' end as tier, case when item_id % 5 = 1 then 'nowhere in it' else substr(text, 5, (item_id % 50)::int) end as quote from benchmark)""",
)
def sbt10(spark, sf):
    i = F.col("item_id")
    q = F.when(i % 3 == 0, "Too short").otherwise(F.substring("text", 1, 60))
    tier = F.when(i % 2 == 0, "gold").otherwise("silver")
    quote = F.when(i % 5 == 1, "nowhere in it").otherwise(F.substring(F.col("text"), F.lit(5), (i % 50).cast("int")))
    return table(spark, sf, "benchmark").select("item_id", tier.alias("tier"), A.case_problem(q, quote, tier, F.col("text")).alias("problem"))


REL = "rel as (select a.vec_id as query_id, b.vec_id as chunk_id from embeddings a join embeddings b on b.vec_id // 25 = a.vec_id // 25 where a.vec_id % 100 = 0)"


def near_ids(spark, sf) -> DataFrame:
    """Relevant to a query: the vectors of its own section of 25."""
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.floor(F.col("vec_id") / 25).alias("s"))
    return e.select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 25).alias("s")).join(q, "s").select("query_id", "chunk_id")


@query(
    "sbt12_per_query_metrics",
    f"""with {DOT}, {REL}, h as (select rel.query_id, min(rank) as first, count(rank) as found, sum(1 / log2(rank + 1)) as dcg, count(*) as n from rel left join dense using (query_id, chunk_id) group by all)
select query_id, coalesce(first <= 1, false) as hit_1, coalesce(first <= 5, false) as hit_5, first as first_rank, round(coalesce(1 / first, 0), 6) as rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))), 6) as ndcg from h""",
)
def sbt12(spark, sf):
    found, rel = S.dense(vectors(spark, sf), vector_queries(spark, sf), 10), near_ids(spark, sf)
    r = F.col("rank")
    first = M.first_hit(found, rel).select("query_id", F.coalesce(r <= 1, F.lit(False)).alias("hit_1"), F.coalesce(r <= 5, F.lit(False)).alias("hit_5"), r.alias("first_rank"), F.round(F.coalesce(1 / r, F.lit(0.0)), 6).alias("rr"))
    return first.join(M.ndcg(found, rel, 10), "query_id")


TWO = f"{DOT.replace('<= 10', '<= 50')}, {COSINE.replace('v as', 'v2 as').replace('sc as', 'sc2 as').replace('dense as', 'other as').replace('from v a, v b', 'from v2 a, v2 b').replace('from sc ', 'from sc2 ').replace('<= 10', '<= 50')}"


@query(
    "sbt13_complementarity",
    f"""with {TWO}, {REL}, j as (select query_id, chunk_id, a.rank as ra, b.rank as rb, rel.chunk_id is not null as good from dense a full join other b using (query_id, chunk_id) left join rel using (query_id, chunk_id)),
q as (select query_id, count(*) filter (ra <= 10 and rb <= 10) as s10, count(*) filter (ra <= 10 or rb <= 10) as e10, count(*) filter (ra <= 50 and rb <= 50) as s50, count(*) filter (ra <= 50 or rb <= 50) as e50, (count(*) filter (good and ra <= 10) > 0)::int as ha, (count(*) filter (good and rb <= 10) > 0)::int as hb from j group by query_id)
select round(sum(s10) / sum(e10), 6) as overlap_at_10, round(sum(s50) / sum(e50), 6) as overlap_at_50, count(*) filter (ha = 1 and hb = 0) as unique_a, count(*) filter (ha = 0 and hb = 1) as unique_b, round(coalesce(covar_pop(ha, hb) / nullif(stddev_pop(ha) * stddev_pop(hb), 0), 0), 6) as error_correlation, round((sum(greatest(ha, hb)) - greatest(sum(ha), sum(hb))) / count(*), 6) as fusion_potential from q""",
)
def sbt13(spark, sf):
    q, v = vector_queries(spark, sf), vectors(spark, sf)
    return J.complementarity(S.dense(v, q, 50), S.dense(v, q, 50, cosine=True), near_ids(spark, sf))


@query(
    "sbt13_cascade",
    f"""with {TWO}, {REL}, n as (select query_id, count(*) as n from rel group by all), st as (select 1 as place, 'dot' as stage, avg(coalesce(f, 0) / n) as recall, avg(coalesce(1 / r, 0)) as mrr from n left join (select query_id, count(*) as f, min(rank) as r from dense join rel using (query_id, chunk_id) group by all) using (query_id)
union all select 2, 'cosine', avg(coalesce(f, 0) / n), avg(coalesce(1 / r, 0)) from n left join (select query_id, count(*) as f, min(rank) as r from other join rel using (query_id, chunk_id) where rank <= 10 group by all) using (query_id))
select stage, round(recall, 6) as recall, round(mrr, 6) as mrr, round(mrr - coalesce(lag(mrr) over (order by place), 0), 6) as gain from st""",
)
def sbt13b(spark, sf):
    q, v = vector_queries(spark, sf), vectors(spark, sf)
    return J.cascade({"dot": (S.dense(v, q, 50), 50), "cosine": (S.dense(v, q, 50, cosine=True), 10)}, near_ids(spark, sf))


@query("met4_recall_at_k", f"with {DOT}, {REL}, n as (select query_id, count(*) as n from rel group by all), h as (select query_id, rank from dense join rel using (query_id, chunk_id)) select k, round(avg(f / n), 6) as recall, round(avg((f > 0)::int) * 100, 4) as hit_percent from (select k, query_id, n, (select count(*) from h where h.query_id = n.query_id and rank <= k) as f from n, (values (1), (3), (5), (10)) k(k)) group by k")
def met4b(spark, sf):
    found = S.dense(vectors(spark, sf), vector_queries(spark, sf), 10).join(near_ids(spark, sf), ["query_id", "chunk_id"])
    rel = near_ids(spark, sf).groupBy("query_id").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.array(*map(F.lit, M.KS))))
    hit = found.withColumn("k", F.explode(F.array(*map(F.lit, M.KS)))).where("rank <= k").groupBy("query_id", "k").agg(F.count("*").alias("f"))
    f = F.coalesce("f", F.lit(0))
    return rel.join(hit, ["query_id", "k"], "left").groupBy("k").agg(F.round(F.avg(f / F.col("n")), 6).alias("recall"), F.round(F.avg((f > 0).cast("int")) * 100, 4).alias("hit_percent"))


@query("met4_rank_delta", f"with {TWO} select query_id, chunk_id, b.rank - a.rank as delta from dense a join other b using (query_id, chunk_id)")
def met4c(spark, sf):
    q, v = vector_queries(spark, sf), vectors(spark, sf)
    a, b = S.dense(v, q, 50), S.dense(v, q, 50, cosine=True)
    return a.select("query_id", "chunk_id", F.col("rank").alias("ra")).join(b, ["query_id", "chunk_id"]).select("query_id", "chunk_id", (F.col("rank") - F.col("ra")).alias("delta"))


@query("met2_best", "select event_id, rank from (select event_id, case when event_id % 4 <> 0 then event_id % 12 + 1 end as rank from events) where rank is not null order by rank, event_id limit 20")
def met2b(spark, sf):
    r = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 12 + 1)
    return table(spark, sf, "events").select("event_id", r.alias("rank")).where("rank is not null").orderBy("rank", "event_id").limit(20)


@query("met8_fact_coverage", "with f as (select conv_id, list_distinct(list_transform(string_split_regex(text, '[.\\n]'), lambda x: trim(x))) as facts from conversations where role = 'user' and turn = 0), t as (select conv_id, lower(string_agg(text, chr(10) order by turn)) as body from conversations where turn > 0 group by all), j as (select f.conv_id, list_filter(facts, lambda x: x <> '') as facts, coalesce(body, '') as body from f left join t using (conv_id)) select conv_id, len(facts) as n_facts, len(list_filter(facts, lambda x: contains(body, lower(x)))) as n_found, round(case when len(facts) = 0 then 1 else len(list_filter(facts, lambda x: contains(body, lower(x)))) / len(facts) end, 6) as coverage from j")
def met8(spark, sf):
    """Facts: the sentences of the first turn; the text: what comes after it."""
    c = table(spark, sf, "conversations")
    facts = F.filter(F.array_distinct(F.transform(F.split("text", r"[.\n]"), lambda x: F.trim(x))), lambda x: x != "")
    f = c.where("role = 'user' and turn = 0").select("conv_id", facts.alias("facts"))
    body = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]), "\n"))
    j = f.join(c.where("turn > 0").groupBy("conv_id").agg(body.alias("body")), "conv_id", "left").withColumn("body", F.coalesce("body", F.lit("")))
    n, found = F.size("facts"), F.size(F.filter("facts", lambda x: F.contains(F.col("body"), F.lower(x))))
    return j.select("conv_id", n.cast("long").alias("n_facts"), found.cast("long").alias("n_found"), F.round(F.when(n == 0, 1.0).otherwise(found / n), 6).alias("coverage"))


@query("met8_document_metrics", f"with {DOT}, d as (select query_id, chunk_id // 25 as doc_id, min(rank) as rank from dense group by all), e as (select vec_id as query_id, unnest([vec_id // 25, vec_id // 25 + 1]) as doc_id from embeddings where vec_id % 100 = 0) select query_id, round(count(*) filter (rank <= 5) / count(*), 6) as recall, round(coalesce(1 / min(rank), 0), 6) as mrr from e left join d using (query_id, doc_id) group by query_id")
def met8b(spark, sf):
    hits = S.dense(vectors(spark, sf), vector_queries(spark, sf), 10).groupBy("query_id", F.floor(F.col("chunk_id") / 25).alias("doc_id")).agg(F.min("rank").alias("rank"))
    s = F.floor(F.col("query_id") / 25)
    e = vector_queries(spark, sf).select("query_id", F.explode(F.array(s, s + 1)).alias("doc_id"))
    return e.join(hits, ["query_id", "doc_id"], "left").groupBy("query_id").agg(F.round(F.count(F.when(F.col("rank") <= 5, 1)) / F.count("*"), 6).alias("recall"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"))


@query("met10_rouge_l")
def met10(spark, sf):
    """Each answer against the turn before it: a longest common subsequence, which SQL can't express."""
    c = table(spark, sf, "conversations")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("reference"))
    return c.join(before, ["conv_id", "turn"]).select("conv_id", "turn", M.rouge_l_scores(F.col("reference"), F.col("text")).alias("rouge_l"))


@query("met13_term_scores")
def met13(spark, sf):
    """Words of the first turn against those of the others, one to one with the largest total likeness."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{9,}"), F.lit(0))).alias("term"))
    return M.term_scores(c.where("turn = 1").select("doc_id", "term"), c.where("turn = 0").select("doc_id", "term"), "best")


@query("str13_fuzzy_terms")
def str13(spark, sf):
    """The terms of each first turn that those of the second name too; all terms of both, which share a rare part."""
    term = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)))).alias("term")
    c = table(spark, sf, "conversations")
    return SIM.fuzzy(c.where("turn = 0").select("conv_id", term), c.where("turn = 1").select("conv_id", term), ["conv_id"])


@query("str13_vocabularies")
def str13b(spark, sf):
    """Words of the benchmark's texts and of the conversations that are 85 alike: a similarity join of two vocabularies."""
    term = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), F.lit(0)))).alias("term")
    own = lambda name: table(spark, sf, name).select(term).distinct()
    return SIM.similar(own("benchmark"), own("conversations"))


@query("str24_yake")
def str24b(spark, sf):
    """The ten keywords of up to two words of every whole document by its own statistics."""
    return K.extracted(table(spark, sf, "documents"))


@query("met5_sign_flip")
def met5(spark, sf):
    e = table(spark, sf, "events").where("event_type in ('view', 'error')")
    d = e.select("event_id", (F.col("value") * F.when(F.col("event_type") == "view", 1).otherwise(-1)).alias("d"))
    return M.sign_flip(d, "d", 2000)


@query("met14_confusion", "select event_type as \"group\", count(*) filter (t and p) as tp, count(*) filter (not t and p) as fp, count(*) filter (t and not p) as fn, count(*) filter (not t and not p) as tn, round(coalesce(count(*) filter (t and p) / nullif(count(*) filter (p), 0), 0), 6) as precision, round(coalesce(count(*) filter (t and p) / nullif(count(*) filter (t), 0), 0), 6) as recall from (select event_type, value < 50 as t, event_id % 3 = 0 as p from events) group by event_type")
def met14b(spark, sf):
    """Poor results (truth) against those sent the slow way: recall of the poor, and the confusion."""
    e = table(spark, sf, "events").select("event_type", (F.col("value") < 50).alias("t"), (F.col("event_id") % 3 == 0).alias("p"))
    return J.confusion(e, "t", "p", F.col("event_type"))


_RANKS = "select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2 as ra, rank() over (partition by event_type order by user_id) + (count(*) over (partition by event_type, user_id) - 1) / 2 as rb, event_id % 2 as y from events"


@query("met15_spearman", f"select event_type, round(coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0), 6) as rho from ({_RANKS}) group by event_type")
def met15(spark, sf):
    return J.spearman(table(spark, sf, "events"), "value", "user_id", "event_type")


@query("met15_auc", f"select event_type, round((sum(ra * y) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) as auc from ({_RANKS}) group by event_type")
def met15b(spark, sf):
    return J.auc(table(spark, sf, "events").withColumn("y", F.col("event_id") % 2), "value", "y", "event_type")


@query("exp2_unanimity", f"select doc_id, lower(term) as key, arg_min(term, (source, term)) as term, count(distinct source) as n from ({VOTES}) group by doc_id, lower(term) having n >= 3")
def exp2(spark, sf):
    return R.votes(_votes(spark, sf), ["doc_id"], 3)


@query("exp4_fuzzy_spans")
def exp4(spark, sf):
    """Every pair of neighbouring words in capitals of the first turn, found or not in the whole second turn."""
    c = table(spark, sf, "conversations")
    term = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+ [A-Za-z]+"), F.lit(0)))).alias("term")
    return SIM.spans_like(c.where("turn = 0").select("conv_id", term), c.where("turn = 1").select("conv_id", "text"), ["conv_id"])


@query("str37_smart_dedup", "select doc_id, term from (select doc_id, term, row_number() over (partition by doc_id, case when k like '%ies' and length(k) > 4 then k[:-4] || 'y' when k like '%es' and length(k) > 4 then k[:-3] when k like '%s' and length(k) > 3 then k[:-2] else k end order by length(term), term) as n from (select distinct conv_id as doc_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) as term, translate(trim(lower(term)), '-_', '  ') as k from conversations)) where n = 1")
def str37(spark, sf):
    """Of a document's plurals and casings the shortest form stays."""
    from pyspark.sql import Window

    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("term")).distinct()
    w = Window.partitionBy("doc_id", X.depluralize(X.normalize_term(F.col("term")))).orderBy(F.length("term"), "term")
    return t.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "term")


@query(
    "str24_keywords",
    """with w as (select doc_id, lower(w) as k, w, i from (select doc_id, l[i] as w, i from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, regexp_extract_all(text, '[A-Za-z]{4,}') as l from documents)))),
s as (select doc_id, k, round(count(*) * (1 + count(*) filter (regexp_matches(w, '^[A-Z]')) / count(*)) / ln(3 + min(i)), 6) as score from w group by all)
select doc_id, k as keyword, score, rank from (select *, row_number() over (partition by doc_id order by score desc, k) as rank from s) where rank <= 10""",
)
def str24(spark, sf):
    return R.keywords(table(spark, sf, "documents").select("doc_id", "text"), 10)
