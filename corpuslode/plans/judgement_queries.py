"""Queries of question classifiers, graded results and checks of generated cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.functions import complexity as C
from corpuslode.functions import text as X
from corpuslode.operators import search as S
from corpuslode.operators.headings import with_parents
from corpuslode.plans.registry import query, table
from corpuslode.plans.search_queries import DOT, K, _relevant, _results, vector_queries, vectors
from corpuslode.plans.search_queries import RESULTS as _R
from corpuslode.plans.text_queries import quoted

_COMPLEX = " ".join(f"when regexp_matches(q, {quoted('|'.join(p))}) then '{n}'" for n, p in C.FAMILIES)
COMPLEXITY = f"""(select conv_id, turn, text, case {_COMPLEX} when len(list_filter(string_split_regex(q, '\\s+'), lambda w: w <> '')) <= {C.SHORT} then 'simple' else 'complex' end as complexity
from (select conv_id, turn, text, trim(lower(text)) as q from conversations where role = 'user'))"""


def _asked(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", "text", C.query_complexity(F.col("text")).alias("complexity"))


@query("str33_query_complexity", f"select conv_id, turn, complexity from {COMPLEXITY}")
def str33(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", "complexity")


_HELD = lambda words: " + ".join(f"contains(lower(text), {quoted(w)})::int" for w in words)


@query("str31_negation_rescoring", f"select doc_id, ({_HELD(C.WARNINGS)}) * 2.0::double - ({_HELD(C.POSITIVE)}) * 0.5::double as score from documents")
def str31(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.negation_score(F.col("text")).alias("score"))


@query("met20_classifier_accuracy", f"select expected, count(*) as n, round(avg((complexity = expected)::int), 6) as accuracy from (select complexity, case when contains(text, '?') then 'simple' else 'complex' end as expected from {COMPLEXITY}) group by expected")
def met20(spark, sf):
    """Against a given class: here whether a user's turn has a question mark."""
    a = _asked(spark, sf).withColumn("expected", F.when(F.contains("text", F.lit("?")), "simple").otherwise("complex"))
    return a.groupBy("expected").agg(F.count("*").alias("n"), F.round(F.avg((F.col("complexity") == F.col("expected")).cast("int")), 6).alias("accuracy"))


@query("met4_rank_metrics", f"with {_R} select dataset, {', '.join(f'round(avg(case when rank <= {k} then 1.0::double / rank else 0 end), 6) as mrr_{k}, round(100 * avg(coalesce((rank <= {k})::int, 0)), 6) as hit_pct_{k}' for k in (1, 3, 5, 10))} from r group by dataset")
def met4(spark, sf):
    r = F.col("rank")
    at = [(F.round(F.avg(F.when(r <= k, 1 / r).otherwise(0.0)), 6).alias(f"mrr_{k}"), F.round(100 * F.avg(F.coalesce((r <= k).cast("int"), F.lit(0))), 6).alias(f"hit_pct_{k}")) for k in (1, 3, 5, 10)]
    return _results(spark, sf).groupBy("dataset").agg(*[c for pair in at for c in pair])


TURNS = """(select a.conv_id, a.turn, a.text as own, b.text as answer from (select *, row_number() over (partition by conv_id, turn order by role desc, text) as k from conversations) a
join (select *, row_number() over (partition by conv_id, turn order by role desc, text) as k from conversations) b on a.conv_id = b.conv_id and b.turn = a.turn + 1 and a.k = 1 and b.k = 1)"""


def _pairs(spark, sf) -> DataFrame:
    """Each turn of a conversation with the next one."""
    first = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct((-F.ascii("role")).alias("r"), "text")).alias("k"))
    first = first.select("conv_id", "turn", F.col("k.text").alias("own"))
    after = first.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("own").alias("answer"))
    return first.join(after, ["conv_id", "turn"])


_FACT = "array_to_string(list_filter(string_split_regex(own, '\\s+'), lambda w: w <> '')[:3], ' ')"


@query("met9_fact_match", f"select conv_id, turn, contains(t, f) as exact, contains(t, f) or (len(w) >= 2 and len(list_filter(w, lambda x: not contains(t, x))) = 0) as fuzzy from (select conv_id, turn, lower({_FACT}) as f, lower(answer) as t, list_filter(string_split_regex(lower({_FACT}), '\\s+'), lambda x: x <> '') as w from {TURNS})")
def met9(spark, sf):
    fact = F.array_join(F.slice(F.filter(F.split("own", r"\s+"), lambda w: w != ""), 1, 3), " ")
    exact, fuzzy = C.fact_match(fact, F.col("answer"))
    return _pairs(spark, sf).select("conv_id", "turn", exact.alias("exact"), fuzzy.alias("fuzzy"))


_SET = "list_distinct(list_filter(string_split_regex(lower({}), '\\s+'), lambda t: t <> ''))"


@query("met12_answer_jaccard", f"select conv_id, turn, round(coalesce(len(list_intersect(a, b))::double / nullif(len(list_distinct(list_concat(a, b))), 0), 0), 6) as jaccard from (select conv_id, turn, {_SET.format('own')} as a, {_SET.format('answer')} as b from {TURNS})")
def met12(spark, sf):
    a, b = F.array_distinct(X.tokens(F.col("own"))), F.array_distinct(X.tokens(F.col("answer")))
    share = F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    return _pairs(spark, sf).select("conv_id", "turn", F.round(F.coalesce(share, F.lit(0.0)), 6).alias("jaccard"))


@query("met11_run_consistency", "select user_id, count(*) as runs, count(distinct got) = 1 as consistent from (select user_id, event_id % 2 as run, list_sort(list(distinct event_type)) as got from events group by all) group by user_id")
def met11(spark, sf):
    """Whether all runs of a question retrieve the same."""
    runs = table(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 2).alias("run")).agg(F.array_sort(F.collect_set("event_type")).alias("got"))
    return runs.groupBy("user_id").agg(F.count("*").alias("runs"), (F.countDistinct("got") == 1).alias("consistent"))


RELEVANT = "rel as (select a.vec_id as query_id, b.vec_id as chunk_id from embeddings a join embeddings b on a.vec_id // 25 = b.vec_id // 25 and a.vec_id <> b.vec_id where a.vec_id % 100 = 0)"


@query("met18_precision", f"with {DOT}, {RELEVANT} select query_id, round(count(rel.chunk_id) / {K}, 6) as precision, min(case when rel.chunk_id is not null then rank end) as first_rank, round(coalesce(1 / min(case when rel.chunk_id is not null then rank end), 0), 6) as reciprocal_rank, count(*) filter (rel.chunk_id is not null and rank <= 1) > 0 as hit_1, count(*) filter (rel.chunk_id is not null and rank <= 5) > 0 as hit_5 from dense left join rel using (query_id, chunk_id) group by query_id")
def met18(spark, sf):
    """Of each query with several relevant chunks: precision, first relevant rank, its reciprocal, hits."""
    found = S.dense(vectors(spark, sf), vector_queries(spark, sf), K).join(_relevant(spark, sf).withColumn("good", F.lit(True)), ["query_id", "chunk_id"], "left")
    first = F.min(F.when(F.col("good"), F.col("rank")))
    hit = lambda k: F.coalesce(first <= k, F.lit(False)).alias(f"hit_{k}")
    return found.groupBy("query_id").agg(F.round(F.count("good") / K, 6).alias("precision"), first.alias("first_rank"), F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("reciprocal_rank"), hit(1), hit(5))


_WEIGHT = "case when rank = 1 then 1.0 when rank <= 3 then 0.95 when rank <= 5 then 0.85 else 0.6 end"


@query("met19_weighted_grades", f"with {_R} select dataset, round(avg(total), 4) as mean_total, {', '.join(f'round(100 * avg((total >= {p})::int), 6) as pass_{str(p).replace(chr(46), chr(95))}' for p in (8.0, 7.0, 6.5))} from (select dataset, round((floor(latency_ms)::bigint % 10 + 1) * {_WEIGHT}::double, 6) as total from r) group by dataset")
def met19(spark, sf):
    """Grades from 1 to 10 by the rank they were found at, and the shares that pass."""
    grade = F.floor("latency_ms").cast("long") % 10 + 1
    t = _results(spark, sf).select("dataset", F.round(grade * C.position_weight(F.col("rank")), 6).alias("total"))
    rates = [F.round(100 * F.avg((F.col("total") >= p).cast("int")), 6).alias(f"pass_{str(p).replace('.', '_')}") for p in (8.0, 7.0, 6.5)]
    return t.groupBy("dataset").agg(F.round(F.avg("total"), 4).alias("mean_total"), *rates)


@query("sbt11_case_checks", "select item_id, d.doc_id is not null as chunk_exists, coalesce(contains(lower(d.text), lower(substr(b.text, 1, 40))), false) as quote_exists, length(substr(b.text, 1, 40)) >= 30 as quote_length, len(list_filter(string_split_regex(b.text, '\\s+'), lambda w: w <> '')) > 5 as query_length from benchmark b left join documents d on d.doc_id = b.item_id * 37")
def sbt11(spark, sf):
    """Generated cases: their chunk is there, holds the quote, quote and question are long enough."""
    cases = table(spark, sf, "benchmark").select("item_id", (F.col("item_id") * 37).alias("doc_id"), F.col("text").alias("asked"), F.substring("text", 1, 40).alias("quote"))
    d = table(spark, sf, "documents").select("doc_id", "text", F.lit(True).alias("there"))
    held = F.coalesce(F.contains(F.lower("text"), F.lower("quote")), F.lit(False))
    words = F.size(F.filter(F.split("asked", r"\s+"), lambda w: w != ""))
    return cases.join(d, "doc_id", "left").select("item_id", F.coalesce("there", F.lit(False)).alias("chunk_exists"), held.alias("quote_exists"), (F.length("quote") >= 30).alias("quote_length"), (words > 5).alias("query_length"))


@query("api10_level_scores", "select event_id, round(case level when 'HIGH' then greatest(c, 0.8) when 'MEDIUM' then greatest(least(c, 0.79), 0.5) else least(c, 0.49) end, 6) as score from (select event_id, (event_id % 100) / 100.0::double as c, case event_id % 3 when 0 then 'HIGH' when 1 then 'MEDIUM' else 'LOW' end as level from events)")
def api10(spark, sf):
    third = F.col("event_id") % 3
    level = F.when(third == 0, "HIGH").when(third == 1, "MEDIUM").otherwise("LOW")
    return table(spark, sf, "events").select("event_id", F.round(C.level_score(level, (F.col("event_id") % 100) / 100.0), 6).alias("score"))


@query("agg8_document_confidence", "select user_id, round(avg((event_id % 100) / 100.0::double), 6) as avg_confidence, count(*) as total_entities, round(avg((event_id % 100) / 100.0::double), 6) < 0.7 as is_low_confidence from events group by user_id")
def agg8(spark, sf):
    mean = F.round(F.avg((F.col("event_id") % 100) / 100.0), 6)
    return table(spark, sf, "events").groupBy("user_id").agg(mean.alias("avg_confidence"), F.count("*").alias("total_entities"), (mean < 0.7).alias("is_low_confidence"))


@query("chk12_heading_parents", "with h as (select page_id, i as pos, l[i]::int as level from (select page_id, l, unnest(range(1, len(l) + 1)) as i from (select page_id, regexp_extract_all(html, '<[hH]([1-6])', 1) as l from pages))) select page_id, pos, level, (select max(b.pos) from h b where b.page_id = a.page_id and b.pos < a.pos and b.level < a.level) as parent_pos from h a")
def chk12(spark, sf):
    """Headings of a page and their parents in its tree."""
    found = F.posexplode(F.regexp_extract_all("html", F.lit("<[hH]([1-6])"), F.lit(1))).alias("i", "l")
    h = table(spark, sf, "pages").select("page_id", found).select("page_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("l").cast("int").alias("level"))
    return with_parents(h, "page_id")


@query("exp11_seeded_sample", "select doc_id from documents order by md5(doc_id || '-7'), doc_id limit 100")
def exp11(spark, sf):
    """A sampling operator: the 100 rows whose seeded hashes are smallest."""
    return table(spark, sf, "documents").select("doc_id").orderBy(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("-7"))), "doc_id").limit(100)
