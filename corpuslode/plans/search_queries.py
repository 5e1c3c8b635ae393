"""Queries of search, fusion, roll-ups and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.functions import text as X
from corpuslode.operators import evaluate as M
from corpuslode.operators import index as I
from corpuslode.operators import rollup as R
from corpuslode.operators import search as S
from corpuslode.operators.scratch import scratch
from corpuslode.plans.registry import query, table

K = 10
_T = "list_filter(string_split_regex(lower({}), '\\s+'), lambda t: t <> '')"
BM25 = """tok as (select doc_id as chunk_id, unnest({d}) as term from documents), tf as (select term, chunk_id, count(*) as tf from tok group by all),
dl as (select doc_id as chunk_id, coalesce(len({d}), 0) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl from dl), df as (select term, count(*) as df from tf group by term),
asked as (select item_id as query_id, unnest({q}) as term from benchmark), qf as (select query_id, term, count(*) as qf from asked group by all),
hit as (select query_id, chunk_id, round(sum(qf * {idf} * tf * {num} / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score from qf join tf using (term) join df using (term) join dl using (chunk_id), st group by all)"""
LUCENE = BM25.format(d=_T.format("text"), q=_T.format("text"), idf="ln(1 + (n - df + 0.5) / (df + 0.5))", num="1")
SPARSE = LUCENE + f""", alls as (select query_id, chunk_id, max(score) as score from (select * from hit union all select item_id, doc_id, 0.0 from benchmark, documents) group by all),
sparse as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from alls qualify rank <= {K})"""


def chunks(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


def asked(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_BUILT: dict[tuple[str, str], str] = {}


def indexed(spark, sf) -> I.Bm25Index:
    """The index of all documents of sf, built once an application, in the folder that driver and executors share."""
    key = spark.sparkContext.applicationId, sf
    if key not in _BUILT:
        path = scratch(spark, "bm25")
        I.Bm25Index(spark, path).index(chunks(spark, sf))
        _BUILT[key] = path
    return I.Bm25Index(spark, _BUILT[key])


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def vector_queries(spark, sf) -> DataFrame:
    """The stated query set: every row whose id is divisible by 100."""
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


DENSE = """v as (select vec_id, label, embedding::double[] as e from embeddings), sc as (select a.vec_id as query_id, b.vec_id as chunk_id, b.label, round({f}(a.e, b.e), 6) as score from v a, v b where a.vec_id % 100 = 0),
dense as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc qualify rank <= 10)"""
DOT, COSINE = DENSE.format(f="list_dot_product"), DENSE.format(f="list_cosine_similarity")


@query("spr1_postings", f"select term, count(*) as df, sum(tf)::bigint as cf, max(tf) as max_tf from (select term, doc_id, count(*) as tf from (select doc_id, unnest({_T.format('text')}) as term from documents) group by all) group by term")
def spr1(spark, sf):
    return S.postings(chunks(spark, sf)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query("agg14_corpus_stats", f"select count(*) as n, round(avg(coalesce(len({_T.format('text')}), 0)), 6) as avgdl, sum(coalesce(len({_T.format('text')}), 0))::bigint as total from documents")
def agg14(spark, sf):
    return S.lengths(chunks(spark, sf)).agg(F.count("*").alias("n"), F.round(F.avg("dl"), 6).alias("avgdl"), F.sum("dl").alias("total"))


@query("spr2_bm25", f"with {SPARSE} select query_id, chunk_id, score, rank from sparse")
def spr2(spark, sf):
    """Over the block-max index; S.bm25() is the same without one."""
    return indexed(spark, sf).search(asked(spark, sf), K)


@query("spr2_without_index", f"with {SPARSE} select query_id, chunk_id, score, rank from sparse")
def spr2b(spark, sf):
    return S.bm25(chunks(spark, sf), asked(spark, sf), K)


_IDF = "ln((n - df + 0.5) / (df + 0.5))"
OKAPI = BM25.replace("asked as (", "fl as (select 0.25 * avg(" + _IDF + ") as low from df, st), asked as (").replace("join dl using (chunk_id), st", "join dl using (chunk_id), st, fl").format(d=_T.format("text"), q=_T.format("text"), idf=f"(case when {_IDF} < 0 then low else {_IDF} end)", num="2.5")


@query("spr6_okapi", f"with {OKAPI} select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from hit qualify rank <= {K}")
def spr6(spark, sf):
    return S.bm25(chunks(spark, sf), asked(spark, sf), K, okapi=True, pad=False)


@query("spr5_sparse_dot", f"with d as (select doc_id as chunk_id, term, ln(1 + count(*)) as w from (select doc_id, unnest({_T.format('text')}) as term from documents) group by all), q as (select item_id as query_id, term, count(*) as w from (select item_id, unnest({_T.format('text')}) as term from benchmark) group by all), s as (select query_id, chunk_id, round(sum(d.w * q.w), 6) as score from d join q using (term) group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= {K}")
def spr5(spark, sf):
    d = S.postings(chunks(spark, sf)).select("chunk_id", F.col("term").alias("term_id"), F.log1p("tf").alias("weight"))
    q = S.postings(asked(spark, sf).withColumnRenamed("query_id", "chunk_id")).select(F.col("chunk_id").alias("query_id"), F.col("term").alias("term_id"), F.col("tf").alias("weight"))
    return S.sparse_dot(d, q, K)


@query("spr7_weighted_fields", f"with f as (select doc_id as chunk_id, 3.0 as w, string_split(text, chr(10))[1] as t from documents union all select doc_id, 1.0, text from documents), c as (select chunk_id, w, term, count(*) as c from (select chunk_id, w, unnest({_T.format('t')}) as term from f) group by all), q as (select distinct item_id as query_id, unnest({_T.format('text')}) as term from benchmark), s as (select query_id, chunk_id, round(sum(w * ln(1 + c) * c / (c + 1)), 6) as score from c join q using (term) group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= {K}")
def spr7(spark, sf):
    """BM25F-like: the first line weighs 3, the whole text 1."""
    d = chunks(spark, sf).select("chunk_id", F.element_at(F.split("text", "\n"), 1).alias("first"), "text")
    return S.weighted_fields(d, {"first": 3.0, "text": 1.0}, asked(spark, sf), K)


@query("dns2_dot_search", f"with {DOT} select query_id, chunk_id, score, rank from dense")
def dns2(spark, sf):
    return S.dense(vectors(spark, sf), vector_queries(spark, sf), K)


@query("dns3_cosine_search", f"with {COSINE} select query_id, chunk_id, score, rank from dense")
def dns3(spark, sf):
    return S.dense(vectors(spark, sf), vector_queries(spark, sf), K, cosine=True)


MEANS = "m as (select label, list(x order by i) as e from (select label, i, avg(x::double) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by label)"


@query("agg5_mean_vectors", f"with {MEANS} select label, list_transform(e, lambda x: round(x, 6)) as e from m")
def agg5(spark, sf):
    return R.mean_vectors(vectors(spark, sf), ["label"]).select("label", R.rounded("embedding").alias("e"))


@query("dns4_group_search", f"with {MEANS}, s as (select a.vec_id as query_id, m.label as chunk_id, round(list_dot_product(a.embedding::double[], m.e), 6) as score from embeddings a, m where a.vec_id % 100 = 0) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 3")
def dns4(spark, sf):
    """Heading-level search: dot products with means that are not normalised again."""
    m = R.mean_vectors(vectors(spark, sf), ["label"]).withColumnRenamed("label", "chunk_id")
    return S.dense(m, vector_queries(spark, sf), 3)


@query("dns7_filtered_search", "with v as (select vec_id, label, embedding::double[] as e from embeddings), s as (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_cosine_similarity(a.e, b.e), 6) as score from v a, v b where a.vec_id % 100 = 0 and b.label in (1, 3)) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 10")
def dns7(spark, sf):
    return S.dense(vectors(spark, sf).where("label in (1, 3)"), vector_queries(spark, sf), K, cosine=True)


@query("dns9_best_child", "with v as (select vec_id, label, embedding::double[] as e from embeddings), s as (select a.vec_id as query_id, b.vec_id // 4 as chunk_id, max(round(list_dot_product(a.e, b.e), 6)) as score from v a, v b where a.vec_id % 100 = 0 group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 5")
def dns9(spark, sf):
    """A chunk scores as its best child vector; 4 children a chunk, so 4 x 5 of them decide the best 5 chunks."""
    hits = S.dense(vectors(spark, sf), vector_queries(spark, sf), 20)
    best = hits.groupBy("query_id", F.floor(F.col("chunk_id") / 4).alias("chunk_id")).agg(F.max("score").alias("score"))
    return S.ranked(best, 5)


LEGS = f"{DOT}, {COSINE.replace('v as', 'v2 as').replace('sc as', 'sc2 as').replace('dense as', 'other as').replace('from v a, v b', 'from v2 a, v2 b').replace('from sc ', 'from sc2 ')}"


def _legs(spark, sf) -> tuple[DataFrame, DataFrame]:
    q = vector_queries(spark, sf)
    return S.dense(vectors(spark, sf), q, K), S.dense(vectors(spark, sf), q, K, cosine=True)


@query("fus1_weighted_rrf", f"with {LEGS}, s as (select query_id, chunk_id, round(sum(p), 9) as score from (select query_id, chunk_id, 3.0 / (10 + rank - 1) as p from dense union all select query_id, chunk_id, 0.3 / (10 + rank - 1) from other) group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 10")
def fus1(spark, sf):
    a, b = _legs(spark, sf)
    return S.rrf([(a, 3.0), (b, 0.3)], k=10, top=10)


@query("fus2_rrf_from_one", f"with {LEGS}, s as (select query_id, chunk_id, round(sum(p), 9) as score from (select query_id, chunk_id, 0.5 / (60 + rank) as p from dense union all select query_id, chunk_id, 0.5 / (60 + rank) from other) group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s")
def fus2(spark, sf):
    a, b = _legs(spark, sf)
    return S.rrf([(a, 0.5), (b, 0.5)], rank_base=1)


@query("fus4_convex", f"with {LEGS}, s as (select query_id, chunk_id, round(0.4 * coalesce(a.score, 0) + (1 - 0.4) * coalesce(b.score, 0), 6) as score from dense a full join other b using (query_id, chunk_id)) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s")
def fus4(spark, sf):
    a, b = _legs(spark, sf)
    return S.convex(a, b, 0.4)


@query("fus5_normalisers", f"with {DOT}, w as (select *, min(score) over q as lo, max(score) over q as hi, stddev_pop(score) over q as sd, count(*) over q as n, count(*) over (partition by query_id, score) as ties, rank() over (partition by query_id order by score) as r from dense window q as (partition by query_id)) select query_id, chunk_id, round(case when hi > lo then (score - lo) / (hi - lo) else 0.5 end, 6) as min_max, round(case when sd > 0 then (score - lo) / sd else 0.5 end, 6) as z_score, round((r + (ties - 1) / 2 - 1) / (n - 1), 6) as percentile from w")
def fus5(spark, sf):
    a = S.dense(vectors(spark, sf), vector_queries(spark, sf), K).drop("rank")
    out = None
    for how in ("min_max", "z_score", "percentile"):
        one = S.normalized(a, how).withColumnRenamed("score", how)
        out = one if out is None else out.join(one, ["query_id", "chunk_id"])
    return out


@query("fus8_leg_overlap", f"with {LEGS} select query_id, count(a.score) as n_dense, count(b.score) as n_other, count(*) filter (a.score is not null and b.score is not null) as n_both, round(avg(a.score), 4) as mean_dense, round(stddev_pop(a.score), 4) as sd_dense, min(a.score) as min_dense, max(a.score) as max_dense, round(coalesce(covar_pop(a.score, b.score) / nullif(stddev_pop(a.score) filter (b.score is not null) * stddev_pop(b.score) filter (a.score is not null), 0), 0), 4) as correlation from dense a full join other b using (query_id, chunk_id) group by query_id")
def fus8(spark, sf):
    a, b = _legs(spark, sf)
    j = a.select("query_id", "chunk_id", F.col("score").alias("a")).join(b.select("query_id", "chunk_id", F.col("score").alias("b")), ["query_id", "chunk_id"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    sd = lambda c: F.stddev_pop(F.when(both, F.col(c)))
    related = F.covar_pop(F.when(both, F.col("a")), F.when(both, F.col("b"))) / F.nullif(sd("a") * sd("b"), F.lit(0.0))
    r = lambda c, name: F.round(c, 4).alias(name)
    return j.groupBy("query_id").agg(F.count("a").alias("n_dense"), F.count("b").alias("n_other"), F.count(F.when(both, 1)).alias("n_both"), r(F.avg("a"), "mean_dense"), r(F.stddev_pop("a"), "sd_dense"), F.min("a").alias("min_dense"), F.max("a").alias("max_dense"), r(F.coalesce(related, F.lit(0.0)), "correlation"))


@query("fus9_alpha_sweep", f"with {LEGS} select alpha, round(sum(round(alpha * coalesce(a.score, 0) + (1 - alpha) * coalesce(b.score, 0), 6)), 4) as total from (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as alpha) cross join (dense a full join other b using (query_id, chunk_id)) group by alpha")
def fus9(spark, sf):
    a, b = _legs(spark, sf)
    j = a.select("query_id", "chunk_id", F.col("score").alias("a")).join(b.select("query_id", "chunk_id", F.col("score").alias("b")), ["query_id", "chunk_id"], "full").na.fill(0.0, ["a", "b"])
    j = j.withColumn("alpha", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    return j.groupBy("alpha").agg(F.round(F.sum(F.round(F.col("alpha") * F.col("a") + (1 - F.col("alpha")) * F.col("b"), 6)), 4).alias("total"))


HYBRID = f"""with {LUCENE}, alls as (select query_id, chunk_id, max(score) as score from (select * from hit union all select item_id, doc_id, 0.0 from benchmark, documents) group by all),
s as (select query_id, chunk_id, score as bm25_score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as bm25_rank from alls qualify bm25_rank < 100),
v as (select vec_id, embedding::double[] as e from embeddings), ds as (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_dot_product(a.e, b.e), 6) as semantic_score from benchmark q join v a on a.vec_id = q.item_id, v b where b.vec_id in (select doc_id from documents)),
d as (select *, row_number() over (partition by query_id order by semantic_score desc, chunk_id) - 1 as semantic_rank from ds qualify semantic_rank < 100),
f as (select query_id, chunk_id, bm25_score, bm25_rank, semantic_score, semantic_rank, round(coalesce(1.0 / (60 + semantic_rank), 0) + coalesce(1.0 / (60 + bm25_rank), 0), 9) as rrf_score from s full join d using (query_id, chunk_id))
select *, row_number() over (partition by query_id order by rrf_score desc, semantic_rank nulls last, bm25_rank nulls last, chunk_id) as rank from f qualify rank <= 10"""


@query("hyb1_hybrid_search", HYBRID)
def hyb1(spark, sf):
    """Every benchmark item against all documents: words, and the vectors of the same ids, with the explanation."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    c = chunks(spark, sf).join(e, F.col("chunk_id") == F.col("vec_id"), "left").select("chunk_id", "text", "embedding")
    q = asked(spark, sf).join(e, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "text", "embedding")
    return S.hybrid(c, q, 10, sparse=indexed(spark, sf).search)


_CHUNK = "c as (select vec_id as chunk_id, vec_id // 5 as parent_id, vec_id % 5 as pos, 't' || vec_id as text from embeddings)"


def _children(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.floor(F.col("vec_id") / 5).alias("parent_id"), (F.col("vec_id") % 5).alias("pos"), F.concat(F.lit("t"), "vec_id").alias("text"))


@query("hie2_parent_child", f"with {DOT}, {_CHUNK}, b as (select query_id, parent_id, min(rank) as best from dense join c using (chunk_id) group by all), r as (select *, row_number() over (partition by query_id order by best, parent_id) as rank from b qualify rank <= 4) select query_id, parent_id, rank, t.text from r join (select parent_id, string_agg(text, chr(10) order by pos) as text from c group by parent_id) t using (parent_id)")
def hie2(spark, sf):
    return R.parent_child(S.dense(vectors(spark, sf), vector_queries(spark, sf), K), _children(spark, sf), 4)


@query("hie3_auto_merge", f"with {DOT.replace('<= 10', '<= 40')}, {_CHUNK}, g as (select query_id, parent_id, count(*) as got, min(rank) as best from dense join c using (chunk_id) group by all), m as (select g.*, siblings > 1 and got / siblings >= 0.4 as merge from g join (select parent_id, count(*) as siblings from c group by all) using (parent_id)) select query_id, parent_id, null::bigint as chunk_id, best as rank from m where merge union all select query_id, parent_id, chunk_id, rank from dense join c using (chunk_id) join m using (query_id, parent_id) where not merge")
def hie3(spark, sf):
    return R.auto_merged(S.dense(vectors(spark, sf), vector_queries(spark, sf), 40), _children(spark, sf), 0.4)


@query("hie1_level_of_detail", "with v as (select vec_id, embedding::double[] as e from embeddings), sc as (select a.vec_id as query_id, b.vec_id as chunk_id, b.vec_id // 5 as section_id, b.vec_id // 50 as doc_id, round(list_dot_product(a.e, b.e), 6) as score from v a, v b where a.vec_id % 100 = 0), d as (select query_id, doc_id from (select query_id, doc_id, max(score) as s from sc group by all) qualify row_number() over (partition by query_id order by s desc, doc_id) <= 3), s as (select query_id, section_id from (select query_id, section_id, max(score) as s from sc semi join d using (query_id, doc_id) group by all) qualify row_number() over (partition by query_id order by s desc, section_id) <= 4) select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from sc semi join s using (query_id, section_id) qualify rank <= 5")
def hie1(spark, sf):
    """Documents by their best vectors, then only the chosen ones' sections and vectors: no query meets every row as rows."""
    doc, section = F.floor(F.col("chunk_id") / 50), F.floor(F.col("chunk_id") / 5)
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    docs = S.dense(v.select(doc.alias("chunk_id"), "embedding"), q, 3).select("query_id", F.col("chunk_id").alias("doc_id"), "score")
    own = v.select("chunk_id", doc.alias("doc_id"), section.alias("section_id"), "embedding").join(S.small(docs.select("query_id", "doc_id")), "doc_id")
    own = own.join(S.small(q.select("query_id", F.col("embedding").alias("_q"))), "query_id")
    sc = own.select("query_id", "doc_id", "section_id", "chunk_id", F.round(S.dot(F.col("_q"), F.col("embedding")), 6).alias("score"))
    sections = sc.groupBy("query_id", "doc_id", "section_id").agg(F.max("score").alias("score"))
    return R.level_of_detail(docs, sections, sc.select("query_id", "section_id", "chunk_id", "score"), 3, 4, 5).drop("section_id")


@query("agg1_group_rollup", "select source, lang, min(doc_id) as start_char, max(doc_id + n_chars) as end_char, count(*) as n from documents group by all")
def agg1(spark, sf):
    d = table(spark, sf, "documents").select("source", "lang", F.col("doc_id").alias("start_char"), (F.col("doc_id") + F.col("n_chars")).alias("end_char"))
    return R.spans_of(d, ["source", "lang"])


@query("agg3_distinct_keywords", "with w as (select source, word, doc_id, lower(word) as k from (select source, doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{9,}'))) as word from documents)) select source, list(word order by word) as terms from (select source, word from w qualify row_number() over (partition by source, k order by doc_id, word) = 1) group by source")
def agg3(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{9,}"), F.lit(0)))).alias("word"))
    return R.distinct_terms(d.withColumn("o", F.struct("doc_id", "word")), ["source"], "word", "o")


@query("agg9_confidence", "select term, n_sources, round(least(n_sources / 3, 1.0) * 0.6 + ratio * 0.4, 6) as score, case when round(least(n_sources / 3, 1.0) * 0.6 + ratio * 0.4, 6) >= 0.8 then 'HIGH' when round(least(n_sources / 3, 1.0) * 0.6 + ratio * 0.4, 6) >= 0.5 then 'MEDIUM' else 'LOW' end as level from (select event_type as term, user_id, count(distinct event_id % 7) as n_sources, case when event_type = 'view' then 0.9 else 0.5 end as ratio from events group by all)")
def agg9(spark, sf):
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("term"), "user_id").agg(F.countDistinct(F.col("event_id") % 7).alias("n_sources"))
    score = F.round(X.confidence(F.col("n_sources"), F.when(F.col("term") == "view", 0.9).otherwise(0.5)), 6)
    return t.select("term", "n_sources", score.alias("score"), X.level(score).alias("level"))


VOTES = "select conv_id as doc_id, role || turn % 3 as source, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) as term from conversations"


def _votes(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat("role", (F.col("turn") % 3).cast("string")).alias("source"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("term"))


@query("exp1_votes", f"select doc_id, lower(term) as key, arg_min(term, (source, term)) as term, count(distinct source) as n from ({VOTES}) group by doc_id, lower(term) having n >= 2")
def exp1(spark, sf):
    return R.votes(_votes(spark, sf), ["doc_id"], 2)


@query("exp3_self_consistency", f"select doc_id, lower(term) as key, arg_min(term, (source, term)) as term, count(*) as n from ({VOTES}) group by doc_id, lower(term) having n >= 3")
def exp3(spark, sf):
    return R.votes(_votes(spark, sf), ["doc_id"], 3, repeats=True)


VOCAB = """w as (select distinct doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z]{4,}'), lambda x: lower(x)))) as term from documents), e as (select distinct doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Z][A-Za-z]{3,}'), lambda x: lower(x)))) as term from documents),
t as (select term, coalesce(a.n, 0) as entity_docs, coalesce(b.n, 0) as text_docs from (select term, count(*) as n from w group by all) b full join (select term, count(*) as n from e group by all) a using (term)), r as (select *, round(entity_docs / greatest(text_docs, 1), 6) as ratio from t)"""


@query("agg13_vocabulary", f"with {VOCAB} select *, case when entity_docs >= 2 and ratio >= 0.55 then 'bypass' when entity_docs >= 2 and ratio >= 0.5 then 'seeds' when entity_docs >= 3 and ratio >= 0.2 and ratio < 0.5 then 'contextual' when text_docs >= 5 and ratio > 0 and ratio < 0.15 then 'low_precision' when text_docs >= 5 and ratio = 0 then 'negatives' else 'none' end as list from r")
def agg13(spark, sf):
    d = table(spark, sf, "documents")
    terms = lambda p: d.select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), F.lower))).alias("term"))
    return R.vocabulary(terms("[A-Za-z]{4,}"), terms("[A-Z][A-Za-z]{3,}"))


RESULTS = "r as (select event_type as dataset, case when event_id % 4 = 0 then null else event_id % 12 + 1 end as rank, value as latency_ms from events)"


def _results(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("dataset"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 12 + 1).alias("rank"), F.col("value").alias("latency_ms"))


@query("met1_summary", f"with {RESULTS} select dataset, count(*) as n, {', '.join(f'round(avg(coalesce((rank <= {k})::int, 0)), 6) as hit_{k}' for k in M.KS)}, round(avg(coalesce(1 / rank, 0)), 6) as mrr, round(avg(latency_ms), 6) as mean_ms, list_sort(list(latency_ms))[(count(*) * 0.5::double)::double::int + 1 - (case when (count(*) * 0.5)::int > count(*) * 0.5 then 1 else 0 end)] as p50_ms, list_sort(list(latency_ms))[least(floor(count(*) * 0.95::double)::int, count(*) - 1) + 1] as p95_ms from r group by rollup(dataset)".replace("[(count(*) * 0.5::double)::double::int + 1 - (case when (count(*) * 0.5)::int > count(*) * 0.5 then 1 else 0 end)]", "[floor(count(*) * 0.5::double)::int + 1]"))
def met1(spark, sf):
    return M.summary(_results(spark, sf), ["dataset"])


@query("met2_worst", f"with {RESULTS.replace('select event_type', 'select event_id, event_type')} select event_id, rank from r order by rank desc nulls first, event_id limit 20")
def met2(spark, sf):
    """The 20 worst results: misses first, then the largest ranks."""
    return _results(spark, sf).select("event_id", "rank").orderBy(F.desc_nulls_first("rank"), "event_id").limit(20)


@query("met3_first_hit", f"with {DOT.replace('<= 10', '<= 50')}, rel as (select a.vec_id as query_id, b.vec_id as chunk_id from embeddings a join embeddings b on a.vec_id // 25 = b.vec_id // 25 and a.vec_id <> b.vec_id where a.vec_id % 100 = 0) select query_id, min(dense.rank) as rank from rel left join dense using (query_id, chunk_id) group by query_id")
def met3(spark, sf):
    return M.first_hit(S.dense(vectors(spark, sf), vector_queries(spark, sf), 50), _relevant(spark, sf))


def _relevant(spark, sf) -> DataFrame:
    """Relevant to a query: the other vectors of its own section of 25, so that few rows stand for each query."""
    section = F.floor(F.col("vec_id") / 25).alias("section")
    e = table(spark, sf, "embeddings").select("vec_id", section)
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "section")
    return e.join(q, "section").where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("chunk_id"))


@query("met6_ndcg", f"with {DOT}, rel as (select a.vec_id as query_id, b.vec_id as chunk_id from embeddings a join embeddings b on a.vec_id // 25 = b.vec_id // 25 and a.vec_id <> b.vec_id where a.vec_id % 100 = 0), d as (select query_id, sum(1 / log2(rank + 1)) as dcg from dense join rel using (query_id, chunk_id) group by all), i as (select query_id, count(*) as n from rel group by all) select query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda k: 1 / log2(k + 1))), 6) as ndcg from i left join d using (query_id)")
def met6(spark, sf):
    return M.ndcg(S.dense(vectors(spark, sf), vector_queries(spark, sf), K), _relevant(spark, sf), K)


@query("met7_span_scores", "with f as (select distinct user_id, unnest(range(event_id % 97, event_id % 97 + 5)) as p from events where event_type = 'view'), t as (select distinct user_id, unnest(range(event_id % 89, event_id % 89 + 7)) as p from events where event_type = 'error'), c as (select user_id, count(f.p) as f, count(t.p) as t, count(*) filter (f.p is not null and t.p is not null) as b from f full join t using (user_id, p) group by user_id) select user_id, round(coalesce(b / nullif(t, 0), 0), 6) as recall, round(coalesce(b / nullif(f, 0), 0), 6) as precision, round(coalesce(b / nullif(f + t - b, 0), 0), 6) as iou from c".replace("select user_id, count(f.p) as f, count(t.p) as t, count(*) filter (f.p is not null and t.p is not null) as b from f full join t using (user_id, p)", "select user_id, count(fp) as f, count(tp) as t, count(*) filter (fp is not null and tp is not null) as b from (select coalesce(f.user_id, t.user_id) as user_id, f.p as fp, t.p as tp from f full join t on f.user_id = t.user_id and f.p = t.p)"))
def met7(spark, sf):
    e = table(spark, sf, "events")
    span = lambda kind, m, n: e.where(F.col("event_type") == kind).select("user_id", (F.col("event_id") % m).alias("start"), (F.col("event_id") % m + n).alias("end"))
    return M.span_scores(span("view", 97, 5), span("error", 89, 7), "user_id")


@query("met14_grades", "select grade, count(*) as n, count(*) filter (slow) as n_slow, round(avg(slow::int), 6) as slow_rate from (select case when value >= 100 then 'GOOD' when value >= 50 then 'ACCEPTABLE' else 'POOR' end as grade, event_id % 3 = 0 as slow from events) group by grade")
def met14(spark, sf):
    v = F.col("value")
    g = table(spark, sf, "events").select(F.when(v >= 100, "GOOD").when(v >= 50, "ACCEPTABLE").otherwise("POOR").alias("grade"), (F.col("event_id") % 3 == 0).cast("int").alias("slow"))
    return g.groupBy("grade").agg(F.count("*").alias("n"), F.sum("slow").alias("n_slow"), F.round(F.avg("slow"), 6).alias("slow_rate"))


@query("met16_separation", "select round(avg(value) filter (event_type = 'view') - avg(value) filter (event_type = 'error'), 6) as gap from events")
def met16(spark, sf):
    one = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    return table(spark, sf, "events").agg(F.round(one("view") - one("error"), 6).alias("gap"))


@query("met17_oracle_choice", "select user_id, max(value) as best, arg_max(event_type, (value, event_id)) as approach, max(value) >= 150 as can_answer from events group by user_id")
def met17(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_type", F.struct("value", "event_id")).alias("approach"), (F.max("value") >= 150).alias("can_answer"))


@query("exp10_two_samples", "select n1, n2, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) as t from (select count(*) filter (event_type = 'view') as n1, count(*) filter (event_type = 'error') as n2, avg(value) filter (event_type = 'view') as m1, avg(value) filter (event_type = 'error') as m2, var_samp(value) filter (event_type = 'view') as v1, var_samp(value) filter (event_type = 'error') as v2 from events)")
def exp10(spark, sf):
    pick = lambda kind: F.when(F.col("event_type") == kind, F.col("value"))
    a, b = pick("view"), pick("error")
    r = table(spark, sf, "events").agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    return r.select("n1", "n2", F.expr("round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6)").alias("t"))


@query("chk1_whole", "select doc_id, 0 as start_char, length(text) as end_char, text from documents")
def chk1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), "text")


@query("chk3a_token_count", "select doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+(?:[-_][\\p{L}\\p{N}_]+)*|[^\\s]')) as n from documents")
def chk3a(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit("(?U)\\w+(?:[-_]\\w+)*|\\S"), F.lit(0))).alias("n"))


@query("chk5_fixed_size", "select doc_id, i // 100 as idx, string_agg(w, ' ' order by i) as text from (select doc_id, unnest(l) as w, generate_subscripts(l, 1) - 1 as i from (select doc_id, list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '') as l from documents)) group by all")
def chk5(spark, sf):
    """Windows of 100 words: slices of the words, nothing is shuffled."""
    d = table(spark, sf, "documents").select("doc_id", X.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    d = d.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(100))).alias("idx", "at"))
    return d.select("doc_id", "idx", F.array_join(F.slice("w", F.col("at") + 1, F.lit(100)), " ").alias("text"))


@query("chk18_windows", "select doc_id, s as start_char, substr(text, s + 1, 500) as text from (select doc_id, text, unnest(range(0, greatest(length(text), 1), 400)) as s from documents)")
def chk18(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text"), F.lit(1)) - 1, F.lit(400))).alias("start_char"))
    return d.select("doc_id", "start_char", F.substring("text", F.col("start_char") + 1, F.lit(500)).alias("text"))


@query("chk2b_lines", "select doc_id, i - 1 as idx, coalesce(list_sum(list_transform(l[:i - 1], lambda x: length(x) + 1)), 0)::bigint as start_char, l[i] as text from (select doc_id, string_split(text, chr(10)) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)")
def chk2b(spark, sf):
    """Pieces of a text with their places: offsets add up within the row."""
    d = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    at = F.aggregate("l", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x) + 1)))
    return d.select("doc_id", F.posexplode(F.arrays_zip("l", F.slice(at, F.lit(1), F.size("l")).alias("at"))).alias("idx", "p")).select("doc_id", "idx", F.col("p.at").alias("start_char"), F.col("p.l").alias("text"))
