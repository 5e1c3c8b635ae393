"""Queries of hybrid search in its variants, and of roll-ups from chunks to headings to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.functions import text as X
from corpuslode.operators import index as I
from corpuslode.operators import patterns as P
from corpuslode.operators import rollup as R
from corpuslode.operators import search as S
from corpuslode.operators import vectors as V
from corpuslode.operators.scratch import scratch
from corpuslode.plans.registry import query, table
from corpuslode.plans.search_queries import _T, BM25, COSINE, DOT, HYBRID, LUCENE, SPARSE, asked, chunks, indexed, vector_queries, vectors
from corpuslode.plans.text_queries import _EXP, EXPANDABLE, TOKENS, expandable, quoted

E_SQL = f"""ek as (select * from (values {', '.join(f"({i}, {quoted(k)}, {quoted(v)})" for i, (k, v) in enumerate(_EXP.items()))}) ek(i, k, v)),
raw as (select item_id, {EXPANDABLE} as text from benchmark), eh as (select item_id, text, v from raw join ek on contains(lower(text), k)), w as (select distinct item_id, text, unnest(string_split(v, ' ')) as t from eh),
ex as (select b.item_id, b.text || coalesce((select ' ' || coalesce(string_agg(t, ' ' order by encode(t)) filter (not list_contains({TOKENS.replace('text', 'w.text')}, lower(t))), '') from w where w.item_id = b.item_id having count(*) > 0), '') as text, b.item_id in (select item_id from eh) as expanded from raw b)"""
_BM25_EX = LUCENE.replace("from benchmark)", "from ex)")
ADAPTIVE = f"""with {E_SQL}, x as (select item_id as query_id, case when expanded then 10 else 60 end as base, case when expanded then 3.0::double else 1.0 end as ws, case when expanded then 0.3::double else 1.0 end as wd, case when expanded then 200 else 100 end as depth from ex),
{_BM25_EX}, alls as (select query_id, chunk_id, max(score) as score from (select * from hit union all select item_id, doc_id, 0.0 from ex, documents) group by all),
s as (select query_id, chunk_id, score as bm25_score, row_number() over (partition by query_id order by score desc, chunk_id) - 1 as bm25_rank from alls),
v as (select vec_id, embedding::double[] as e from embeddings), ds as (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_dot_product(a.e, b.e), 6) as semantic_score from ex q join v a on a.vec_id = q.item_id, v b where b.vec_id in (select doc_id from documents)),
d as (select *, row_number() over (partition by query_id order by semantic_score desc, chunk_id) - 1 as semantic_rank from ds),
s1 as (select s.* from s join x using (query_id) where bm25_rank < depth), d1 as (select d.* from d join x using (query_id) where semantic_rank < depth),
j as (select * from s1 full join d1 using (query_id, chunk_id)), y as (select query_id, chunk_id, bm25_score, bm25_rank, semantic_score, semantic_rank, round(coalesce(wd / (base + semantic_rank), 0) + coalesce(ws / (base + bm25_rank), 0), 9) as rrf_score from j join x using (query_id))
select *, row_number() over (partition by query_id order by rrf_score desc, semantic_rank nulls last, bm25_rank nulls last, chunk_id) as rank from y qualify rank <= 10"""


def _with_vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """All documents, and all benchmark items as queries with their expansion, each with the vector of its id."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    c = chunks(spark, sf).join(e, F.col("chunk_id") == F.col("vec_id"), "left").select("chunk_id", "text", "embedding")
    keys, text = X.expansions(F.col("text"))
    q = expandable(spark, sf).select(F.col("item_id").alias("query_id"), text.alias("text"), (F.size(keys) > 0).alias("expanded"))
    return c, q.join(e, F.col("query_id") == F.col("vec_id"), "left").select("query_id", "text", "expanded", "embedding")


@query("hyb1_adaptive_hybrid", ADAPTIVE)
def hyb1b(spark, sf):
    """Expansion decides the constants of each query: rank constant, weights and candidates."""
    c, q = _with_vectors(spark, sf)
    return S.adaptive(c, q, 10, indexed(spark, sf).search)


@query("hyb2_sparse_only", f"with {SPARSE} select query_id, chunk_id, score as bm25_score, rank - 1 as bm25_rank, null::double as semantic_score, null::int as semantic_rank, score as rrf_score, rank from sparse")
def hyb2(spark, sf):
    q = asked(spark, sf).withColumns({"expanded": F.lit(False), "embedding": F.lit(None).cast("array<float>")})
    return S.adaptive(chunks(spark, sf), q, 10, sparse_only=True)


@query("hyb3_explained", f"with h as ({HYBRID}), n as (select query_id, count(*) filter (bm25_score is not null) as n_sparse, count(*) filter (semantic_score is not null) as n_dense, max(rrf_score) as best from h group by query_id) select query_id, chunk_id, bm25_rank, semantic_rank, rrf_score, case when bm25_rank is null then 'dense' when semantic_rank is null then 'sparse' else 'both' end as stage, n_sparse, n_dense, round(rrf_score / best, 6) as share_of_best from h join n using (query_id)")
def hyb3(spark, sf):
    """Hybrid results with where each came from, and how many of its query's results each leg gave."""
    from pyspark.sql import Window

    c, q = _with_vectors(spark, sf)
    q = asked(spark, sf).join(q.select("query_id", "embedding"), "query_id")
    w = Window.partitionBy("query_id")
    stage = F.when(F.col("bm25_rank").isNull(), "dense").when(F.col("semantic_rank").isNull(), "sparse").otherwise("both")
    h = S.hybrid(c, q, 10)
    return h.select("query_id", "chunk_id", "bm25_rank", "semantic_rank", "rrf_score", stage.alias("stage"), F.count("bm25_score").over(w).alias("n_sparse"), F.count("semantic_score").over(w).alias("n_dense"), F.round(F.col("rrf_score") / F.max("rrf_score").over(w), 6).alias("share_of_best"))


@query("spr3_index_search", f"with {SPARSE} select query_id, chunk_id, score, rank from sparse")
def spr3(spark, sf):
    """The same search through an index on disk: built, reopened by its path, searched."""
    path = scratch(spark, "bm25")
    I.opened(spark, path).index(chunks(spark, sf))
    return I.opened(spark, path).search(asked(spark, sf), 10)


_LATER = "later as (select doc_id, case when doc_id % 3 = 0 then text || ' zeta zeta' else text end as text from documents where (doc_id % 2 = 0 or doc_id % 3 = 0) and doc_id % 5 <> 0)"


@query("spr3_segments", f"with {_LATER}, {SPARSE.replace('from documents', 'from later').replace('benchmark, documents', 'benchmark, later')} select query_id, chunk_id, score, rank from sparse")
def spr3b(spark, sf):
    """An index that grows by segments: even ids, then every third one anew with more words, then every fifth one goes."""
    index, c = I.Bm25Index(spark, scratch(spark, "segments")), chunks(spark, sf)
    index.add(c.where("chunk_id % 2 = 0"))
    index.add(c.where("chunk_id % 3 = 0").withColumn("text", F.concat("text", F.lit(" zeta zeta"))))
    index.delete(c.where("chunk_id % 5 = 0"))
    return index.search(asked(spark, sf), 10)


OVERLAP = f"round(len(list_intersect(list_distinct({_T.format('q.text')}), {_T.format('d.text')})) / len(list_distinct({_T.format('q.text')})), 6)"


@query("rrk1_reranked", f"with {SPARSE.replace('rank <= 10', 'rank <= 50')}, r as (select query_id, chunk_id, sparse.score, sparse.rank as first_rank, {OVERLAP} as rerank_score from sparse join benchmark q on q.item_id = query_id join documents d on d.doc_id = chunk_id) select *, round(1 / (1 + exp(-rerank_score)), 6) as relevance, row_number() over (partition by query_id order by rerank_score desc, first_rank, chunk_id) as rank from r qualify rank <= 10")
def rrk1(spark, sf):
    """The best 5 k of the sparse leg, ranked anew by shared words, with the sigmoid of that score (RRK-2)."""
    return S.reranked(S.bm25(chunks(spark, sf), asked(spark, sf), 50), chunks(spark, sf), asked(spark, sf), 10)


TWO = f"{DOT}, {COSINE.replace('v as', 'v2 as').replace('sc as', 'sc2 as').replace('dense as', 'other as').replace('from v a, v b', 'from v2 a, v2 b').replace('from sc ', 'from sc2 ')}"
GROUPS = "gm as (select label, list(x order by i) as e from (select label, i, avg(x::double) as x from (select label, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all) group by label)"


def _legs(spark, sf) -> tuple[DataFrame, DataFrame]:
    v, q = vectors(spark, sf), vector_queries(spark, sf)
    return S.dense(v, q, 10), S.dense(v, q, 10, cosine=True)


@query("fus3_list_fusion", f"with {TWO}, third as (select query_id, chunk_id, row_number() over (partition by query_id order by chunk_id desc) as rank from dense), s as (select query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select query_id, chunk_id, rank from dense union all select query_id, chunk_id, rank from other union all select query_id, chunk_id, rank from third) group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 10")
def fus3(spark, sf):
    """Three lists without weights, ranks from one."""
    from pyspark.sql import Window

    a, b = _legs(spark, sf)
    third = a.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("chunk_id"))))
    return S.rrf([(a, 1.0), (b, 1.0), (third, 1.0)], top=10, rank_base=1)


@query("fus6_sparse_convex", f"with {TWO}, m as (select query_id, min(score) as lo, max(score) as hi from dense group by all), m2 as (select query_id, min(score) as lo, max(score) as hi from other group by all), a as (select query_id, chunk_id, round(case when hi > lo then (score - lo) / (hi - lo) else 1.0 end, 6) as s from dense join m using (query_id)), b as (select query_id, chunk_id, round(case when hi > lo then (score - lo) / (hi - lo) else 1.0 end, 6) as s from other join m2 using (query_id)), c as (select query_id, chunk_id, round(0.36::double * coalesce(b.s, 0) + (1 - 0.36::double) * coalesce(a.s, 0), 6) as score from a full join b using (query_id, chunk_id)) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from c qualify rank <= 10")
def fus6(spark, sf):
    """Convex fusion of the learned-sparse kind: equal scores become 1, alpha is the dense leg's weight."""
    a, b = _legs(spark, sf)
    return S.convex(S.normalized(b, "min_max", 1.0), S.normalized(a, "min_max", 1.0), 0.36, 10)


_TECH = "least(least((" + " + ".join(f"regexp_matches(text, {quoted(p.replace('(?U)', ''))})::int" for p in X.TECHNICAL_PATTERNS) + ") * 0.1::double, 0.5) + least((" + " + ".join(f"contains(lower(text), {quoted(k)})::int" for k in X.TECHNICAL_KEYWORDS) + ") * 0.1::double, 0.5), 1.0)"


@query(
    "fus7_adaptive_weights",
    f"""with {LUCENE}, s as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from hit qualify rank <= 20),
e as (select vec_id, embedding::double[] as e from embeddings), d as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select a.vec_id as query_id, b.vec_id as chunk_id, round(list_dot_product(a.e, b.e), 6) as score from benchmark q join e a on a.vec_id = q.item_id, e b) qualify rank <= 20),
t as (select item_id as query_id, {_TECH} > 0.3 as technical from (select item_id, text || case item_id % 2 when 0 then ' api json yaml database' else '' end as text from benchmark)),
f as (select query_id, chunk_id, round(sum(p), 9) as score from (select query_id, chunk_id, (case when technical then 0.7 else 0.4 end)::double / (60 + rank) as p from s join t using (query_id) union all select query_id, chunk_id, (case when technical then 0.3 else 0.6 end)::double / (60 + rank) from d join t using (query_id)) group by all)
select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= 10""",
)
def fus7(spark, sf):
    """Weights by how technical a query is: .7 / .3 over a score of 0.3, else .4 / .6; the best 20 of each leg."""
    more = F.when(F.col("query_id") % 2 == 0, " api json yaml database").otherwise("")
    q = asked(spark, sf)
    t = q.select("query_id", (X.technical_score(F.concat("text", more)) > 0.3).alias("technical"))
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    qv = q.join(e, F.col("query_id") == F.col("vec_id")).select("query_id", "embedding")
    s, d = S.bm25(chunks(spark, sf), q, 20, pad=False), S.dense(vectors(spark, sf), qv, 20)
    part = lambda leg, a, b: leg.join(t, "query_id").select("query_id", "chunk_id", (F.when(F.col("technical"), a).otherwise(b) / (60 + F.col("rank"))).alias("p"))
    both = part(s, 0.7, 0.4).unionByName(part(d, 0.3, 0.6))
    return S.ranked(both.groupBy("query_id", "chunk_id").agg(F.round(F.sum("p"), 9).alias("score")), 10)


VARIANTS = "va as (select item_id * 10 as query_id, text from benchmark union all select item_id * 10 + 1, left(text, 40) from benchmark union all select item_id * 10 + 2, right(text, 40) from benchmark)"


@query("hyb5_query_variants", f"with {VARIANTS}, " + BM25.format(d=_T.format("text"), q=_T.format("text"), idf="ln(1 + (n - df + 0.5) / (df + 0.5))", num="1").replace("select item_id as query_id", "select query_id").replace("from benchmark)", "from va)") + ", r as (select query_id, chunk_id, row_number() over (partition by query_id order by score desc, chunk_id) as rank from hit qualify rank <= 20), f as (select query_id // 10 as query_id, chunk_id, round(sum(1.0::double / (60 + rank)), 9) as score from r group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= 10")
def hyb5(spark, sf):
    """Each query and two variants of it are searched apart; their lists are fused."""
    q = asked(spark, sf)
    va = q.select((F.col("query_id") * 10).alias("query_id"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.substring("text", 1, 40).alias("t")), F.struct(F.lit(2).alias("k"), F.expr("right(text, 40)").alias("t")))).alias("v")).select((F.col("query_id") + F.col("v.k")).alias("query_id"), F.col("v.t").alias("text"))
    r = S.bm25(chunks(spark, sf), va, 20, pad=False)
    one = r.select(F.floor(F.col("query_id") / 10).alias("query_id"), "chunk_id", (F.lit(1.0) / (60 + F.col("rank"))).alias("p"))
    return S.ranked(one.groupBy("query_id", "chunk_id").agg(F.round(F.sum("p"), 9).alias("score")), 10)


@query("spr8_weighted_queries", f"with {VARIANTS}, " + BM25.format(d=_T.format("text"), q=_T.format("text"), idf="ln(1 + (n - df + 0.5) / (df + 0.5))", num="1").replace("select item_id as query_id", "select query_id").replace("from benchmark)", "from va where query_id % 10 < 2)") + ", r as (select * from hit qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 50), f as (select query_id // 10 as query_id, chunk_id, round(sum((case query_id % 10 when 0 then 0.7 else 0.3 end)::double * score), 4) as score from r group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= 10")
def spr8(spark, sf):
    """A query and a variant, their sparse scores weighted .7 and .3."""
    q = asked(spark, sf)
    va = q.select((F.col("query_id") * 10).alias("query_id"), "text").unionByName(q.select((F.col("query_id") * 10 + 1).alias("query_id"), F.substring("text", 1, 40).alias("text")))
    r = S.bm25(chunks(spark, sf), va, 50, pad=False)
    one = r.select(F.floor(F.col("query_id") / 10).alias("query_id"), "chunk_id", (F.when(F.col("query_id") % 10 == 0, 0.7).otherwise(0.3) * F.col("score")).alias("p"))
    return S.ranked(one.groupBy("query_id", "chunk_id").agg(F.round(F.sum("p"), 4).alias("score")), 10)


_BMX = f"""tok as (select doc_id as chunk_id, unnest({_T.format('text')}) as term from documents), tf as (select term, chunk_id, count(*) as tf from tok group by all),
dl as (select doc_id as chunk_id, coalesce(len({_T.format('text')}), 0) as dl from documents), st as (select count(*) as n, avg(dl) as avgdl, greatest(0.5, least(1.5, avg(dl) / 100)) as a, 1 / ln(1 + count(*)) as b from dl),
q as (select distinct query_id, unnest({_T.format('text')}) as term from two), sz as (select query_id, count(*) as terms from q group by all),
t as (select term, count(*) as df, sum(-(1 / (1 + exp(-tf))) * ln(1 / (1 + exp(-tf)))) as e from tf where term in (select term from q) group by term),
r0 as (select query_id, term, df, coalesce(e / nullif(max(e) over (partition by query_id), 0), 0) as e from q join t using (term)),
r as (select *, avg(e) over (partition by query_id) as mean_e, sum(e) over (partition by query_id) as sum_e, count(*) over (partition by query_id) as m from r0),
s as (select query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * (a + 1) / (tf + a * dl / avgdl + a * mean_e)) as s, count(*) as common, any_value(sum_e) as sum_e, any_value(m) as m, any_value(terms) as terms, any_value(n) as n, any_value(b) as b
from r join tf using (term) join dl using (chunk_id) join sz using (query_id), st group by query_id, chunk_id),
bmx as (select query_id, chunk_id, round((s + b * sum_e * common / terms) / (m * (ln(1 + (n - 0.5) / 1.5) + 1)), 6) as score from s)"""


@query("spr8_bmx", f"with two as (select item_id * 2 as query_id, text from benchmark union all select item_id * 2 + 1, array_to_string(list_reverse({_T.format('text')})[:8], ' ') from benchmark), {_BMX}, c as (select * from bmx qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 100), f as (select query_id // 2 as query_id, chunk_id, round(sum(case query_id % 2 when 0 then 0.7 else 0.3 end::double * score) + 1e-9, 5) as score from c group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from f qualify rank <= 10")
def spr8b(spark, sf):
    """A query and what a rewriter made of it (its last eight words), BMX scores weighted .7 and .3."""
    q = asked(spark, sf)
    last = F.array_join(F.slice(F.reverse(X.tokens(F.col("text"))), 1, 8), " ")
    two = q.select((F.col("query_id") * 2).alias("query_id"), "text").unionByName(q.select((F.col("query_id") * 2 + 1).alias("query_id"), last.alias("text")))
    r = S.bmx(chunks(spark, sf), two, 100)
    one = r.select(F.floor(F.col("query_id") / 2).alias("query_id"), "chunk_id", (F.when(F.col("query_id") % 2 == 0, 0.7).otherwise(0.3) * F.col("score")).alias("p"))
    return S.ranked(one.groupBy("query_id", "chunk_id").agg(F.round(F.sum("p") + 1e-9, 5).alias("score")), 10)  # ties of rounding go up


@query("hyb7_routed", f"with {TWO} select query_id, chunk_id, score, rank, 'dot' as strategy from dense where query_id % 200 = 0 union all select query_id, chunk_id, score, rank, 'cosine' from other where query_id % 200 <> 0")
def hyb7(spark, sf):
    a, b = _legs(spark, sf)
    routes = vector_queries(spark, sf).select("query_id", F.when(F.col("query_id") % 200 == 0, "dot").otherwise("cosine").alias("strategy"))
    return S.routed({"dot": a, "cosine": b}, routes)


_DIMS = "list_transform({t}, lambda t: ('0x' || left(md5(t), 4))::int % 64)"


@query("dns1_embedded", f"select item_id, list_transform(c, lambda x: round(x / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6)) as e from (select item_id, list_transform(range(64), lambda d: len(list_filter(h, lambda x: x = d))::double) as c from (select item_id, {_DIMS.format(t=_T.format('text'))} as h from benchmark))")
def dns1(spark, sf):
    """The stand-in for a text encoder."""
    return table(spark, sf, "benchmark").select("item_id", F.transform(S.embedded(F.col("text")), lambda x: F.round(x, 6)).alias("e"))


HEADS = "hm as (select vec_id // 50 as doc_id, vec_id // 5 as heading_id, i, avg(x::double) as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings) group by all), dm as (select doc_id, list(x order by i) as e from (select doc_id, i, avg(x) as x from hm group by all) group by doc_id)"


@query("dns5_document_search", f"with {HEADS} select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from (select a.vec_id as query_id, dm.doc_id as chunk_id, round(list_dot_product(a.embedding::double[], dm.e), 6) as score from embeddings a, dm where a.vec_id % 100 = 0) qualify rank <= 3")
def dns5(spark, sf):
    """Documents by the mean of their headings' means."""
    v = vectors(spark, sf).select(F.floor(F.col("chunk_id") / 50).alias("doc_id"), F.floor(F.col("chunk_id") / 5).alias("heading_id"), "embedding")
    d = R.mean_vectors(R.mean_vectors(v, ["doc_id", "heading_id"]), ["doc_id"]).withColumnRenamed("doc_id", "chunk_id")
    return S.dense(d, vector_queries(spark, sf), 3)


@query("agg2_document_vectors", f"with {HEADS} select doc_id, list_transform(e, lambda x: round(x, 6)) as e from dm")
def agg2(spark, sf):
    v = vectors(spark, sf).select(F.floor(F.col("chunk_id") / 50).alias("doc_id"), F.floor(F.col("chunk_id") / 5).alias("heading_id"), "embedding")
    return R.mean_vectors(R.mean_vectors(v, ["doc_id", "heading_id"]), ["doc_id"]).select("doc_id", R.rounded("embedding").alias("e"))


_GRAMS = "case when length({0}) >= 13 then list_distinct(list_transform(range(1, length({0}) - 11), lambda i: substr({0}, i, 13))) else [] end"


@query("dns6_near_filtered", f"with {DOT.replace('<= 10', '<= 30')}, t as (select doc_id, text from documents where doc_id in (select query_id from dense union select chunk_id from dense)), g as (select doc_id, {_GRAMS.format('text')} as g from t), f as (select query_id, chunk_id, score, dense.rank as r from dense join g a on a.doc_id = query_id join g b on b.doc_id = chunk_id where coalesce(len(list_intersect(a.g, b.g)) / nullif(len(list_distinct(list_concat(a.g, b.g))), 0), 0) < 0.8) select query_id, chunk_id, score, row_number() over (partition by query_id order by r) as rank from f qualify rank <= 10")
def dns6(spark, sf):
    """The best 3 k by vectors, without those whose text is nearly the query's own: the first k of the rest."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = S.dense(vectors(spark, sf), vector_queries(spark, sf), 30)
    return S.not_near(hits, t, t.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10)


def vector_index(spark, sf, cosine: bool = False, k: int = 10) -> V.VectorIndex:
    """The index of all embeddings of sf, tuned for searches of the k best, in the folder that driver and executors share."""
    index = V.VectorIndex(spark, scratch(spark, "vectors"))
    index.build(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), cosine, k=k)
    return index


@query("src15_vector_index")
def src15(spark, sf):
    """The best ten of every vector whose id is divisible by 100, from an index on disk; recall: tests/test_vectors.py."""
    return vector_index(spark, sf).search(vector_queries(spark, sf), 10)


@query("dns6_indexed")
def dns6b(spark, sf):
    """dns6 with the index on disk in place of a search of all vectors."""
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = vector_index(spark, sf, k=30).search(vector_queries(spark, sf), 30)
    return S.not_near(hits, t, t.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id"), 10)


_UNIT = "list_transform(c, lambda x: x / sqrt(list_sum(list_transform(c, lambda y: y * y))))"
_EMBED = "select id, " + _UNIT + " as e from (select id, list_transform(range(64), lambda d: len(list_filter(h, lambda x: x = d))::double) as c from (select id, {h} as h from {t}) where len(h) > 0)"
_H = _DIMS.format(t=_T.format("text"))


@query(
    "dns11_baselines",
    f"with q as ({_EMBED.format(h=_H, t='(select item_id as id, text from benchmark)')}), raw as ({_EMBED.format(h=_H, t='(select doc_id as id, text from documents)')}), "
    f"rich as ({_EMBED.format(h=_H, t="(select doc_id as id, lang || ' ' || source || ' ' || text as text from documents)")}), "
    "s as (select 'raw' as baseline, q.id as query_id, raw.id as chunk_id, round(list_dot_product(q.e, raw.e), 6) as score from q, raw union all select 'enriched', q.id, rich.id, round(list_dot_product(q.e, rich.e), 6) from q, rich), "
    "r as (select *, row_number() over (partition by baseline, query_id order by score desc, chunk_id) as rank from s qualify rank <= 10), "
    "rel as (select item_id as query_id, doc_id as chunk_id from benchmark b join documents d on contains(d.text, b.text) where b.text <> ''), "
    "f as (select baseline, query_id, min(rank) filter (rel.chunk_id is not null) as first from r left join rel using (query_id, chunk_id) where query_id in (select query_id from rel) group by all) "
    "select baseline, count(*) as queries, round(avg((first = 1)::int), 6) as hit_1, round(avg((first <= 5)::int), 6) as hit_5, round(avg(case when first < 1000000 then 1.0 / first else 0 end), 6) as mrr from (select baseline, query_id, coalesce(first, 1000000) as first from f) x(baseline, query_id, first) group by baseline",
)
def dns11(spark, sf):
    """Flat cosine search of raw and of enriched texts; relevant are the documents that hold the query's passage."""
    d, b = table(spark, sf, "documents"), asked(spark, sf)
    q = b.select("query_id", S.embedded(F.col("text")).alias("embedding"))
    # a passage is found by one automaton of all of them, in one pass over the texts
    found = P.scan(d.select(F.col("doc_id").alias("id"), "text"), b.select(F.col("text").alias("pattern")), words=False, first=True)
    exact = found.join(F.broadcast(b.select("query_id", F.col("text").alias("_q"))), F.col("surface") == F.col("_q"))
    relevant = exact.select("query_id", F.col("id").alias("chunk_id")).distinct()
    out = None
    for name, text in (("raw", F.col("text")), ("enriched", F.concat_ws(" ", "lang", "source", "text"))):
        hits = S.dense(d.select(F.col("doc_id").alias("chunk_id"), S.embedded(text).alias("embedding")), q, 10, cosine=True)
        first = hits.join(relevant, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
        own = relevant.select("query_id").distinct().join(first, "query_id", "left")
        hit = lambda n: F.round(F.avg(F.coalesce((F.col("first") <= n).cast("int"), F.lit(0))), 6)
        one = own.agg(F.count("*").alias("queries"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))
        one = one.select(F.lit(name).alias("baseline"), "*")
        out = one if out is None else out.unionByName(one)
    return out.where("queries > 0")


@query("dns8_hypothetical", "with m as (select vec_id // 100 * 100 as query_id, i, avg(x::double) as x from (select vec_id, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from embeddings where vec_id % 100 < 4) group by all), n as (select query_id, list(x order by i) as e from m group by query_id), u as (select query_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from n), s as (select query_id, vec_id as chunk_id, round(list_dot_product(u.e, embedding::double[]), 6) as score from u, embeddings) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 10")
def dns8(spark, sf):
    """Each query as the mean of four vectors, of unit length."""
    v = vectors(spark, sf).where("chunk_id % 100 < 4").select((F.floor(F.col("chunk_id") / 100) * 100).alias("query_id"), "embedding")
    return S.dense(vectors(spark, sf), S.hypothetical(v), 10)


@query("dns10_late_interaction", f"with {DOT.replace('<= 10', '<= 20')}, q as (select vec_id // 100 * 100 as query_id, vec_id as token, embedding::double[] as e from embeddings where vec_id % 100 < 3), c as (select vec_id // 4 as chunk_id, embedding::double[] as e from embeddings), p as (select distinct query_id, chunk_id // 4 as chunk_id from dense), b as (select p.query_id, p.chunk_id, token, max(list_dot_product(q.e, c.e)) as m from p join q using (query_id) join c using (chunk_id) group by all), s as (select query_id, chunk_id, round(sum(m), 6) as score from b group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 5")
def dns10(spark, sf):
    """The best of a dense search, ranked anew by the best of a chunk's four vectors for each of the query's three."""
    v = vectors(spark, sf)
    pairs = S.dense(v, vector_queries(spark, sf), 20).select("query_id", F.floor(F.col("chunk_id") / 4).alias("chunk_id")).distinct()
    q = v.where("chunk_id % 100 < 3").select((F.floor(F.col("chunk_id") / 100) * 100).alias("query_id"), F.col("chunk_id").alias("token"), "embedding")
    return S.ranked(S.max_sim(pairs, q, v.select(F.floor(F.col("chunk_id") / 4).alias("chunk_id"), "embedding")), 5)


@query("spr7_page_fields", f"with p as (select page_id as chunk_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading, regexp_replace(regexp_extract(html, '(?s)<p>(.*?)</p>', 1), '<[^>]*>', ' ', 'g') as first, regexp_replace(html, '<[^>]*>', ' ', 'g') as body, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) as code from pages), f as (select chunk_id, 3.0::double as w, heading as t from p union all select chunk_id, 2.0, first from p union all select chunk_id, 1.0, body from p union all select chunk_id, 0.5, code from p), c as (select chunk_id, w, term, count(*) as c from (select chunk_id, w, unnest({_T.format('t')}) as term from f) group by all), q as (select distinct item_id as query_id, unnest({_T.format('text')}) as term from benchmark), s as (select query_id, chunk_id, round(sum(w * ln(1 + c) * c / (c + 1)), 6) as score from c join q using (term) group by all) select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from s qualify rank <= 10")
def spr7b(spark, sf):
    """All four fields: heading 3, first paragraph 2, body 1, code 0.5."""
    plain = lambda c: F.regexp_replace(c, "<[^>]*>", " ")
    html = F.col("html")
    fields = [(3.0, F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)), (2.0, plain(F.regexp_extract(html, "(?s)<p>(.*?)</p>", 1))), (1.0, plain(html)), (0.5, F.regexp_extract(html, "(?s)<script>(.*?)</script>", 1))]
    rows = table(spark, sf, "pages").select(F.col("page_id").alias("chunk_id"), F.explode(F.array(*[F.struct(F.lit(w).alias("w"), t.alias("t")) for w, t in fields])).alias("f"))
    c = rows.select("chunk_id", "f.w", F.explode(X.tokens(F.col("f.t"))).alias("term")).groupBy("chunk_id", "w", "term").agg(F.count("*").alias("c"))
    q = asked(spark, sf).select("query_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))
    part = F.col("w") * F.log1p("c") * F.col("c") / (F.col("c") + 1)
    return S.ranked(c.join(S.small(q), "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(part), 6).alias("score")), 10)


WORDS = "regexp_extract_all(text, '[A-Z][a-z]{8,}')"


@query(
    "agg1_heading_rollup",
    f"""with c as (select d.doc_id as chunk_id, source as doc_id, lang as heading_id, doc_id * 10 as start_char, doc_id * 10 + n_chars as end_char, list_distinct({WORDS}) as k from documents d), k as (select doc_id, heading_id, start_char, end_char, unnest(k) as w from c),
kk as (select doc_id, heading_id, list(w order by encode(w)) as keywords from (select * from k qualify row_number() over (partition by doc_id, heading_id, lower(w) order by start_char, end_char) = 1) group by all),
m as (select source as doc_id, lang as heading_id, i, avg(x::double) as x from (select source, lang, unnest(embedding) as x, generate_subscripts(embedding, 1) as i from documents join embeddings on vec_id = documents.doc_id) group by all)
select s.doc_id, s.heading_id, s.start_char, s.end_char, s.n, keywords, length_entities, v.first from (select doc_id, heading_id, min(start_char) as start_char, max(end_char) as end_char, count(*) as n, 1::bigint as length_entities from c group by all) s left join kk using (doc_id, heading_id) left join (select doc_id, heading_id, round(x, 6) as first from m where i = 1) v using (doc_id, heading_id)""",
)
def agg1b(spark, sf):
    """Whole roll-up of chunks (documents) to headings (languages within sources): spans, keywords, entities, mean vector."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    d = table(spark, sf, "documents").join(e, "doc_id", "left")
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{8,}"), F.lit(0)))
    c = d.select(F.col("source").alias("doc_id"), F.col("lang").alias("heading_id"), (F.col("doc_id") * 10).alias("start_char"), (F.col("doc_id") * 10 + F.col("n_chars")).alias("end_char"), words.alias("keywords"), F.array(F.struct(F.lit("source").alias("label"), F.array("source", F.upper("source")).alias("texts"))).alias("entities"), "embedding")
    h = R.headings(c)
    return h.select("doc_id", "heading_id", "start_char", "end_char", "n", "keywords", F.size(F.flatten(F.col("entities.texts"))).cast("long").alias("length_entities"), F.round(F.get("embedding", F.lit(0)), 6).alias("first"))


@query("agg4_distinct_entities", "with t as (select conv_id, role, unnest(regexp_extract_all(text, '[A-Za-z]{8,}')) as w, turn from conversations), f as (select conv_id, role, w from t qualify row_number() over (partition by conv_id, role, lower(w) order by turn, w) = 1), g as (select conv_id, role, string_agg(w, ' ' order by encode(w)) as texts from f group by all) select conv_id, string_agg(role || ':' || texts, '; ' order by role) as entities from g group by conv_id")
def agg4(spark, sf):
    t = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("label"), "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{8,}"), F.lit(0))).alias("term"))
    e = R.distinct_entities(t.withColumn("o", F.struct("turn", "term")), ["conv_id"], "o")
    return e.select("conv_id", F.array_join(F.transform("entities", lambda x: F.concat(x["label"], F.lit(":"), F.array_join(x["texts"], " "))), "; ").alias("entities"))


@query("agg6_labels", "with t as (select page_id, regexp_extract_all(html, '</?([a-z]+)[ >]', 1) as l from pages), f as (select page_id, list_filter(l, lambda x, i: list_position(l, x) = i) as tags, l from t) select page_id, array_to_string(list_transform(list_filter(list_transform(tags, lambda x: left(x, 1)), lambda y, i: list_position(list_transform(tags, lambda x: left(x, 1)), y) = i), lambda y: y || ':' || array_to_string(list_filter(tags, lambda x: left(x, 1) = y), ',')), ' ') as labels from f")
def agg6(spark, sf):
    """Tags under their first letters: labels and texts in first-seen order."""
    tags = F.transform(F.regexp_extract_all("html", F.lit("</?([a-z]+)[ >]"), F.lit(1)), lambda x: F.struct(F.substring(x, 1, 1).alias("label"), x.alias("text")))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(R.labels_of(tags), lambda e: F.concat(e["label"], F.lit(":"), F.array_join(e["texts"], ","))), " ").alias("labels"))


@query("agg15_run_totals", f"select count(*) as files, sum(len(string_split(text, chr(10))))::bigint as chunks, sum(len({WORDS}))::bigint as entities, sum(len(list_distinct({WORDS})))::bigint as keywords, count(*) filter (n_chars < 500) as low_confidence, round(avg(n_chars / 1000), 6) as mean_seconds, min(n_chars / 1000) as min_seconds, max(n_chars / 1000) as max_seconds from documents")
def agg15(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[A-Z][a-z]{8,}"), F.lit(0))
    f = table(spark, sf, "documents").select(F.size(F.split("text", "\n")).cast("long").alias("n_chunks"), F.size(words).cast("long").alias("n_entities"), F.size(F.array_distinct(words)).cast("long").alias("n_keywords"), (F.col("n_chars") / 1000).alias("seconds"), (F.col("n_chars") < 500).alias("low_confidence"))
    return R.run_totals(f)


CONTEXT = SPARSE.replace("from documents)", "from cx)").replace("from documents),", "from cx),").replace("as dl from documents", "as dl from cx")


@query("hyb6_contextual", f"with cx as (select doc_id, 'A text in ' || lang || ' of ' || source || ': ' || left(text, 60) || ' ' || text as text from documents), {CONTEXT} select query_id, chunk_id, score, rank from sparse")
def hyb6(spark, sf):
    """Chunks searched with a sentence of context before them: what they are of, and how they begin."""
    context = F.concat(F.lit("A text in "), "lang", F.lit(" of "), "source", F.lit(": "), F.substring("text", 1, 60), F.lit(" "), "text")
    return S.bm25(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), context.alias("text")), asked(spark, sf), 10)
