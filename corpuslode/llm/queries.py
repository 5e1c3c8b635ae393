"""The queries op1_ to op13_: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuslode.llm import block_max, cws, divergence, first_fit, langid, lattice, nbsvm, orc_tokens, packing, pieces, simhash, substring_log, suffix_array
from corpuslode.llm.common import documents, new_path, prepare


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir), ids=False)


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicate(documents(spark, sf_dir)).drop("kept")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "orc-tokens")
    orc_tokens.write(documents(spark, sf_dir), path)
    return orc_tokens.digests(orc_tokens.read(spark, path))


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.fingerprints(documents(spark, sf_dir))


def op8_substring_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_log.deduplicate(documents(spark, sf_dir)).drop("kept")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "block-max")
    block_max.write(documents(spark, sf_dir), path)
    return block_max.search(spark, path, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


def op13_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_fit.pack(documents(spark, sf_dir))


def queries() -> dict:
    return {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """The others hash, sort, train or encode in ways that SQL lacks; tests/llm holds them against brute force."""
    return {
        "op2_embedding_near_dedup": """
with recursive v as (
  select vec_id, label, embedding::double[] as e,
         embedding is not null and label is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0)) as usable
  from embeddings),
pairs as (
  select a.vec_id as a, b.vec_id as b
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where a.usable and b.usable and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (
  select vec_id as a, vec_id as b from v
  union
  select reach.a, pairs.b from reach join pairs on reach.b = pairs.a),
root as (select a, min(b) as component_id from reach group by a),
degree as (select a, count(*) as n from pairs group by a)
select v.vec_id, coalesce(degree.n, 0)::bigint as n_links, root.component_id, v.vec_id = root.component_id as kept
from v join root on root.a = v.vec_id left join degree on degree.a = v.vec_id
""",
        "op11_block_max_search": r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents where text is not null),
n as (select r, doc_id, len(terms)::bigint as n from d where len(terms) > 0),
stats as (select count(*)::bigint as docs, sum(n)::bigint as total from n),
tf as (select r, term, count(*)::bigint as tf from (select r, unnest(terms) as term from d) group by all),
item as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from benchmark where text is not null),
w as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from tf, stats where term in (select term from item) group by term),
s as (
  select item_id, r, any_value(n.doc_id) as doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * docs) // total))))::bigint as score
  from item join w using (term) join tf using (term) join n using (r), stats group by item_id, r)
select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls first)::int as rank, doc_id, score
from s where score > 0 qualify rank <= 10
""",
        "op12_source_divergence": r"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
w as (select r, lang, source, unnest(terms) as term from d),
kept as (select lang, term from (select distinct r, lang, term from w) group by all having count(*) >= 30),
vocab as (select lang, count(*) as v from kept group by lang),
n as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by all),
g as (select distinct lang, source from d),
sized as (select g.lang, g.source, coalesce(sum(n.n), 0)::hugeint + 5 * coalesce(any_value(v), 0) as size from g left join n using (lang, source) left join vocab using (lang) group by all),
lang_sized as (select lang, sum(n)::hugeint + 5 * any_value(v) as size from n join vocab using (lang) group by lang),
p as (
  select s.lang, s.source, kept.term, coalesce(n.n, 0) as n, 1 + (1000000000 * (coalesce(n.n, 0) + 5)::hugeint) // s.size as p
  from sized s join kept using (lang) left join n on n.lang = s.lang and n.source = s.source and n.term = kept.term),
q as (
  select n.lang, n.term, 1 + (1000000000 * (sum(n.n) + 5)::hugeint) // any_value(l.size) as q
  from n join lang_sized l using (lang) group by n.lang, n.term),
pair as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(any_value(f.value), 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source as a, y.source as b, sum(abs(x.p - y.p)) as value
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) f
    on f.lang = a.lang and f.a = a.source and f.b = b.source
  group by all),
term as (
  select lang, source, 'term' as part, term as item, (p.p - q.q)::bigint as value
  from p join q using (lang, term) where p.n > 0 and p.p > q.q)
select lang, source, part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pair
union all
select *, row_number() over (partition by lang, source order by value desc, item)::int as rank from term qualify rank <= 50
""",
    }
