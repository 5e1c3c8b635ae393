"""Queries of the engine's parts: links, side outputs, envelopes, updates, prompts, caches, grids, summary trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslode import engine as G
from corpuslode.operators import search as S
from corpuslode.operators import tree as T
from corpuslode.plans.registry import query, table
from corpuslode.plans.search_queries import DOT, vector_queries, vectors
from corpuslode.sources import sinks, tables
from corpuslode.streaming.ingest import read_messages


@query("src14_links", "with l as (select page_id, regexp_extract_all(html, 'href=\"([^\"]+)\"', 1) as l from pages) select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ' ') as links from l")
def src14(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))), " ").alias("links"))


@query(
    "src9_messages",
    """select conv_id, turn, case when turn % 5 = 4 then null else 'c' || conv_id end as source_file from conversations""",
)
def src9(spark, sf):
    """Messages read in bulk: some in envelopes, some bare, bad JSON with a null record."""
    record = F.to_json(F.struct(F.concat(F.lit("c"), "conv_id").alias("source_file"), F.array().cast("array<struct<heading:string>>").alias("headings")))
    raw = F.when(F.col("turn") % 5 == 4, F.concat(F.lit("{ broken "), "text")).when(F.col("turn") % 2 == 0, F.concat(F.lit('{"message_id": "1", "payload": '), record, F.lit("}"))).otherwise(record)
    rows = table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    good = read_messages(rows).withColumn("file", F.when(F.col("record._bad").isNull(), F.col("record.source_file")))
    return good.select("conv_id", "turn", F.col("file").alias("source_file"))


def _records(spark, sf):
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.round(F.col("n_chars") / 3000, 6).alias("avg_confidence"), (F.col("n_chars") < 600).alias("is_low_confidence"))


@query("snk6_manifest", "with r as (select source || '/' || doc_id || '.txt' as path, round(n_chars / 3000, 6) as c, n_chars < 600 as low from documents) select count(*) as total, count(*) filter (low) as low, string_agg(path, ',' order by c, path) filter (low) as files from r")
def snk6(spark, sf):
    m = sinks.manifest(_records(spark, sf))
    return m.select("total", "low", F.array_join(F.transform("files", lambda f: f["path"]), ",").alias("files"))


@query("snk7_envelopes", "select doc_id::varchar as key, 'corpus' as source_service, doc_id, lang, octet_length(encode(text)) > 1100000 as large from documents")
def snk7(spark, sf):
    """Documents through envelopes and back: what the payload holds; the envelope's id and time differ each time."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    e = sinks.envelopes(d, "corpus", "doc_id")
    back = sinks.opened(e, "struct<doc_id:bigint,lang:string,text:string>")
    return back.select(F.col("payload.doc_id").cast("string").alias("key"), "source_service", "payload.doc_id", "payload.lang", (F.octet_length("payload.text") > 1_100_000).alias("large"))


@query("snk2_updated", "select doc_id, case when doc_id % 3 = 0 then 'new' else lang end as lang, case when doc_id % 6 = 0 then 0 else n_chars end as n_chars from documents")
def snk2(spark, sf):
    """New values over old ones where there are some."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    new = d.where("doc_id % 3 = 0").select("doc_id", F.lit("new").alias("lang"), F.when(F.col("doc_id") % 6 == 0, 0).cast("long").alias("n_chars"))
    return tables.updated(d, new, ["doc_id"])


@query("api11_prompts", f"with {DOT}, s as (select query_id, rank, 'TEXT: ' || left(text, 800) || chr(10) || 'TERMS: ' || coalesce(lang, '') as shot from dense join documents on doc_id = chunk_id where rank <= 3) select query_id, string_agg(shot, chr(10) || '---' || chr(10) order by rank) as prompt from s group by query_id")
def api11(spark, sf):
    """Few-shot prompts of the nearest documents, their languages as answers."""
    hits = S.dense(vectors(spark, sf), vector_queries(spark, sf), 3)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("answer"))
    return G.prompts(hits.join(d, "chunk_id"))


@query("api13_cache", "select doc_id, case when doc_id % 4 = 0 then 'old' else 'n' || length(text) end as value from (select doc_id, text from documents where text is not null)")
def api13(spark, sf):
    """Every fourth document's enrichment is in the cache; the others are made, each content once."""
    d = table(spark, sf, "documents").where("text is not null").select("doc_id", F.concat("text", F.lit("#"), F.when(F.col("doc_id") % 4 == 0, "a").otherwise("b")).alias("text"))
    have = d.where("doc_id % 4 = 0").select(G.cache_key(F.col("text"), "length", "stub").alias("key"), F.lit("old").alias("value")).distinct()
    made = lambda rows: rows.withColumn("value", F.concat(F.lit("n"), F.length("text") - 2))
    out, _ = G.cached(d, have, "length", "stub", made)
    return out.select("doc_id", "value")


@query("api14_grid", "select k, strategy, run from (values ('5'), ('10')) k(k), (values ('flat'), ('lod'), ('tree')) s(strategy), (values ('1'), ('2')) r(run)")
def api14(spark, sf):
    return G.grid(spark, k=[5, 10], strategy=["flat", "lod", "tree"], run=[1, 2]).select("k", "strategy", "run")


def _leaves(spark, sf):
    t = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.join(t, "vec_id", "left").select(F.col("vec_id").alias("node_id"), F.coalesce("text", F.lit("")).alias("text"), "embedding")


@query("hie4_tree_layers")
def hie4(spark, sf):
    """Nodes of each layer of a summary tree; mixtures are fitted iteratively, so there is no SQL."""
    return T.build(_leaves(spark, sf), layers=2, most=4).groupBy("layer").agg(F.count("*").alias("n"), F.sum(F.size("parents")).alias("parents"))


@query("hie5_collapsed_search")
def hie5(spark, sf):
    return T.collapsed(T.build(_leaves(spark, sf), layers=2, most=4), vector_queries(spark, sf), 5)


@query("str36_parsed_answers", "select conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(x)), '|') as terms from conversations")
def str36(spark, sf):
    """Answers as JSON (even turns) or as lists of lines: the same terms come back."""
    from corpuslode.functions.extraction import parsed_terms

    lines = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here: "), F.to_json(F.struct(lines.alias("terms"))))).otherwise(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(parsed_terms(answer), "|").alias("terms"))


_FENCED = "case doc_id % 3 when 0 then '```' || text || '```' || text when 1 then text || ' ```x = 1```' else text end"


@query("str23_code_rule", f"with t as (select doc_id, {_FENCED} as t from documents), r as (select doc_id, t, coalesce(list_sum(list_transform(regexp_extract_all(t, '(?s)```.*?```'), lambda x: length(x))), 0) / nullif(length(t), 0) as ratio from t) select doc_id, round(coalesce(ratio, 0), 6) as ratio, case when length(k) >= 50 then md5(k) end as kept from (select *, trim(case when coalesce(ratio, 0) > 0.3 then regexp_replace(t, '(?s)```.*?```', ' ', 'g') else t end) as k from r)")
def str23b(spark, sf):
    """Code fences of texts made to hold some: their share, and what is left for keywords."""
    from corpuslode.functions import text as X

    i = F.col("doc_id") % 3
    t = F.when(i == 0, F.concat(F.lit("```"), "text", F.lit("```"), "text")).when(i == 1, F.concat("text", F.lit(" ```x = 1```"))).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.round(X.code_ratio(F.col("t")), 6).alias("ratio"), F.md5(X.without_code(F.col("t"))).alias("kept"))


@query(
    "snk1_versions",
    "with one as (select doc_id, source, n_chars from documents), two as (select doc_id, case when doc_id % 3 = 0 then 'new' else source end as source, n_chars from documents union all select doc_id + 1000000, 'new', null from documents where doc_id % 10 = 0), "
    "three as (select doc_id, source, case when doc_id % 4 = 0 then -1 else n_chars end as n_chars from two where doc_id % 7 <> 0) "
    "select 1 as version, count(*) as n, count(n_chars) as known, sum(doc_id)::bigint as ids, count(*) filter (source = 'new') as new, sum(n_chars)::bigint as chars from one union all select 2, count(*), count(n_chars), sum(doc_id)::bigint, count(*) filter (source = 'new'), sum(n_chars)::bigint from two union all select 4, count(*), count(n_chars), sum(doc_id)::bigint, count(*) filter (source = 'new'), sum(n_chars)::bigint from three",
)
def snk1b(spark, sf):
    """A table with versions: written, upserted, then partly deleted and updated; three of its versions read at the end."""
    from corpuslode.operators.scratch import scratch
    from corpuslode.sources.versions import VersionedTable

    t, d = VersionedTable(spark, scratch(spark, "versions"), ["doc_id"], 16), table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    t.replace(d)
    changed = d.where("doc_id % 3 = 0").withColumn("source", F.lit("new"))
    t.upsert(changed.unionByName(d.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit("new").alias("source")), allowMissingColumns=True))
    t.delete(t.read().where("doc_id % 7 = 0").select("doc_id"))
    t.update(t.read().where("doc_id % 4 = 0").select("doc_id", F.lit(-1).cast("long").alias("n_chars")))
    out = None
    for v in (1, 2, 4):
        new = F.col("source") == "new"
        one = t.read(v).agg(F.count("*").alias("n"), F.count("n_chars").alias("known"), F.sum("doc_id").alias("ids"), F.count_if(new).alias("new"), F.sum("n_chars").alias("chars")).select(F.lit(v).alias("version"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_KEY = "'d' || doc_id || '_' || left(md5(doc_id::varchar), 6)"


@query("snk3_cascade", f"with d as (select {_KEY} as doc_id, doc_id as n from documents) select (select count(*) from d where n % 10 <> 0) as documents, (select count(*) from d where n % 10 <> 0) * 2 as headings, (select count(*) from d where n % 10 <> 0) * 6 as chunks, (select count(*) from d where n % 10 = 0) as deleted")
def snk3b(spark, sf):
    """Documents by the hash that ends their ids, with their headings and chunks. The whole hash: six digits of it are shared
    by several of some ten thousand documents, and all of them would go."""
    key = F.concat(F.lit("d"), "doc_id", F.lit("_"), F.md5(F.col("doc_id").cast("string")))
    d = table(spark, sf, "documents").select(key.alias("doc_id"), F.col("doc_id").alias("n"))
    several = lambda n: d.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("k"))
    hashes = d.where("n % 10 = 0").select(F.expr("right(doc_id, 32)").alias("hash"))
    docs, heads, chunks, deleted = tables.delete_cascade(d, several(2), several(6), hashes)
    count = lambda t, name: t.agg(F.count("*").alias(name))
    return count(docs, "documents").join(count(heads, "headings")).join(count(chunks, "chunks")).join(deleted)


@query("met15_weighted_sums", "with w as (select i / 5.0::double as a, 1 - i / 5.0::double as b from range(6) r(i)), s as (select a, event_id % 2 as y, a * value + (1.0 - a) * user_id as s from events, w), k as (select a, y, rank() over (partition by a order by round(s, 6)) + (count(*) over (partition by a, round(s, 6)) - 1) / 2 as r from s) select round(a, 1) as weight, round((sum(r * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 4) as auc from k group by a")
def met15c(spark, sf):
    from corpuslode.operators import judgement as J

    e = table(spark, sf, "events").select((F.col("event_id") % 2).alias("y"), F.col("value").alias("a"), F.col("user_id").cast("double").alias("b"))
    return J.weighted_sums(e, ["a", "b"], "y").select(F.round(F.col("weights")[0], 1).alias("weight"), F.round("auc", 4).alias("auc"))
