"""Queries of the chunkers. Greedy folds that SQL can express as recursion have SQL; tests/test_chunking.py holds the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslode.operators.chunking import ENDS, STOPS, chunked
from corpuslode.plans.registry import query, table
from corpuslode.plans.text_queries import quoted

NAMES = {
    "chk2_heading": "heading",
    "chk3_sentences": "sentences",
    "chk6_recursive": "recursive",
    "chk7_paragraphs": "paragraphs",
    "chk8_heading_based": "heading_based",
    "chk9_heading_limited": "heading_limited",
    "chk10_heading_paragraph": "heading_paragraph",
    "chk13_markdown_semantic": "markdown_semantic",
    "chk14_cluster_semantic": "cluster_semantic",
    "chk15_clauses": "clauses",
}

for _query, _name in NAMES.items():
    query(_query)(lambda spark, sf, name=_name: chunked(table(spark, sf, "documents"), name))

_WORDS = "list_filter(string_split_regex(text, '\\s+'), lambda t: t <> '')"
_ENDS = " or ".join(f"ends_with(x, {quoted(e)})" for e in ENDS)
_CUT = "case when {s} + 384 < n then coalesce(list_max(list_filter(range({s} + 193, {s} + 385), lambda i: m[i])), {s} + 384) else n end"


@query(
    "chk5_fixed_size_sentences",
    f"""with recursive d as (select doc_id, w, len(w) as n, list_transform(w, lambda x: {_ENDS}) as m from (select doc_id, {_WORDS} as w from documents) where len(w) > 0),
c as (select doc_id, 0 as idx, 0::bigint as s, ({_CUT.format(s='0')})::bigint as e from d union all select d.doc_id, idx + 1, c.e, ({_CUT.format(s='c.e')})::bigint from c join d using (doc_id) where c.e < n)
select doc_id, idx as chunk_index, array_to_string(w[s + 1:e], ' ') as text from c join d using (doc_id)""",
)
def chk5s(spark, sf):
    """Windows of 0.75 x 512 words that end a sentence in their second half where they can; words joined by spaces."""
    c = chunked(table(spark, sf, "documents"), "fixed_size")
    return c.select("doc_id", "chunk_index", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("text"))


_LAST = "(case when contains(substr(b, {s} + 1, 1000), {d}) then length(substr(b, {s} + 1, 1000)) - strpos(reverse(substr(b, {s} + 1, 1000)), reverse({d})) - length({d}) + 1 else -1 end)"
_STOP = "case when {s} + 1000 < length(b) then (case " + " ".join(f"when {_LAST.replace('{d}', 'D' + str(i))} > 500 then {{s}} + {_LAST.replace('{d}', 'D' + str(i))} + {len(d)}" for i, d in enumerate(STOPS)) + " else {s} + 1000 end) else {s} + 1000 end"
for _i, _d in enumerate(STOPS):
    _STOP = _STOP.replace(f"D{_i}", quoted(_d).replace("\n", "' || chr(10) || '").join("()"))


@query(
    "chk18_sentence_windows",
    f"""with recursive d as (select doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) as b from documents where trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
c as (select doc_id, 0 as idx, 0::bigint as s, ({_STOP.format(s='0')})::bigint as e from d union all select d.doc_id, idx + 1, c.e - 200, ({_STOP.format(s='(c.e - 200)')})::bigint from c join d using (doc_id) where c.e - 200 < length(b))
select doc_id, idx as chunk_index, trim(substr(b, s + 1, e - s), ' ' || chr(9) || chr(10) || chr(13)) as text from c join d using (doc_id)""",
)
def chk18s(spark, sf):
    """Character windows that end after a sentence; these documents have no headings, so each is one section."""
    return chunked(table(spark, sf, "documents"), "windows").select("doc_id", "chunk_index", "text")


@query("chk2b_paragraphs", "with p as (select doc_id, l, unnest(range(1, len(l) + 1)) as k from (select doc_id, string_split_regex(text || chr(10) || ' ' || chr(10) || text, '\\n\\s*\\n') as l from documents)) select doc_id, k - 1 as idx, l[k] as text, (list_sum(list_transform(l[:k], lambda x: length(x))) - length(l[k]))::bigint as chars_before from p")
def chk2b(spark, sf):
    """Paragraphs between blank lines with the characters of the paragraphs before; each text twice, so that there are two."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\n \n"), "text"), r"\n\s*\n")).alias("idx", "text"))
    w = Window.partitionBy("doc_id").orderBy("idx")
    return d.select("doc_id", F.col("idx").cast("long").alias("idx"), "text", (F.sum(F.length("text")).over(w) - F.length("text")).alias("chars_before"))


@query(
    "chk12_ancestors",
    """with t as (select page_id, regexp_extract_all(replace(replace(html, '<p>', '<h2>'), '<li>', '<h3>'), '<h([1-6])>', 1) as l from pages), h as (select page_id, i as pos, l[i]::int as level from (select page_id, l, unnest(range(1, len(l) + 1)) as i from t))
select a.page_id, a.pos, a.level, coalesce((select string_agg(b.pos::varchar, '>' order by b.pos) from h b where b.page_id = a.page_id and b.pos < a.pos and b.level < a.level and not exists (select 1 from h c where c.page_id = a.page_id and c.pos > b.pos and c.pos < a.pos and c.level <= b.level)), '') as path,
coalesce((select c.level from h c where c.page_id = a.page_id and c.pos = a.pos + 1) <= a.level, true) as leaf from h a""",
)
def chk12b(spark, sf):
    """Ancestors and leaves of a page's headings; paragraphs and list items stand in for deeper levels."""
    from corpuslode.operators.headings import with_ancestors

    html = F.replace(F.replace("html", F.lit("<p>"), F.lit("<h2>")), F.lit("<li>"), F.lit("<h3>"))
    h = table(spark, sf, "pages").select("page_id", F.posexplode(F.regexp_extract_all(html, F.lit("<h([1-6])>"), F.lit(1))).alias("i", "l"))
    h = h.select("page_id", (F.col("i") + 1).cast("long").alias("pos"), F.col("l").cast("int").alias("level"))
    return with_ancestors(h, "page_id").select("page_id", "pos", "level", F.array_join(F.transform("ancestors", lambda x: x.cast("string")), ">").alias("path"), "leaf")
