"""The library behind a few verbs: pipelines of named steps, and an engine that ingests, indexes and searches batches of queries."""

from __future__ import annotations

import functools
import hashlib
import itertools
import logging
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslode.functions import extraction as E
from corpuslode.functions import text as X
from corpuslode.operators import index as I
from corpuslode.operators import rollup as R
from corpuslode.operators import search as S
from corpuslode.operators.chunking import chunked
from corpuslode.sources.versions import Manifests, VersionedTable

log = logging.getLogger("corpuslode")


class PipelineError(RuntimeError):
    """A step failed; the others were not run."""


class TypeValidationError(PipelineError):
    """A step does not get the columns that it needs."""


@dataclass(frozen=True)
class Step:
    """A named transformation; needs: columns it reads."""

    name: str
    process: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()


@dataclass
class Pipeline:
    """Steps added one by one, built once, then run on DataFrames; the first failure ends a run."""

    steps: list[Step] = field(default_factory=list)
    built: bool = False
    seconds: dict[str, float] = field(default_factory=dict)

    def add(self, name: str, process: Callable[[DataFrame], DataFrame], needs: Iterable[str] = ()) -> Pipeline:
        if self.built:
            raise PipelineError("a built pipeline takes no more steps")
        self.steps.append(Step(name, process, tuple(needs)))
        return self

    def build(self) -> Pipeline:
        if not self.steps:
            raise PipelineError("an empty pipeline can't be built")
        self.built = True
        return self

    def run(self, df: DataFrame) -> DataFrame:
        if not self.built:
            raise PipelineError("build() comes before run()")
        for s in self.steps:
            lacking = [c for c in s.needs if c not in df.columns]
            if lacking:
                raise TypeValidationError(f"{s.name}: no column {', '.join(lacking)}")
            began = time.time()
            try:
                df = s.process(df)
            except Exception as e:
                raise PipelineError(f"{s.name}: {e}") from e
            self.seconds[s.name] = time.time() - began
            log.debug("planned %s in %.3f s", s.name, self.seconds[s.name])
        return df


class TextModel(Protocol):
    """A language model behind a column expression."""

    def __call__(self, prompt: Column) -> Column: ...


def identity(prompt: Column) -> Column:
    """The stand-in for a model that rewrites: the text itself."""
    return prompt


#: The first pattern that a model's name matches names its provider.
PROVIDERS = [("ollama", r"^(?:ollama/|llama|qwen|mistral|phi)"), ("gemini", r"^gemini"), ("other", r"")]


def provider(name: str) -> str:
    return next(p for p, pattern in PROVIDERS if re.search(pattern, name, re.IGNORECASE))


def rewritten(queries: DataFrame, model: TextModel = identity) -> DataFrame:
    """queries with `text` as the model gives it; an empty or null answer leaves the query as it is."""
    new = F.trim(model(F.col("text")))
    return queries.withColumns({"original": F.col("text"), "text": F.when(F.coalesce(new, F.lit("")) != "", new).otherwise(F.col("text"))})


def entities_of(text: Column, label: str = "technology") -> Column:
    """The stand-in for a tagger: identifiers of a text under one label."""
    return F.transform(X.heuristic_terms(text), lambda t: F.struct(t.alias("text"), F.lit(label).alias("label")))


def processed(docs: DataFrame, chunker: str = "heading", **options: int) -> DataFrame:
    """Chunks of docs (doc_id, text) with keywords, entities and the enriched text that is indexed."""
    rows = chunked(docs, chunker, **options).withColumn("entities", entities_of(F.col("text")))
    keys = R.keywords(rows.select(F.struct("doc_id", "chunk_index").alias("doc_id"), "text"), 10)
    keys = keys.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda s: s["keyword"]).alias("keywords")).select("doc_id.*", "keywords")
    rows = rows.join(keys, ["doc_id", "chunk_index"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))
    rows = rows.withColumn("entities", R.labels_of(F.col("entities")))
    return rows.withColumn("enriched", X.enriched(F.col("text"), F.col("keywords"), F.col("entities")))


def prompts(examples: DataFrame, preview: int = 800) -> DataFrame:
    """(query_id, prompt) of ranked examples (query_id, rank, text, answer) and each query's own text: previews, best first."""
    shot = F.concat(F.lit("TEXT: "), F.substring("text", 1, preview), F.lit("\nTERMS: "), F.coalesce("answer", F.lit("")))
    rows = examples.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", shot.alias("shot")))).alias("s"))
    return rows.select("query_id", F.array_join(F.transform("s", lambda x: x["shot"]), "\n---\n").alias("prompt"))


def cache_key(content: Column, kind: str, model: str) -> Column:
    """The first 16 digits of a hash of content, enrichment and model."""
    return F.substring(F.sha2(F.concat_ws("|", content, F.lit(kind), F.lit(model)), 256), 1, 16)


def cached(rows: DataFrame, cache: DataFrame, kind: str, model: str, enrich: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with `value`, what is new in the cache): enrich() sees only contents that the cache (key, value) lacks."""
    keyed = rows.withColumn("key", cache_key(F.col("text"), kind, model))
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache, "key", "left_anti")
    new = enrich(missing).select("key", "value")
    return keyed.join(cache.select("key", "value").unionByName(new), "key", "left").drop("key"), new


def grid(spark: SparkSession, **options: list) -> DataFrame:
    """Every combination of the options as a row of strings, with `config_id`: a hash of it."""
    names = sorted(options)
    rows = [tuple(map(str, x)) for x in itertools.product(*(options[n] for n in names))]
    rows = [(hashlib.sha256("|".join(f"{n}={v}" for n, v in zip(names, x)).encode()).hexdigest()[:12], *x) for x in rows]
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in ["config_id", *names]))


#: Chunks that a document can have.
ID_CHUNKS = 1_000_000


class SearchEngine:
    """Chunks, headings and documents in versioned tables below a path, a sparse index beside them, and batches of queries over both.

    The engine's own manifest names one version of each table and of the index, so a reader never sees a part of an ingest.
    """

    TABLES = ("chunks", "headings", "documents")

    def __init__(self, spark: SparkSession, path: str, chunker: str = "heading", embed: Callable[[Column], Column] = S.embedded, rewrite: TextModel = identity) -> None:
        self.spark, self.path, self.chunker, self.embed, self.rewrite = spark, path.rstrip("/"), chunker, embed, rewrite
        self.manifests = Manifests(spark, f"{self.path}/engine")

    def _versions(self, name: str) -> VersionedTable:
        """A table as the engine names it, so that what a broken-off ingest left is not built upon."""
        return VersionedTable(self.spark, f"{self.path}/{name}", ["doc_id"], version=self.manifests.read().get(name))

    def _table(self, name: str) -> DataFrame:
        return self._versions(name).read()

    @property
    def sparse(self) -> I.Bm25Index:
        return I.Bm25Index(self.spark, f"{self.path}/index", version=self.manifests.read().get("index"))

    def _chunks(self, docs: DataFrame) -> DataFrame:
        rows = processed(docs, self.chunker).withColumn("embedding", self.embed(F.col("enriched")))
        fits = (F.col("chunk_index") < ID_CHUNKS) & (F.abs("doc_id") < (1 << 63) // ID_CHUNKS - 1)
        pos = F.when(fits, F.col("doc_id") * F.lit(ID_CHUNKS) + F.col("chunk_index")).otherwise(F.raise_error(F.lit("a doc_id or a number of chunks is too large for a chunk_id")).cast("long"))
        return rows.withColumns({"chunk_id": pos, "heading_id": F.concat_ws("#", F.col("doc_id").cast("string"), F.coalesce("heading", F.lit("(root)")))})

    @staticmethod
    def _headings(chunks: DataFrame) -> DataFrame:
        return R.headings(chunks.select("doc_id", "heading_id", "start_char", "end_char", "keywords", "entities", "embedding"))

    @staticmethod
    def _indexed(chunks: DataFrame) -> DataFrame:
        return chunks.select("chunk_id", F.col("enriched").alias("text"))

    def _put(self, docs: DataFrame, put: Callable[[VersionedTable, DataFrame], int], into: Callable[[I.Bm25Index, DataFrame], None], only: bool) -> None:
        """Writes docs' rows to the three tables and the index, then names all four new versions at once.

        only: docs are all that the tables then have; else their rows are read back by their ids.
        """
        base, names = self.manifests.latest(), {}
        ids = docs.select("doc_id").distinct()

        def written(name: str, rows: DataFrame) -> DataFrame:
            t = self._versions(name)
            names[name] = put(t, rows)
            return t.read(names[name]) if only else t.read(names[name]).join(ids, "doc_id", "left_semi")

        chunks = written("chunks", self._chunks(docs))
        written("documents", R.documents(written("headings", self._headings(chunks))))
        index = self.sparse
        into(index, self._indexed(chunks))
        self.manifests.publish(base, {**names, "index": index.manifests.latest()})

    def ingest(self, docs: DataFrame) -> None:
        """docs (doc_id, text), chunked, enriched, embedded, and rolled up to headings and documents; replaces what was there."""
        self._put(docs, lambda t, rows: t.replace(rows), lambda index, rows: index.index(rows), True)

    def batch_ingest(self, docs: DataFrame) -> None:
        """Adds docs (doc_id, text), or puts them in place of those with their ids.

        Only buckets with these documents are written again, and the index gets a segment of their chunks.
        """
        if not self.manifests.latest():
            return self.ingest(docs)
        ids = docs.select("doc_id")
        old = self._table("chunks").join(ids.distinct(), "doc_id", "left_semi").select("chunk_id")
        return self._put(docs, lambda t, rows: t.upsert(rows, ids), lambda index, rows: index.add(rows, old), False)

    def ingest_document(self, doc_id: int, text: str) -> None:
        self.batch_ingest(self.spark.createDataFrame([(doc_id, text)], "doc_id long, text string"))

    def delete(self, ids: DataFrame) -> None:
        """The documents of ids (doc_id) go, with all that belongs to them."""
        base, index = self.manifests.latest(), self.sparse
        old = self._table("chunks").join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("chunk_id")
        index.delete(old)
        names = {name: self._versions(name).delete(ids) for name in self.TABLES}
        self.manifests.publish(base, {**names, "index": index.manifests.latest()})

    def rebuild_index(self) -> None:
        """The index as one segment."""
        base, index = self.manifests.latest(), self.sparse
        index.index(self._indexed(self._table("chunks")))
        self.manifests.publish(base, {**self.manifests.read(base), "index": index.manifests.latest()})

    def is_indexed(self) -> bool:
        return self.manifests.latest() > 0 and self.sparse.document_count() > 0

    def status(self) -> dict:
        ready = self.is_indexed()
        return {"indexed": ready, "chunks": self._table("chunks").count() if ready else 0, "documents": self._table("documents").count() if ready else 0}

    def get_chunk(self, chunk_id: int) -> DataFrame:
        return self._table("chunks").where(F.col("chunk_id") == chunk_id)

    def _asked(self, queries: DataFrame, rewrite: bool) -> DataFrame:
        own = rewritten(queries, self.rewrite) if rewrite else queries.withColumn("original", F.col("text"))
        keys, text = X.expansions(F.col("text"))
        # the new text gets a name of its own first: within a select, lambdas would read it in place of the old one
        own = own.select("query_id", "original", text.alias("_text"), keys.alias("expansions"))
        return own.select("query_id", "original", F.col("_text").alias("text"), (F.size("expansions") > 0).alias("expanded"), "expansions").withColumn("embedding", self.embed(F.col("text")))

    def retrieve(self, queries: DataFrame, k: int = 5, use_rewrite: bool = False, use_rerank: bool = False, sparse_only: bool = False, explain: bool = False) -> DataFrame:
        """The k best chunks of each of queries (query_id, text), with content; explain keeps the legs' scores and ranks."""
        if not 1 <= k <= 100:
            raise ValueError("k is from 1 to 100")
        if not self.is_indexed():
            raise RuntimeError("nothing is indexed")
        q, c = self._asked(queries, use_rewrite), self._table("chunks")
        hits = S.adaptive(c.select("chunk_id", "text", "embedding"), q, 5 * k if use_rerank else k, self.sparse.search, sparse_only)
        if use_rerank:
            hits = S.reranked(hits, c.select("chunk_id", "text"), q.select("query_id", F.col("original").alias("text")), k)
        out = hits.join(c.select("chunk_id", "doc_id", "heading", "text"), "chunk_id").join(S.small(q.select("query_id", "original", "expansions")), "query_id")
        score = F.col("rerank_score") if use_rerank else F.col("rrf_score")
        plain = ["query_id", "rank", "chunk_id", "doc_id", "heading", "text"]
        if not explain:
            return out.select(*plain, score.alias("score"))
        mode = F.lit("sparse_only" if sparse_only else "hybrid")
        return out.select(*plain, score.alias("score"), "bm25_score", "bm25_rank", "semantic_score", "semantic_rank", "rrf_score", *(["rerank_score"] if use_rerank else []), "original", "expansions", mode.alias("retrieval_mode"))

    def _groups(self, name: str, key: str, queries: DataFrame, k: int) -> DataFrame:
        rows = self._table(name).withColumn("chunk_id", F.xxhash64(F.col(key).cast("string")))
        q = queries.select("query_id", self.embed(F.col("text")).alias("embedding"))
        return S.dense(rows, q, k).join(rows.select("chunk_id", key), "chunk_id").select("query_id", key, "score", "rank")

    def retrieve_headings(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Headings by the dot product of their mean vectors with the raw query's."""
        return self._groups("headings", "heading_id", queries, k)

    def retrieve_documents(self, queries: DataFrame, k: int = 5) -> DataFrame:
        return self._groups("documents", "doc_id", queries, k)


def timed(f: Callable) -> Callable:
    """f with its duration in the log."""

    @functools.wraps(f)
    def run(*a, **b):  # noqa: ANN002, ANN003
        began = time.time()
        try:
            return f(*a, **b)
        finally:
            log.info("%s took %.3f s", f.__name__, time.time() - began)

    return run


__all__ = ["E", "Pipeline", "PipelineError", "SearchEngine", "TypeValidationError", "cached", "grid", "processed", "prompts", "provider", "rewritten", "timed"]
