"""Top-k search over block-max postings (Ding and Suel's Block-Max WAND, 2011), a shard of documents at a time.

An index is a table of rows. A shard, some thousands of documents of one task, has a row with its documents (term null) and a
row for every block of up to 128 postings of a term, with the first and the last place, the greatest frequency, the least
length, and the greatest impact where that is known. Postings are gaps and frequencies in as few bytes as a block needs. A
shard's documents stand in ascending length, so that blocks have like lengths and their bounds are tight.

A search deals the blocks of the queries' terms by shard. Per query, shallow pointers step over the blocks' borders without
decompressing: between two borders the blocks under the pointers bound every score. Ranges of the greatest bounds are scored
first; no block is decompressed unless a range that it covers can still reach the k-th best score, which a task keeps from
shard to shard. So the result is exact, and most blocks of frequent terms are never opened.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Postings of a block; documents and postings of a shard, which end it; (query, term) of a query set that go to every task.
BLOCK, SHARD_DOCS, SHARD_POSTINGS, MOST_TERMS = 128, 1 << 14, 1 << 22, 200_000
#: Blocks of a term in a shard up to which its postings are read before any range is bounded.
FEW = 2
#: Stands for a null id within a shard's row; it comes first and comes back as null.
NULL_ID = -(1 << 63)
#: total: a term's occurrences in the block, or the sum of the shard's lengths. docs, freqs: see packed(); of a shard's row
#: the 64-bit ids and 32-bit lengths of its documents.
SCHEMA = "shard long, term string, first int, last int, n int, peak long, least long, impact long, total long, docs binary, freqs binary"
_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]

#: (frequencies, lengths) to impacts; grows with the frequency, shrinks with the length, 0 at least
Impact = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: A column of texts to (values of all terms, where each text's terms begin and end in them)
Splitter = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


class Hits(NamedTuple):
    ids: np.ndarray
    scores: np.ndarray


def listed(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A Splitter for a column that already lists each text's terms; a null list is empty."""
    lengths = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths)])


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Unsigned values, block by block from starts on, each block in 1, 2 or 4 bytes a value: as few as its greatest needs."""
    most = np.maximum.reduceat(values, starts)
    width = np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4))
    n = np.diff(np.append(starts, len(values)))
    raw = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4)
    flat = raw[np.arange(4)[None, :] < np.repeat(width, n)[:, None]]
    offsets = np.concatenate([[0], np.cumsum(width * n)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64)


class _Shard:
    """Documents and postings that a task has gathered."""

    def __init__(self) -> None:
        self.codes: dict = {}
        self.docs, self.held = 0, 0
        self.ids: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, values: pa.Array, bounds: np.ndarray) -> None:
        lengths = np.diff(bounds)
        coded = values.dictionary_encode()
        codes = self.codes
        own = np.array([codes.setdefault(t, len(codes)) for t in coded.dictionary.cast(pa.large_binary()).to_pylist()], np.int64)
        wide = max(1, len(own))
        doc = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
        key, freq = np.unique(doc * wide + coded.indices.to_numpy(), return_counts=True)
        self.parts.append((self.docs + key // wide, own[key % wide] if len(own) else key, freq))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.docs += len(ids)
        self.held += len(key)

    def add_blocks(self, rows: pa.Table, dead: list[int] | None) -> None:
        """The documents and postings of a shard's rows, without the places that are dead."""
        terms = rows.column("term").cast(pa.binary()).to_pylist()
        head = terms.index(None)
        ids = np.frombuffer(rows.column("docs")[head].as_py(), np.int64)
        lengths = np.frombuffer(rows.column("freqs")[head].as_py(), "<u4").astype(np.int64)
        alive = np.ones(len(ids), bool)
        alive[dead or []] = False
        number = np.cumsum(alive) - 1
        codes, doc, term, freq = self.codes, [], [], []
        for t, first, n, docs, freqs in zip(terms, *(rows.column(c).to_pylist() for c in ("first", "n", "docs", "freqs"))):
            if t is not None:
                places = first + np.cumsum(unpacked(docs, n))
                stay = alive[places]
                if stay.any():
                    doc.append(number[places[stay]])
                    freq.append(unpacked(freqs, n)[stay])
                    term.append(np.full(len(doc[-1]), codes.setdefault(t, len(codes)), np.int64))
        if doc:
            self.parts.append((self.docs + np.concatenate(doc), np.concatenate(term), np.concatenate(freq)))
            self.held += len(self.parts[-1][0])
        self.ids.append(ids[alive])
        self.lengths.append(lengths[alive])
        self.docs += int(alive.sum())

    def rows(self, shard: int, impact: Impact | None) -> Iterator[pa.RecordBatch]:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        order = np.lexsort((ids, lengths))
        ids, lengths = ids[order], lengths[order]
        zero, no = pa.array([0], pa.int32()), pa.array([0], pa.int64())
        first = [pa.array([shard]), pa.array([None], pa.binary()), zero, pa.array([len(ids) - 1], pa.int32()), pa.array([len(ids)], pa.int32()), no, no, no, pa.array([int(lengths.sum())]), pa.array([ids.tobytes()], pa.binary()), pa.array([lengths.astype("<u4").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(first, names=_COLUMNS)
        doc, term, freq = (np.concatenate(x) for x in zip(*self.parts)) if self.parts else [np.zeros(0, np.int64)] * 3
        if not len(doc):
            return
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        names = sorted(self.codes)
        rank = np.empty(len(names), np.int64)
        rank[[self.codes[t] for t in names]] = np.arange(len(names))
        doc, term = place[doc], rank[term]
        o = np.lexsort((doc, term))
        doc, term, freq = doc[o], term[o], freq[o]
        new = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        within = np.arange(len(doc)) - np.repeat(new, np.diff(np.append(new, len(doc))))
        starts = np.flatnonzero(within % BLOCK == 0)
        gaps = np.concatenate([[0], np.diff(doc)])
        gaps[starts] = 0
        n = np.diff(np.append(starts, len(doc)))
        most = np.maximum.reduceat(np.asarray(impact(freq, lengths[doc])), starts) if impact else np.zeros(len(starts))
        columns = [
            np.full(len(starts), shard), None, doc[starts].astype(np.int32), doc[starts + n - 1].astype(np.int32), n.astype(np.int32),
            np.maximum.reduceat(freq, starts), lengths[doc[starts]], most.astype(np.int64), np.add.reduceat(freq, starts),
        ]
        columns = [pa.array([names[t] for t in term[starts].tolist()], pa.binary()) if c is None else pa.array(c) for c in columns]
        table = pa.RecordBatch.from_arrays([*columns, packed(gaps, starts), packed(freq, starts)], names=_COLUMNS)
        for lo in range(0, table.num_rows, 20_000):
            yield table.slice(lo, 20_000)


def build(rows: DataFrame, split: Splitter = listed, impact: Impact | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The index of rows (id, terms): a document each; terms is what split takes. Nothing is shuffled.

    impact: what the greatest impact of a block is taken of (a whole number), if the collection's statistics are known and
    stay; without it a search takes bounds from the greatest frequency and the least length, which hold under any statistics.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 20, _Shard()
        for b in it:
            column = b.column("terms")
            for lo in range(0, b.num_rows, shard_docs):
                part = b.slice(lo, shard_docs)
                held.add(part.column("id").fill_null(NULL_ID).to_numpy(), *split(column.slice(lo, part.num_rows)))
                if held.docs >= shard_docs or held.held >= SHARD_POSTINGS:
                    yield from held.rows(number, impact)
                    number, held = number + 1, _Shard()
        if held.docs:
            yield from held.rows(number, impact)

    out = rows.select(F.col("id").cast("long").alias("id"), "terms").mapInArrow(run, SCHEMA.replace("term string", "term binary"))
    return out.withColumn("term", F.col("term").cast("string"))


def _with_dead(index: DataFrame, gone: DataFrame | None) -> DataFrame:
    """index with `dead`: on a shard's row with its documents the places of gone (shard, places), null on the many blocks."""
    none = F.lit(None).cast("array<int>")
    if gone is None:
        return index.withColumn("dead", none)
    heads = index.where("term is null").join(gone.select("shard", F.col("places").alias("dead")), "shard", "left")
    return heads.unionByName(index.where("term is not null").withColumn("dead", none))


def merged(index: DataFrame, gone: DataFrame | None = None, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """The rows of index as fewer, larger shards, without the documents of gone (shard, places).

    Shards are dealt by a hash, about as many to a group as make one of shard_docs documents; a task holds the postings of
    one new shard. Texts are not needed.
    """
    docs = index.where("term is null").agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-docs // shard_docs))
    own = index.withColumn("deal", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    own = _with_dead(own, gone)
    tasks = min(groups, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = own.repartition(tasks, "deal").sortWithinPartitions("deal", "shard", "term", "first")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, deal = TaskContext.get().partitionId() << 20, _Shard(), None
        for rows in by_shard(it):
            own = rows.column("deal")[0].as_py()
            if held.docs and (own != deal or held.docs >= shard_docs or held.held >= SHARD_POSTINGS):
                yield from held.rows(number, None)
                number, held = number + 1, _Shard()
            deal = own
            held.add_blocks(rows, rows.column("dead")[0].as_py())  # the row with the documents comes first
        if held.docs:
            yield from held.rows(number, None)

    out = dealt.mapInArrow(run, SCHEMA.replace("term string", "term binary"))
    return out.withColumn("term", F.col("term").cast("string"))


def places(index: DataFrame, ids: DataFrame) -> DataFrame:
    """(shard, place, id, length) of the documents with those ids (id)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for shard, docs, freqs in zip(*(b.column(c).to_pylist() for c in ("shard", "docs", "freqs"))):
                own, lengths = np.frombuffer(docs, np.int64), np.frombuffer(freqs, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array(lengths)], names=["shard", "place", "id", "length"])

    every = index.where("term is null").select("shard", "docs", "freqs").mapInArrow(run, "shard long, place int, id long, length long")
    return every.join(ids.select(F.coalesce(F.col("id").cast("long"), F.lit(NULL_ID)).alias("id")).distinct(), "id", "left_semi")


def lowest(index: DataFrame, n: int, gone: DataFrame | None = None) -> DataFrame:
    """(id) of the n documents with the smallest ids; a shard leaves n rows at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for docs, dead in zip(b.column("docs").to_pylist(), b.column("dead").to_pylist()):
                ids = np.delete(np.frombuffer(docs, np.int64), dead or [])
                yield pa.RecordBatch.from_arrays([pa.array(np.sort(ids)[:n])], names=["id"])

    own = index.where("term is null").select("shard", "docs")
    own = own.join(gone.select("shard", F.col("places").alias("dead")), "shard", "left") if gone is not None else own.withColumn("dead", F.lit(None).cast("array<int>"))
    return own.mapInArrow(run, "id long").orderBy("id").limit(n)


def statistics(index: DataFrame) -> DataFrame:
    """One row: documents, documents with terms, terms with repeats, and the mean length."""
    own = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("terms"))
    return own.withColumn("mean", F.col("terms") / F.nullif(F.col("docs"), F.lit(0)))


def frequencies(index: DataFrame, terms: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """(term, df) of terms (term) that the index has. gone (shard, places): documents that no longer count."""
    own = index.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    if gone is None:
        return own.groupBy("term").agg(F.sum("n").cast("long").alias("df"))

    # a shard's places come once, before its blocks; only blocks of a shard with such documents are opened
    hit = F.broadcast(gone.select("shard").distinct().withColumn("hit", F.lit(True)))
    own = own.select("shard", "term", "n", "first", "docs").join(hit, "shard", "left")
    open_ = own.where("hit").select("shard", "term", "n", "first", "docs", F.lit(None).cast("array<int>").alias("places"))
    head = gone.select("shard", F.lit(None).cast("string").alias("term"), F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(None).cast("binary").alias("docs"), F.col("places").cast("array<int>").alias("places"))
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = open_.unionByName(head).repartition(tasks, "shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dead = np.zeros(0, bool)
        for b in it:
            terms, out = [], []
            for term, n, first, docs, places in zip(*(b.column(c).to_pylist() for c in ("term", "n", "first", "docs", "places"))):
                if term is None:
                    dead = np.zeros(0, bool)
                    if places:
                        dead = np.zeros(max(places) + 1, bool)
                        dead[places] = True
                else:
                    own = first + np.cumsum(unpacked(docs, n))
                    terms.append(term)
                    out.append(n - int(dead[own[own < len(dead)]].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(out, pa.int64())], names=["term", "df"])

    rest = own.where("hit is null").select("term", F.col("n").cast("long").alias("df"))
    return rest.unionByName(dealt.mapInArrow(run, "term string, df long")).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")


class Query:
    """A query's terms with their weights, and the k best of what it has seen."""

    def __init__(self, number: int, terms: list[tuple[bytes, float]]) -> None:
        self.number, self.terms = number, terms
        self.best: Hits | None = None
        self.least = -math.inf

    def take(self, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
        if self.best is not None:
            ids, scores = np.concatenate([self.best.ids, ids]), np.concatenate([self.best.scores, scores])
        o = np.lexsort((ids, -scores))[:k]
        self.best = Hits(ids[o], scores[o])
        if len(o) == k:
            self.least = self.best.scores[-1]


class Blocks:
    """The blocks of one shard, some terms of it, as they are read."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, impact: Impact, exact: bool) -> None:
        get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        terms = rows.column("term").cast(pa.binary()).to_pylist()
        head = terms.index(None)
        self.ids = np.frombuffer(rows.column("docs")[head].as_py(), np.int64)
        self.lengths = np.frombuffer(rows.column("freqs")[head].as_py(), "<u4").astype(np.int64)
        self.first, self.last, self.n = get("first").astype(np.int64), get("last").astype(np.int64), get("n")
        self.bound = get("impact") if exact else np.asarray(impact(get("peak"), get("least")))
        self.docs, self.freqs, self.impact = rows.column("docs"), rows.column("freqs"), impact
        self.at: dict[bytes, tuple[int, int]] = {}
        lo = 0
        for i in range(1, len(terms) + 1):
            if i == len(terms) or terms[i] != terms[lo]:
                if terms[lo] is not None:
                    self.at[terms[lo]] = lo, i
                lo = i
        self.opened: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.dead: np.ndarray | None = None

    def open(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, impacts) of a block; kept, as other queries may have the term too."""
        found = self.opened.get(block)
        if found is None:
            n = int(self.n[block])
            docs = self.first[block] + np.cumsum(unpacked(self.docs[block].as_py(), n))
            found = self.opened[block] = docs, np.asarray(self.impact(unpacked(self.freqs[block].as_py(), n), self.lengths[docs]))
        return found

    def search(self, q: Query, k: int, places: int | None, slack: float) -> int:
        """Adds the shard's documents to q that are among its k best so far; the number of blocks that it had to open."""
        lists = [(w, *self.at[t]) for t, w in q.terms if t in self.at]
        if not lists or sum(w * self.bound[lo:hi].max() for w, lo, hi in lists) + slack < q.least:
            return 0
        kind = np.result_type(self.bound, np.asarray([w for w, _, _ in lists]))
        scores, opened = np.zeros(len(self.ids), kind), 0
        # a term with few blocks here: its block would bound a wide range, so its own places do
        few, borders = [], []
        for w, lo, hi in lists:
            if hi - lo <= FEW:
                for block in range(lo, hi):
                    docs, impacts = self.open(block)
                    scores[docs] += w * impacts
                    few.append(docs)
                    opened += 1
            else:
                borders += [self.first[lo:hi], self.last[lo:hi] + 1]
        lists = [x for x in lists if x[2] - x[1] > FEW]
        alone = np.unique(np.concatenate(few)) if few else np.zeros(0, np.int64)
        # shallow moves: for every range between two borders, the block of each term that covers it, and the bound
        edges = np.unique(np.concatenate([*borders, alone, alone + 1]))
        over = np.zeros(len(edges), kind)
        over[np.searchsorted(edges, alone)] = scores[alone]
        under = np.full((len(lists), len(edges)), -1)
        for row, (w, lo, hi) in zip(under, lists):
            j = lo + np.searchsorted(self.last[lo:hi], edges)
            ok = j < hi
            ok[ok] = self.first[j[ok]] <= edges[ok]
            row[ok] = j[ok]
            over[ok] += w * self.bound[j[ok]]
        order = np.argsort(-over, kind="stable")
        done, weight = np.zeros(len(self.first), bool), np.zeros(len(self.first), kind)
        for w, lo, hi in lists:
            weight[lo:hi] = w
        ends = np.append(edges[1:], len(self.ids))
        at, step = 0, 8
        while at < len(order):
            some = order[at : at + step]
            live = some[(over[some] + slack >= q.least) & (over[some] > 0)]
            if not len(live):
                break
            need = np.unique(under[:, live])
            need = need[need >= 0]
            for block in need[~done[need]].tolist():
                docs, impacts = self.open(block)
                scores[docs] += weight[block] * impacts
                opened += 1
            done[need] = True
            # in these ranges every term's block has been added, so the scores are whole
            own = np.concatenate([np.arange(i, j) for i, j in zip(edges[live].tolist(), ends[live].tolist())])
            got = scores[own] if places is None else np.round(scores[own], places)
            good = (got > 0) & (got >= q.least)
            if self.dead is not None:
                good &= ~self.dead[own]
            if good.any():
                q.take(self.ids[own[good]], got[good], k)
            at, step = at + step, 4 * step
        return opened


def by_shard(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one shard, and one part of the queries, at a time, of batches sorted by both."""
    held: list[pa.RecordBatch] = []
    for b in it:
        shard = b.column("shard").to_numpy()
        part = b.column("part").to_numpy() if "part" in b.schema.names else np.zeros(len(shard), np.int32)
        cuts = [0, *(np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if held and any(held[-1].column(c)[0].as_py() != x[i] for c, x in (("shard", shard), ("part", part)) if c in b.schema.names):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def search(index: DataFrame, queries: DataFrame, k: int, impact: Impact, exact: bool = False, places: int | None = None, gone: DataFrame | None = None, most: int = MOST_TERMS, parts: int = 1) -> DataFrame:
    """(query_id, id, score) of the k best documents of each query with a score above 0; equal scores by ascending id.

    queries (query_id, term, weight): a score is the sum over a query's terms of weight x impact(frequency, length). exact: the
    index has the greatest impacts under this impact. places: scores are rounded to so many digits before they are compared.
    gone (shard, places): documents that are passed over. parts: where an index has few shards, every shard goes to so many tasks,
    each with a part of the queries. A query set with more than `most` rows goes through in blocks of
    whole queries.
    """
    spark = index.sparkSession
    got = queries.select("query_id", "term", "weight").limit(most + 1).collect()
    if len(got) > most:
        # a part has about half of `most` rows; one query alone may have more
        sets = max(2, -(-queries.count() // max(1, most // 2)))
        own = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(sets)) == i) for i in range(sets)]
        out = [search(index, x, k, impact, exact, places, gone, (1 << 31) - 2, parts) for x in own]
        for other in out[1:]:
            out[0] = out[0].unionByName(other)
        return out[0]
    whole = dict(queries.dtypes)["weight"] in ("bigint", "int")
    kind = "long" if whole else "double"
    asked: dict = {}
    for query, term, weight in got:
        asked.setdefault(query, []).append((term.encode(), weight))
    names = sorted(asked, key=lambda x: (x is not None, x))
    sent = spark.sparkContext.broadcast([asked[x] for x in names])
    terms = F.broadcast(queries.select("term").distinct().withColumn("asked", F.lit(True)))
    own = index.join(terms, "term", "left").where("asked or term is null").drop("asked")
    if gone is not None:
        own = _with_dead(own, gone)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if parts > 1:
        own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        dealt = own.repartition(tasks, "shard", "part").sortWithinPartitions("part", "shard", "term", "first")
    else:
        dealt = own.repartition(tasks, "shard").sortWithinPartitions("shard", "term", "first")
    slack = 10.0**-places if places is not None else 0

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [Query(i, t) for i, t in enumerate(sent.value)]
        for rows in by_shard(it):
            blocks = Blocks(rows, impact, exact)
            if "dead" in rows.column_names and (dead := rows.column("dead")[0].as_py()):
                blocks.dead = np.zeros(len(blocks.ids), bool)
                blocks.dead[dead] = True
            part = rows.column("part")[0].as_py() if "part" in rows.column_names else 0
            for q in asked[part::parts]:
                blocks.search(q, k, places, slack)
        found = [q for q in asked if q.best is not None]
        for lo in range(0, len(found), 1000):
            some = found[lo : lo + 1000]
            number = np.repeat([q.number for q in some], [len(q.best.ids) for q in some])
            ids, scores = np.concatenate([q.best.ids for q in some]), np.concatenate([q.best.scores for q in some])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(ids), pa.array(scores)], names=["number", "id", "score"])

    hits = dealt.mapInArrow(run, f"number long, id long, score {kind}")
    best = Window.partitionBy("number").orderBy(F.desc("score"), "id")
    hits = hits.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
    schema = f"number long, query_id {dict(queries.dtypes)['query_id']}"
    named = spark.createDataFrame([(i, x) for i, x in enumerate(names)], schema)
    return hits.join(F.broadcast(named), "number").select("query_id", F.nullif(F.col("id"), F.lit(NULL_ID)).alias("id"), "score")
