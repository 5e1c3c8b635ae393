"""Packing documents into sequences: a grouping genetic algorithm (Falkenauer, 1996) on islands, with elite migration.

Texts are encoded and cut into pieces of at most `room` tokens. Whole pieces fill a sequence each. The others are dealt to
packs of a few thousand by a hash; each pack is evolved by several islands. A solution is a list of bins, its genes whole
bins: a crossover injects another parent's best-filled bins, drops the bins that share a document with them, and best-fits
the documents displaced. After each epoch the best solution of every island of a pack is among the parents of all of them.
Fullness is rewarded by the sum of squared fills. What the packs' worst-filled bins hold is packed once more, together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import id_text, partitions, stage
from corpuslode.llm.tokens import encoder, public, released

ROOM, PACK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1024, 4096, 2, 2, 4, 4


def pieces(docs: DataFrame, tokenizer: str | None = None, end: int = 2, room: int = ROOM) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32): the pieces of every row of docs; of several the first may be shorter.

    row: a number of its own for each row of docs, so that repeated ids stay apart.
    """
    place, last = tokenizer or public("byte_bpe_50k.json"), np.array([end], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(place, True)
        for b in it:
            out: list[tuple] = []
            for doc, row, ids in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), code.encode_all(b.column("text"))):
                data = memoryview(ids + last)
                n = len(data) // 4
                cuts = [0, *range((n - 1) % room + 1, n + 1, room)]
                out += [(doc, row, k, i, j - i, zlib.crc32(data[4 * i : 4 * j])) for k, (i, j) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, _PIECE.types)], schema=_PIECE)

    return id_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


_PIECE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class Bins:
    """Open bins by the room that is left in them; the tightest that fits is found by a bit mask."""

    def __init__(self, sizes: np.ndarray, room: int) -> None:
        self.sizes, self.room, self.mask = sizes.tolist(), room, 0
        self.by_room: list[list[int]] = [[] for _ in range(room + 1)]
        self.bins: list[list[int]] = []

    def _open(self, k: int, left: int) -> None:
        self.by_room[left].append(k)
        self.mask |= 1 << left

    def add(self, items: list[int], left: int) -> None:
        self.bins.append(items)
        self._open(len(self.bins) - 1, left)

    def best_fit(self, item: int) -> None:
        size = self.sizes[item]
        fits = self.mask >> size
        if not fits:
            self.add([item], self.room - size)
            return
        left = size + (fits & -fits).bit_length() - 1
        k = self.by_room[left].pop()
        if not self.by_room[left]:
            self.mask &= ~(1 << left)
        self.bins[k].append(item)
        self._open(k, left - size)


def decreasing(sizes: np.ndarray, room: int, order: np.ndarray | None = None) -> list[list[int]]:
    """Best fit, in descending order of size unless another order is given."""
    out = Bins(sizes, room)
    for i in (np.argsort(-sizes, kind="stable") if order is None else order).tolist():
        out.best_fit(i)
    return out.bins


def loads(bins: list[list[int]], values: np.ndarray) -> np.ndarray:
    """The sum over each bin's documents of their values, all bins at once; no bin is empty."""
    if not bins:
        return np.zeros(0, np.int64)
    at = np.fromiter(chain.from_iterable(bins), np.int64)
    n = np.fromiter(map(len, bins), np.int64, len(bins))
    return np.add.reduceat(values[at].astype(np.int64), np.cumsum(n) - n)


def worth(bins: list[list[int]], sizes: np.ndarray, room: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), float(((loads(bins, sizes) / room) ** 2).sum())


def crossed(a: list[list[int]], b: list[list[int]], sizes: np.ndarray, room: int, rng: np.random.Generator) -> list[list[int]]:
    """a, with some of b's best-filled bins injected whole."""
    fill = loads(b, sizes)
    best = np.argsort(-fill, kind="stable")[: max(1, len(b) // 2)]
    chosen = rng.choice(best, max(1, len(best) // 2), replace=False).tolist()
    taken = np.zeros(len(sizes), bool)
    for i in chosen:
        taken[b[i]] = True
    out, displaced = Bins(sizes, room), []
    for i in chosen:
        out.add(b[i][:], room - int(fill[i]))
    for x, n, size in zip(a, loads(a, taken).tolist(), loads(a, sizes).tolist()):
        if n:
            if n < len(x):
                displaced += [i for i in x if not taken[i]]
        else:
            out.add(x[:], room - size)
    for i in sorted(displaced, key=lambda i: -out.sizes[i]):
        out.best_fit(i)
    return out.bins


def mutated(a: list[list[int]], sizes: np.ndarray, room: int, rng: np.random.Generator) -> list[list[int]]:
    """a without its worst-filled bins and a few others, whose documents are best-fitted anew."""
    fill = loads(a, sizes)
    gone = set(np.argsort(fill, kind="stable")[: max(1, len(a) // 50)].tolist()) | set(rng.integers(0, len(a), max(1, len(a) // 50)).tolist())
    out, displaced = Bins(sizes, room), [i for k in gone for i in a[k]]
    for k, (x, size) in enumerate(zip(a, fill.tolist())):
        if k not in gone:
            out.add(x[:], room - size)
    for i in sorted(displaced, key=lambda i: -out.sizes[i]):
        out.best_fit(i)
    return out.bins


def evolve(sizes: np.ndarray, room: int, parents: list[list[list[int]]], generations: int, population: int, seed: int) -> list[list[int]]:
    """The best solution after some generations that start from parents and best fits in noisy orders."""
    rng = np.random.default_rng(seed)
    least = -(-int(sizes.sum()) // room)
    rated = lambda x: (worth(x, sizes, room), x)
    pool = [rated(x) for x in parents]
    while len(pool) < population:
        pool.append(rated(decreasing(sizes, room, None if not pool else np.argsort(-(sizes * (1 + 0.1 * rng.random(len(sizes)))), kind="stable"))))
        if len(pool[-1][1]) == least:
            return pool[-1][1]
    for _ in range(generations):
        pool.sort(key=itemgetter(0), reverse=True)
        best = pool[0][1]
        if len(best) == least:
            break
        i, j = (pool[int(k)][1] for k in rng.integers(0, len(pool), 2))
        pool += [rated(crossed(best, i, sizes, room, rng)), rated(mutated(crossed(j, best, sizes, room, rng), sizes, room, rng))]
        pool = sorted(pool, key=itemgetter(0), reverse=True)[:population]
    return max(pool, key=itemgetter(0))[1]


def _solved(parts: DataFrame, room: int, islands: int, epochs: int, generations: int, population: int, name: str) -> DataFrame:
    """(pack, row, piece, size, bin) of parts (pack, row, piece, size): the best of each pack's islands."""
    at = F.array(*[F.lit(i) for i in range(islands)])
    schema = "pack long, row long, piece int, size long, bin long, island int, n long, fill double"
    found = None

    def island_run(epoch: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            released()
            pack, island = int(pdf["pack"].iloc[0]), int(pdf["island"].iloc[0])
            pdf = pdf.sort_values(["row", "piece"])
            sizes = pdf["size"].to_numpy()
            parents = []
            for elite in pdf["elites"].iloc[0] if epoch else ():
                bins = np.array([x[elite] for x in pdf["elites"]], np.int64)
                o = np.argsort(bins, kind="stable")
                parents.append([x.tolist() for x in np.split(o, np.nonzero(np.diff(bins[o]))[0] + 1)])
            best = evolve(sizes, room, parents, generations, max(population, len(parents) + 1), 1_000_003 * pack + 101 * island + epoch)
            out = pdf[["pack", "row", "piece", "size"]].copy()
            bins = np.empty(len(pdf), np.int64)
            for k, x in enumerate(best):
                bins[x] = k
            n, fill = worth(best, sizes, room)
            return out.assign(bin=bins, island=island, n=n, fill=fill)

        return run

    for epoch in range(epochs):
        if epoch:
            # migration: every island of a pack starts from the elite of each of them
            elites = found.groupBy("pack", "row", "piece", "size").agg(F.map_from_entries(F.collect_list(F.struct(F.col("island"), F.col("bin")))).alias("elites"))
            source = elites.withColumn("island", F.explode(at))
        else:
            source = parts.withColumn("island", F.explode(at))
        # dealt by number: the rows are few and the work on them is not, so they must not be coalesced by size
        source = source.repartition(partitions(source), "pack", "island")
        found = stage(source.groupBy("pack", "island").applyInPandas(island_run(epoch), schema), name)
    best = found.groupBy("pack").agg(F.max(F.struct("n", "fill", "island")).alias("b")).select("pack", F.col("b.island").alias("island"))
    return found.join(best, ["pack", "island"]).select("pack", "row", "piece", "size", "bin")


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, room: int = ROOM, per_pack: int = PACK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs.

    Null and empty texts are their end token. Repeated rows, and rows without a doc_id, are packed as often as they come.
    Pieces of one length may change places; a seed makes the result the same each time. Other columns, whatever their names,
    are left out. An empty table gives an empty result.
    """
    own = stage(pieces(docs, tokenizer, end, room), "pieces")
    small = own.where(F.col("length") < room).select("row", "piece", F.col("length").alias("size"))
    packs = max(1, -(-small.count() // per_pack))
    first = small.withColumn("pack", F.pmod(F.xxhash64("row", "piece"), F.lit(packs)))
    done = stage(_solved(first, room, islands, epochs, generations, population, "pack"), "packed")
    if packs > 1:
        # the bins that are not nearly full are opened and packed once more, those of some tens of packs together
        fills = done.groupBy("pack", "bin").agg(F.sum("size").alias("fill"))
        loose = fills.where(F.col("fill") < room - room // 64).select("pack", "bin")
        open_ = stage(done.join(loose, ["pack", "bin"], "left_semi"), "loose")
        again = max(1, -(-open_.count() // per_pack))
        second = open_.select("row", "piece", "size", F.pmod(F.xxhash64("piece", "row"), F.lit(again)).alias("pack"))
        second = _solved(second, room, islands, epochs, generations, population, "repack").withColumn("pack", F.col("pack") + packs)
        done = done.join(loose, ["pack", "bin"], "left_anti").select("pack", "row", "piece", "size", "bin").unionByName(second)
    # ids: a pack's bins side by side; a bin holds at most `room` pieces, so its window is bounded
    done = done.select("row", "piece", "size", (F.col("pack") * (2 * per_pack * room) + F.col("bin")).alias("sequence_id"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sequence_id", "row", "piece"])
        return pdf.assign(offset=pdf.groupby("sequence_id")["size"].cumsum() - pdf["size"])[["row", "piece", "sequence_id", "offset"]]

    group = F.shiftright("sequence_id", 8)
    placed = done.groupBy(group).applyInPandas(place, "row long, piece int, sequence_id long, offset long")
    whole = own.where(F.col("length") == room).select("row", "piece", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return own.join(placed.unionByName(whole), ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
