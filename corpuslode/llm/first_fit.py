"""Packing by first-fit decreasing in randomised groups of documents, with a tournament tree over the bins' capacities.

Texts are encoded; whole sequences are cut off long documents at once, and every document's rest, shorter than a sequence,
goes to a group that a hash of its row picks. A group packs its rests by first fit in descending order: the tree's leaves are
the bins in their order, an inner node has the larger capacity below it, so the first bin with enough room is found from the
root in as many steps as the tree is deep. Then the gaps are closed: the fullest bins stay, as many as the group's tokens
fill, and what the others hold is cut to fill them up. Tokens that fill no whole sequence make up sequences of a power of two,
so no group leaves any padding. A group holds at most `per_group` rests on average, whatever the documents' lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import id_text, partitions
from corpuslode.llm.tokens import encoder, public, released

ROOM, PER_GROUP = 4096, 4096
#: doc_id, row: of the document; rest: the ids of a document's rest, two bytes each where they fit; null for whole sequences.
_RESTS = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("rest", pa.binary())])
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tournament:
    """Capacities of n bins in a complete binary tree; node i has the larger one of its children 2 i and 2 i + 1."""

    def __init__(self, n: int, room: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [0] * (2 * self.leaves)
        self.most[self.leaves : self.leaves + n] = [room] * n
        for i in range(self.leaves - 1, 0, -1):
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])

    def first(self, size: int) -> int:
        """The first bin that has room for size; some bin must have."""
        i, most = 1, self.most
        while i < self.leaves:
            i *= 2
            if most[i] < size:
                i += 1
        return i - self.leaves

    def put(self, bin_: int, size: int) -> None:
        i, most = bin_ + self.leaves, self.most
        most[i] -= size
        i >>= 1
        while i:
            left, right = most[2 * i], most[2 * i + 1]
            now = left if left > right else right
            if most[i] == now:
                return
            most[i] = now
            i >>= 1


def first_fit_decreasing(sizes: list[int], room: int) -> list[list[int]]:
    """The bins, each the numbers of its items; items in descending size, equal ones in their order."""
    tree, bins = Tournament(len(sizes), room), []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = tree.first(sizes[item])
        if k == len(bins):
            bins.append([])
        bins[k].append(item)
        tree.put(k, sizes[item])
    return bins


def without_gaps(sizes: list[int], bins: list[list[int]], room: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) without padding: whole ones, then at most one of each power of two below room."""
    loads = [sum(sizes[i] for i in b) for b in bins]
    by_load = sorted(range(len(bins)), key=lambda k: (-loads[k], k))
    whole, left = divmod(sum(sizes), room)
    spare = iter([i for k in by_load[whole:] for i in bins[k]])
    item, at = -1, 0  # of the spare item that is being cut

    def cut(gap: int) -> list[tuple[int, int, int]]:
        nonlocal item, at
        out = []
        while gap:
            if item < 0:
                item, at = next(spare), 0
            n = min(gap, sizes[item] - at)
            out.append((item, at, n))
            gap, at = gap - n, at + n
            if at == sizes[item]:
                item = -1
        return out

    out = [[(i, 0, sizes[i]) for i in bins[k]] + cut(room - loads[k]) for k in by_load[:whole]]
    return out + [cut(1 << bit) for bit in range(room.bit_length(), -1, -1) if left >> bit & 1]


def rests(docs: DataFrame, tokenizer: str, end: int, room: int) -> DataFrame:
    """The whole sequences of every row of docs, and its rest with its ids."""
    last = np.array([end], "<u4").tobytes()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer, False)
        for b in it:
            out: list[tuple] = []
            for doc, row, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "text"))):
                ids = code.encode(text) + last
                data, n = memoryview(ids), len(ids) // 4
                cuts = [*range(0, n, room), n]
                for i, j in zip(cuts, cuts[1:]):
                    rest = None
                    if j - i < room:
                        own = np.frombuffer(data[4 * i : 4 * j], "<u4")
                        rest = (own.astype("<u2") if own.max() < 1 << 16 else own).tobytes()
                    out.append((doc, row, i, j - i, zlib.crc32(data[4 * i : 4 * j]), n, rest))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(_RESTS), _RESTS.types)], schema=_RESTS)

    return id_text(docs).withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long, rest binary")


def pack(docs: DataFrame, tokenizer: str | None = None, end: int = 2, room: int = ROOM, per_group: int = PER_GROUP, seed: int = 13) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of every row of docs.

    A sequence has `room` tokens, or a power of two. Null and empty texts are their end token. Repeated rows, and rows without
    a doc_id, are packed as often as they come. Other columns, whatever their names, are left out. An empty table gives an
    empty result.
    """
    n = max(1, -(-docs.count() // per_group))

    def run(table: pa.Table) -> pa.Table:
        released()
        doc, row, start, length, crc, total = (table.column(c).to_pylist() for c in ("doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"))
        held = table.column("rest")
        base = table.column("grp")[0].as_py() << 32
        open_ = sorted((i for i, whole in enumerate(held.is_null().to_pylist()) if not whole), key=lambda i: (-length[i], row[i]))
        sizes = [length[i] for i in open_]
        sequences = [[(i, 0, n)] for i, n in enumerate(length) if n == room]
        sequences += [[(open_[i], at, n) for i, at, n in s] for s in without_gaps(sizes, first_fit_decreasing(sizes, room), room)]
        out: list[tuple] = []
        for k, pieces in enumerate(sequences):
            offset = 0
            for i, at, size in pieces:
                code = crc[i]
                if size < length[i]:
                    rest = held[i].as_py()
                    ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * length[i] else "<u4")[at : at + size]
                    code = zlib.crc32(ids.astype("<u4").tobytes())
                out.append((doc[i], start[i] + at, size, code, total[i], base + k, offset))
                offset += size
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[x.split()[0] for x in _PIECES.split(", ")])

    place = tokenizer or public("word_bpe_49k.json")
    dealt = rests(docs, place, end, room).withColumn("grp", F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)))
    # dealt by number: rows are small and the work on them is not, so they must not be coalesced by size
    return dealt.repartition(partitions(dealt), "grp").groupBy("grp").applyInArrow(run, _PIECES)
