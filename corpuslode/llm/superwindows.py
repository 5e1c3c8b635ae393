"""Repeated windows of W units (bytes or words) over a whole corpus, without a row for each window.

Every window is named by its minimiser: the smallest hash among its k-grams (Roberts et al., 2004). Neighbouring windows of
one minimiser form a super-window; equal windows have equal minimisers, so they meet under that key. What lands there:

* super-windows of equal content (64 bits of the minimiser and 64 of the content): each but the first, by (document, start),
  claims to repeat the first. Each task settles those of its own batch before anything is shuffled, so a passage that a
  third of the documents share arrives once a batch.
* different contents under one minimiser: they may overlap in part. Each is cut, around the minimiser that all of them
  align on, into nodes of a few windows, named by the stretch that a node's windows have in common. Nodes are settled as
  super-windows are; where several differ under one name, their single windows are. So a content is a row, then some rows
  for its nodes, then one for each window of the nodes at a border: the same rule for two contents and for a third of
  the corpus, and what few places share is dropped early.
* a single content: nothing in it repeats.

Claims are merged to spans and verified: a span stays only if the SHA-256 of its units equals that of the place it repeats.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import bucketed, new_path, partitions, stage
from corpuslode.llm.tokens import released

#: Units that are hashed at once; longer documents are cut into pieces that overlap by a window less one unit.
PIECE = 1 << 19
#: HISTORY: of earlier batches; NEW: the first of its content so far; REPEAT: a claim; COMPARE: has others under its key.
HISTORY, NEW, REPEAT, COMPARE = -1, 0, 1, 2
#: len: of a claim its units; else its units and, from bit 16 on, the minimiser's distance from its start.
ROWS = "kind int, m long, c long, id long, salt long, start long, len int, rid long, rsalt long, rstart long"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
CLAIM = ["id", "salt", "start", "len", "rid", "rsalt", "rstart"]
NULL_ID = -(1 << 63)
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _M[1]
    x ^= x >> np.uint64(31)
    x *= _M[2]
    x ^= x >> np.uint64(29)
    return x


@dataclass(frozen=True)
class Units:
    """What a document is made of: bytes, or words; window and gram sizes, and the windows of a node, in units."""

    window: int
    k: int
    node: int
    words: bool

    @property
    def tail(self) -> int:
        """A byte's hash is that of the 8 bytes from it on, so a stretch ends 7 hashes early."""
        return 0 if self.words else 7

    def split(self, text: str | None) -> bytes | list[bytes]:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        return raw.split() if self.words else raw

    def joined(self, own: bytes | list[bytes]) -> bytes:
        return b" ".join(own) if self.words else own

    def hashes(self, parts: list) -> np.ndarray:
        if self.words:
            h = xxhash.xxh64_intdigest
            return np.fromiter((h(w) for p in parts for w in p), np.uint64, sum(map(len, parts)))
        raw = b"".join(parts)
        return mixed(np.ndarray(len(raw), "<u8", raw + bytes(7), 0, (1,)))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_M[3]), pow(int(_M[3]), -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return tuple(out)


class Stretches:
    """Hashes of stretches of units, by prefix sums."""

    def __init__(self, y: np.ndarray, tail: int) -> None:
        self.tail = tail
        power, self.inverse = _powers(1 << (len(y) + 1).bit_length())
        self.sums = np.zeros(len(y) + 1, np.uint64)
        np.cumsum(y * power[: len(y)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end - self.tail] - self.sums[start]) * self.inverse[start])


def pieces(texts: list, units: Units) -> Iterator[tuple]:
    """(document index, offset in it, begin, end) of each piece, and the hashes of stretches of the joined pieces."""
    held, size = [], 0
    most = PIECE // 4 if units.words else PIECE

    def made() -> tuple:
        which, base, parts = zip(*held)
        end = np.cumsum([len(p) for p in parts])
        return np.array(which), np.array(base), np.append(0, end[:-1]), end, Stretches(units.hashes(parts), units.tail)

    for i, t in enumerate(texts):
        own = units.split(t)
        for base in range(0, len(own) - units.window + 1, PIECE):
            part = own[base : base + PIECE + units.window - 1]
            if held and size + len(part) > most:
                yield made()
                held, size = [], 0
            held.append((i, base, part))
            size += len(part)
    if held:
        yield made()


def super_windows(grams: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, number of windows, place of the minimiser) of each super-window.

    grams: a hash of the k-gram at each unit but the last k - 1; ends: where documents end, in units, ascending.
    """
    w = window - k + 1
    n = len(grams) - w + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    low = np.uint64((1 << 24) - 1)
    key = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    width = 1
    while 2 * width <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[:n], key[w - width : w - width + n])
    starts = np.arange(n)
    fits = starts + window <= ends[np.searchsorted(ends, starts, "right")]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (fits[1:] != fits[:-1])
    first = np.nonzero(new)[0]
    count = np.diff(np.append(first, n))
    first, count = first[fits[first]], count[fits[first]]
    return first, count, (key[first] & low).astype(np.int64)


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row but the first equals the one before it."""
    return np.logical_and.reduce([c[1:] == c[:-1] for c in columns])


def _earlier(i: np.ndarray, start: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether the place of row head[i] precedes that of row i."""
    return (i[head] < i) | (i[head] == i) & (start[head] < start)


def merged(i: np.ndarray, salt: np.ndarray, start: np.ndarray, n: np.ndarray, ri: np.ndarray, rsalt: np.ndarray, rstart: np.ndarray) -> tuple:
    """Claims that overlap and repeat one stretch, as one claim each."""
    o = np.lexsort((start, rstart - start, rsalt, ri, salt, i))
    i, salt, start, n, ri, rsalt, rstart = (x[o] for x in (i, salt, start, n, ri, rsalt, rstart))
    end = start + n
    new = np.ones(len(i), bool)
    new[1:] = ~_same(i, salt, ri, rsalt, rstart - start) | (start[1:] > end[:-1])
    at = np.nonzero(new)[0]
    most = np.maximum.reduceat(end, at) if len(at) else end
    return i[at], salt[at], start[at], (most - start[at]).astype(np.int32), ri[at], rsalt[at], rstart[at]


def _rows(kind: int, columns: dict, own: list | None = None) -> pa.RecordBatch:
    n = len(columns["id"])
    zero = np.zeros(n, np.int64)
    out = [pa.array(np.full(n, kind, np.int32))]
    out += [pa.array(np.asarray(columns.get(x, zero)).astype(np.int32 if x == "len" else np.int64)) for x in NAMES[1:]]
    return pa.RecordBatch.from_arrays(out if own is None else [*out, own], names=NAMES if own is None else [*NAMES, "own"])


def in_batch(m: np.ndarray, c: np.ndarray, i: np.ndarray, salt: np.ndarray, start: np.ndarray, n: np.ndarray, own: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of one batch: what no earlier row has (NEW), and merged claims of the others."""
    o = np.lexsort((start, i, c, m))
    m, c, i, salt, start, n = (x[o] for x in (m, c, i, salt, start, n))
    again = np.zeros(len(m), bool)
    again[1:] = _same(m, c)
    head = np.nonzero(~again)[0][np.cumsum(~again) - 1]
    repeat = again & _earlier(i, start, head)
    stay = ~repeat
    kept = {"m": m[stay].view(np.int64), "c": c[stay].view(np.int64), "id": i[stay], "salt": salt[stay], "start": start[stay], "len": n[stay]}
    none = pa.nulls(int(repeat.sum()), pa.binary())
    yield _rows(NEW, kept, None if own is None else own.take(pa.array(o[stay])))
    if len(none):
        head = head[repeat]
        claim = merged(i[repeat], salt[repeat], start[repeat], n[repeat] & 0xFFFF, i[head], salt[head], start[head])
        yield _rows(REPEAT, dict(zip(CLAIM, claim)), None if own is None else none[: len(claim[0])])


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return b.column("id").to_numpy(), b.column("salt").to_numpy()


def rows(docs: DataFrame, units: Units) -> DataFrame:
    """Rows of the super-windows of docs (id, salt, text), settled within each batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in it:
            ids, salts = _ids(b)
            got: list[tuple] = []
            for which, base, begin, end, stretch in pieces(b.column("text").to_pylist(), units):
                starts = np.arange(max(int(end[-1]) - units.k + 1, 0))
                grams = stretch(starts, starts + units.k)
                s, n, at = super_windows(grams, end, units.window, units.k)
                piece = np.searchsorted(end, s, "right")
                length = n + units.window - 1
                got.append((grams[at], stretch(s, s + length), which[piece], s - begin[piece] + base[piece], length | (at - s) << 16))
            if got:
                m, c, d, start, n = (np.concatenate(x) for x in zip(*got))
                yield from in_batch(m, c, ids[d], salts[d], start, n)

    return docs.select("id", "salt", "text").mapInArrow(run, ROWS)


def settled(found: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """What rows() found, after all of a key have met: REPEAT, and COMPARE of each content under keys that have several.

    history: rows of earlier documents, a content once; they are compared with but repeat nothing. With a history (an
    empty one counts), rows of kind NEW also come back, one for each content that it lacks.
    """
    keep = history is not None
    both = found.unionByName(history) if keep else found

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in it:
            done = np.asarray(b.column("kind")) == REPEAT
            if done.any():
                yield b.filter(pa.array(done))
                b = b.filter(pa.array(~done))
            if not b.num_rows:
                continue
            n_held = 0 if held is None else held.num_rows
            if held is not None:
                b = pa.concat_batches([held, b])
            kind, m, c, i, salt, start, n = (b.column(x).to_numpy() for x in NAMES[:7])
            again = np.zeros(len(m), bool)
            again[1:] = _same(m, c)
            lead = np.nonzero(~again)[0]  # the first row of each content
            head = lead[np.cumsum(~again) - 1]
            new = (np.arange(len(m)) >= n_held) & (kind != HISTORY)
            earlier = _earlier(i, start, head)
            repeat, tied = again & earlier & new, again & ~earlier & new
            group = np.ones(len(lead), bool)
            group[1:] = m[lead][1:] != m[lead][:-1]
            number = np.cumsum(group) - 1
            several = np.bincount(number)[number] > 1
            if repeat.any():
                to = head[repeat]
                yield _like(b, REPEAT, dict(zip(CLAIM, merged(i[repeat], salt[repeat], start[repeat], n[repeat] & 0xFFFF, i[to], salt[to], start[to]))))
            # a row at the first one's place, of another row with its doc_id, is compared for itself
            for at, what in ((lead[several], COMPARE), (np.nonzero(tied)[0], COMPARE), (lead[new[lead]] if keep else lead[:0], NEW)):
                if len(at):
                    t = b.take(pa.array(at))
                    yield t.set_column(0, "kind", pa.array(np.full(len(at), what, np.int32)))
            first = lead[np.nonzero(group)[0][-1]]  # of the last key: its first content and its last one
            held = b.take(pa.array(sorted({int(first), int(lead[-1])})))

    # What a batch has settled is dealt out evenly.
    by = F.when(F.col("kind") == REPEAT, F.xxhash64("id", "salt", "start")).otherwise(F.col("m"))
    dealt = both.withColumn("by", by).repartition(partitions(found), "by").drop("by").sortWithinPartitions("m", "c", "id", "start")
    return dealt.mapInArrow(run, ROWS + (", own binary" if "own" in found.columns else ""))


def _like(b: pa.RecordBatch, kind: int, columns: dict) -> pa.RecordBatch:
    """Rows with the columns of b."""
    return _rows(kind, columns, pa.nulls(len(columns["id"]), pa.binary()) if "own" in b.schema.names else None)


def with_salt(docs: DataFrame) -> DataFrame:
    """docs with `id`, where null is the smallest, and `salt`, a hash of the text that tells rows of one id apart."""
    return docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("salt", F.coalesce(F.xxhash64("text"), F.lit(0)))


def text_table(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as a table bucketed by (id, salt): later joins by document don't move texts again."""
    docs = with_salt(docs)
    table = bucketed(docs.sparkSession, new_path(docs.sparkSession, "texts"), docs.schema, ["id", "salt"], partitions(docs))
    docs.repartition(partitions(docs), "id", "salt").write.insertInto(table)
    return docs.sparkSession.table(table)


def by_document(rows: DataFrame, *columns: Column) -> DataFrame:
    """(id, salt, items): the rows of each document, as an array of structs of the columns."""
    return rows.groupBy("id", "salt").agg(F.collect_list(F.struct(*columns)).alias("items"))


def flat(items: pa.ListArray, *names: str) -> tuple:
    """(row, columns...) of an array column of structs."""
    items = items.combine_chunks() if isinstance(items, pa.ChunkedArray) else items
    own = items.flatten()
    size = np.diff(items.offsets.to_numpy())
    return np.repeat(np.arange(len(size)), size), *(own.field(x).to_numpy().astype(np.int64) for x in names)


def nodes(texts: DataFrame, compare: DataFrame, units: Units) -> DataFrame:
    """Rows of the nodes of compare's super-windows, settled within each batch; own: the hashes of a node's windows."""
    window, wide = units.window, units.node

    def cut(i: np.ndarray, salt: np.ndarray, m: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray, stretch: Stretches) -> Iterator[pa.RecordBatch]:
        """at: where each super-window starts in what stretch knows."""
        n, far = (size & 0xFFFF) - window + 1, size >> 16
        least = far - n + 1
        count = far // wide - least // wide + 1
        row = np.repeat(np.arange(len(n)), count)
        q = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + (least // wide)[row]
        near, far = np.maximum(q * wide, least[row]), np.minimum(q * wide + wide - 1, far[row])
        middle = (at + (size >> 16))[row]
        core = stretch(middle - q * wide, middle - q * wide - wide + 1 + window)
        u = lambda x: x.astype(np.int64).view(np.uint64)
        name = mixed(core ^ mixed(u(m)[row] + u(q) * _M[0]))
        begin, windows = middle - far, far - near + 1
        content = mixed(stretch(begin, begin + windows - 1 + window) + u(near * wide + windows) * _M[0])
        each = begin[:, None] + np.minimum(np.arange(wide), windows[:, None] - 1)
        data = stretch(each, each + window)
        own = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.arange(0, 8 * wide * len(row) + 1, 8 * wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        yield from in_batch(name, content, i[row], salt[row], start[row] + begin - at[row], windows - 1 + window, own)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, salts = _ids(b)
            d, m, start, size = flat(b.column("items"), "m", "start", "len")
            key = (d << 32) + start // PIECE
            for which, base, begin, end, stretch in pieces(b.column("text").to_pylist(), units):
                held = (which << 32) + base // PIECE
                piece = np.minimum(np.searchsorted(held, key), len(held) - 1)
                own = np.nonzero(held[piece] == key)[0]
                for lo in range(0, len(own), 1 << 16):
                    o = own[lo : lo + (1 << 16)]
                    p = piece[o]
                    yield from cut(ids[d[o]], salts[d[o]], m[o], start[o], size[o], begin[p] + start[o] - base[p], stretch)

    items = by_document(compare, F.col("m"), F.col("start"), F.col("len"))
    return texts.join(items, ["id", "salt"]).select("id", "salt", "text", "items").mapInArrow(run, f"{ROWS}, own binary")


def single(compare: DataFrame, units: Units) -> DataFrame:
    """A row for each window of compare's nodes, settled within each batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m, i, salt, start, n = (b.column(x).to_numpy() for x in ("m", "id", "salt", "start", "len"))
            h = np.frombuffer(b"".join(b.column("own").to_pylist()), np.uint64).reshape(-1, units.node)
            count = n - units.window + 1
            row, j = np.nonzero(np.arange(units.node) < count[:, None])
            if len(row):
                yield from in_batch(h[row, j], m[row].view(np.uint64), i[row], salt[row], start[row] + j, np.full(len(row), units.window))

    return compare.mapInArrow(run, ROWS)


def claims_of(found: DataFrame) -> DataFrame:
    return found.where(F.col("kind") == REPEAT).select(*CLAIM)


def refined(texts: DataFrame, compare: DataFrame, units: Units) -> DataFrame:
    """Claims (CLAIM) of the windows that compare's differing super-windows share."""
    parts = stage(settled(nodes(texts, compare, units)), "nodes")
    alone = stage(claims_of(settled(single(parts.where(F.col("kind") == COMPARE), units))), "windows")
    return claims_of(parts).unionByName(alone)


def verified(texts: DataFrame, claims: DataFrame, units: Units) -> DataFrame:
    """(id, salt, start, len) of the claims, merged, whose units equal those of the place that they repeat."""
    places = "start long, len int, rid long, rsalt long, rstart long"

    def digests(text: str | None, starts: list, sizes: list) -> list[bytes]:
        own = units.split(text)
        return [hashlib.sha256(units.joined(own[s : s + n])).digest() for s, n in zip(starts, sizes)]

    def digested(b: pa.RecordBatch, d: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        cuts = np.searchsorted(d, np.arange(b.num_rows + 1))
        return [x for k, t in enumerate(b.column("text").to_pylist()) for x in digests(t, start[cuts[k] : cuts[k + 1]].tolist(), size[cuts[k] : cuts[k + 1]].tolist())]

    def own(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d, start, size, ri, rsalt, rstart = flat(b.column("items"), *CLAIM[2:])
            d, _, start, size, ri, rsalt, rstart = merged(d, np.zeros(len(d), np.int64), start, size, ri, rsalt, rstart)
            ids, salts = _ids(b)
            columns = [ids[d], salts[d], start, size.astype(np.int32), ri, rsalt, rstart]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(digested(b, d, start, size), pa.binary())], names=[*CLAIM, "digest"])

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d, start, size = flat(b.column("items"), "start", "len")
            ids, salts = _ids(b)
            columns = [ids[d], salts[d], start, size.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), pa.array(digested(b, d, start, size), pa.binary())], names=["rid", "rsalt", "rstart", "len", "first"])

    at = lambda items: texts.join(items, ["id", "salt"]).select("id", "salt", "text", "items")
    spans_ = stage(at(by_document(claims, *[F.col(x) for x in CLAIM[2:]])).mapInArrow(own, f"id long, salt long, {places}, digest binary"), "claims")
    wanted = spans_.select(F.col("rid").alias("id"), F.col("rsalt").alias("salt"), F.col("rstart").alias("start"), "len").distinct()
    firsts = at(by_document(wanted, F.col("start"), F.col("len"))).mapInArrow(first, "rid long, rsalt long, rstart long, len int, first binary").distinct()
    both = spans_.join(firsts, ["rid", "rsalt", "rstart", "len"]).where("digest = first")
    return stage(both.select("id", "salt", "start", "len"), "verified")


def spans(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs: (begin, end), ascending."""
    o = np.argsort(starts, kind="stable")
    s, e = starts[o], np.maximum.accumulate(starts[o] + lengths[o])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.nonzero(new)[0]
    return s[at], e[np.append(at[1:], len(s)) - 1]
