"""Exact substring deduplication with suffix arrays.

Windows of 100 bytes meet by their minimisers (superwindows.py). Identical contents there are one text of the shard; where
different texts meet, a shard's texts are joined and their suffixes sorted by induced sorting (Nong, Zhang and Chan, 2009):
suffixes are classified, the leftmost smaller (LMS) substrings sorted and named, the string of their names sorted by
recursion, the rest induced from them. The scans run bucket by bucket, a numpy batch for each run of a bucket, not suffix by
suffix; so that names need few buckets, a name is two digits in the recursion. Common prefixes are computed in text
order, for irreducible positions only (Kärkkäinen, Manzini and Puglisi, 2009); the rest follow from them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import freed, id_text, partitions, result, runs, stage
from corpuslode.llm.superwindows import COMPARE, _M, Units, by_document, claims_of, flat, mixed, refined, rows, settled, spans, text_table, verified

#: Bytes of texts that are sorted together at most, unless one key has more.
SHARD = 1 << 20
#: Different texts under one key that one shard sorts; the windows of more are settled by their nodes (superwindows.py).
CROWD = 512
#: Names up to which a name is one digit in the recursion.
DIGIT = 256
#: Names that are sorted by rank doubling, at the recursion's end.
SHORT = 4096
#: Windows of a node.
NODE = 8


def _ranks_doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of names by rank doubling."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 2) + second
        sa = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[sa][1:] != key[sa][:-1]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(new) - 1
        if rank[sa[-1]] == n - 1:
            return sa
        step *= 2


def _order(names: np.ndarray, n: int) -> np.ndarray:
    """The order of the suffixes of names, whose last is the only 0, by recursion: it ends where the string is short, or where
    names of two digits would not be a shorter string than the n before."""
    most = int(names.max()) + 1
    if len(names) <= SHORT or most > DIGIT and 8 * len(names) > 3 * n:
        return _ranks_doubled(names)
    if most <= DIGIT:
        return suffix_array(names[:-1])
    base = isqrt(most) + 1
    digits = np.stack([names // base, names % base], axis=1).ravel() + 1
    sa = suffix_array(digits)
    return sa[(sa % 2 == 0) & (sa < len(digits))] // 2


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffixes in the order that sorted LMS suffixes induce: larger ones left to right, then smaller ones right to left."""
    n, k = len(s), len(sizes)
    heads = np.cumsum(sizes) - sizes
    tails = heads + sizes - 1
    sa, count_up = np.empty(n, np.int32), np.arange(n)
    by = np.argsort(s[lms], kind="stable")
    lms = lms[by].astype(np.int32)
    cuts = np.searchsorted(s[lms], np.arange(k + 1))
    # of each place the unit before it, 0 where that one's suffix is not of the kind a scan induces
    before_large, before_small = np.zeros(n, np.uint16), np.zeros(n, np.uint16)
    np.copyto(before_large[1:], s[:-1], where=~small[:-1])
    np.copyto(before_small[1:], s[:-1], where=small[:-1])

    def spread(i: np.ndarray, before: np.ndarray, free: np.ndarray, up: int) -> None:
        """free: the next free place of each bucket."""
        c = before[i]
        at = c.nonzero()[0]
        if not len(at):
            return
        c, j = c[at], i[at] - 1
        o = c.argsort(kind="stable")
        c = c[o]
        count = np.bincount(c, minlength=k)
        sa[(free - up * (count.cumsum() - count))[c] + up * count_up[: len(c)]] = j[o]
        free += up * count

    buckets = np.nonzero(sizes)[0].tolist()
    free = heads.copy()
    for c in buckets:
        done = heads[c]
        while done < free[c]:
            batch = sa[done : free[c]]
            done = free[c]
            spread(batch, before_large, free, 1)
        spread(lms[cuts[c] : cuts[c + 1]], before_large, free, 1)
    large, free = free, tails.copy()
    for c in reversed(buckets):
        done = tails[c]
        while done > free[c]:
            batch = sa[free[c] + 1 : done + 1][::-1]
            done = free[c]
            spread(batch, before_small, free, -1)
        spread(sa[heads[c] : large[c]][::-1], before_small, free, -1)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffix array of s: small integers from 1, ended by its only 0 (which is added and kept first)."""
    s = np.append(s, 0).astype(np.uint16)
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    # smaller than its right neighbour's suffix, equal neighbours inherit
    differ = np.nonzero(s[1:] != s[:-1])[0]
    nxt = np.full(n, n - 1, np.int64)
    nxt[differ] = differ
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = np.ones(n, bool)
    inner = nxt < n - 1
    small[inner] = s[nxt[inner]] < s[nxt[inner] + 1]
    lms = np.nonzero(small[1:] & ~small[:-1])[0] + 1
    sizes = np.bincount(s)
    sizes_lms = np.zeros(n, bool)
    sizes_lms[lms] = True

    def final(order: np.ndarray) -> np.ndarray:
        out = _induce(s, small, order, sizes)
        out[0] = n - 1
        return out

    sa = final(lms)
    order = sa[sizes_lms[sa]]  # LMS substrings in order
    ends = np.empty(n, np.int64)
    ends[lms] = np.append(lms[1:], n - 1)
    a, b = order[:-1], order[1:]
    same = (ends[a] - a) == (ends[b] - b)
    same[:1] = False
    active = np.nonzero(same)[0]
    t = 0
    while len(active):
        active = active[t <= (ends[b[active]] - b[active])]
        bad = s[a[active] + t] != s[b[active] + t]
        same[active[bad]] = False
        active = active[~bad]
        t += 1
    names = np.concatenate([[0], np.cumsum(~same)])
    if names[-1] < len(order) - 1:
        named = np.empty(n, np.int64)
        named[order] = names
        order = lms[_order(named[lms], n)]
    else:
        order = order.copy()
    return final(order)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place of s the length of its common prefix with the suffix just before it in sa (0 for the first)."""
    n = len(s)
    t = np.append(s, 0).astype(np.int32)
    t[-1] = -1
    phi = np.full(n + 1, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    phi = phi[:n]
    before = np.full(n, False)
    ok = (phi > 0) & (np.arange(n) > 0)
    i = np.nonzero(ok)[0]
    before[i] = t[i - 1] == t[phi[i] - 1]
    hard = np.nonzero(~before)[0]
    value = np.zeros(n, np.int64)
    active = hard[(phi[hard] >= 0) & (phi[hard] < n)]
    length = np.zeros(n, np.int64)
    while len(active):
        at, other = active + length[active], phi[active] + length[active]
        active = active[(at < n) & (other < n)]
        at, other = active + length[active], phi[active] + length[active]
        active = active[t[at] == t[other]]
        length[active] += 1
    value[hard] = length[hard]
    last = np.maximum.accumulate(np.where(before, -1, np.arange(n)))
    return np.maximum(np.where(before, value[last] - (np.arange(n) - last), value), 0)


def repeats(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, text, offset) of every window that occurs at least twice in the texts, by group.

    Only the stretches whose windows' hashes occur twice are sorted; equal windows have equal hashes. Equal stretches are
    sorted once and count as often as they occur.
    """
    pieces, whose, base = [], [], []
    joined = b"".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    if len(joined) >= window:
        y = mixed(np.ndarray(len(joined) - 7, "<u8", joined, 0, (1,)))
        n = len(joined) - window + 1
        h = y[window - 8 : window - 8 + n].copy()
        for j in range(0, window - 7, 8):
            h *= _M[3]
            h += y[j : j + n]
        at = np.arange(n)
        text = np.searchsorted(ends, at, "right")
        at = at[at + window <= ends[text]]
        h = h[at]
        o = np.argsort(h)
        twice = np.zeros(len(o), bool)
        twice[1:] = h[o][1:] == h[o][:-1]
        twice[:-1] |= twice[1:]
        at = np.sort(at[o[twice]])
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] - at[:-1] != 1) | (text[at[1:]] != text[at[:-1]])
        first = np.nonzero(new)[0]
        stops = at[np.append(first[1:], len(at)) - 1] + window if len(at) else at
        starts = at[first]
        pieces = [joined[i:j] for i, j in zip(starts.tolist(), stops.tolist())]
        whose = text[starts]
        base = starts - np.concatenate([[0], ends])[whose]
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    seen: dict[bytes, int] = {}
    which = np.array([seen.setdefault(p, len(seen)) for p in pieces])
    times = np.bincount(which)
    group, piece, offset = _sorted_repeats(list(seen), times, window)
    n = times[piece]
    copy = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(times) - times)[piece], n)
    piece = np.argsort(which, kind="stable")[copy]
    return np.repeat(group, n), whose[piece], base[piece] + np.repeat(offset, n)


def _sorted_repeats(texts: list[bytes], times: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, text, offset) of every window that occurs at least twice, where each text counts as often as times says."""
    lengths = np.array([len(t) + 1 for t in texts])
    s = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(lengths) - 1
    s[ends] = 1
    sa = suffix_array(s)
    lcp = permuted_lcp(s, sa)
    sa = sa[1:]
    text = np.searchsorted(ends, sa, "left")
    group = np.cumsum(lcp[sa] < window)
    fits = ends[text] - sa >= window
    fits &= np.bincount(group[fits], times[text[fits]], group[-1] + 1)[group] > 1
    return group[fits], text[fits], (sa - (ends - lengths + 1)[text])[fits]


def later(group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows have an earlier place (doc, start) in their group."""
    o = np.lexsort((start, doc, group))
    new = np.ones(len(o), bool)
    new[1:] = group[o][1:] != group[o][:-1]
    head = o[np.nonzero(new)[0]][np.cumsum(new) - 1]
    out = np.empty(len(o), bool)
    out[o] = (doc[head] < doc[o]) | (doc[head] == doc[o]) & (start[head] < start[o])
    return out


def shards(texts: DataFrame, compare: DataFrame, units: Units) -> DataFrame:
    """(m, id, salt, start, data): the bytes of each super-window of compare."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, salts = b.column("id").to_numpy(), b.column("salt").to_numpy()
            d, m, start, size = flat(b.column("items"), "m", "start", "len")
            raw = [units.split(t) for t in b.column("text").to_pylist()]
            data = [raw[k][s : s + n] for k, s, n in zip(d.tolist(), start.tolist(), (size & 0xFFFF).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(ids[d]), pa.array(salts[d]), pa.array(start), pa.array(data, pa.binary())], names=["m", "id", "salt", "start", "data"])

    items = by_document(compare, F.col("m"), F.col("start"), F.col("len"))
    return texts.join(items, ["id", "salt"]).select("id", "salt", "text", "items").mapInArrow(run, "m long, id long, salt long, start long, data binary")


def compared(texts: DataFrame, window: int) -> DataFrame:
    """(id, salt, start, len): what repeats an earlier window, of texts (m, id, salt, start, data) that meet under one m."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in runs(it, ["m"]):
            data = b.column("data").to_pylist()
            sizes = np.cumsum([0, *map(len, data)])
            doc, salt, start = (b.column(x).to_numpy() for x in ("id", "salt", "start"))
            lo = 0
            for g in range(1, len(bounds)):
                hi = bounds[g]
                if g < len(bounds) - 1 and sizes[bounds[g + 1]] - sizes[lo] <= SHARD:
                    continue
                group, text, offset = repeats(data[lo:hi], window)
                text = lo + text
                d, x, s = doc[text], salt[text], start[text] + offset
                lo = hi
                at = np.nonzero(later(group, d, s))[0]
                if not len(at):
                    continue
                d, x, s = d[at], x[at], s[at]
                o = np.lexsort((s, x, d))
                d, x, s = d[o], x[o], s[o]
                new = np.ones(len(d), bool)
                new[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (s[1:] - s[:-1] > 1)
                first = np.nonzero(new)[0]
                last = np.append(first[1:], len(d)) - 1
                yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(x[first]), pa.array(s[first]), pa.array((s[last] - s[first] + window).astype(np.int32))], names=["id", "salt", "start", "len"])

    dealt = texts.repartition(partitions(texts), "m").sortWithinPartitions("m")
    return dealt.mapInArrow(run, "id long, salt long, start long, len int")


def removed_bytes(docs: DataFrame, window: int = 100, k: int = 24, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, items): for every row of docs the spans (start, len) in bytes to remove; items is null if none."""
    spark, units = docs.sparkSession, Units(window, k, NODE, words=False)
    texts = text_table(id_text(docs))

    def gone() -> DataFrame:
        found = stage(settled(rows(texts, units)), "substrings")
        freed(spark)
        compare = found.where(F.col("kind") == COMPARE)
        crowds = compare.groupBy("m").count().where(F.col("count") > crowd).select("m", F.lit(True).alias("crowd"))
        compare = stage(compare.join(crowds, "m", "left"), "compare")
        few, many = compare.where("crowd is null"), compare.where("crowd")
        own = stage(compared(shards(texts, few, units), window), "compared")
        claims = claims_of(found).unionByName(refined(texts, many, units))
        return verified(texts, claims, units).unionByName(own)

    items = by_document(result(spark, "gone", gone), F.col("start"), F.col("len"))
    return texts.join(items, ["id", "salt"], "left").select("doc_id", "text", "items")


def deduplicate(docs: DataFrame, window: int = 100, k: int = 24, crowd: int = CROWD) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, kept_sha256) for every row of docs.

    Every byte covered by a window-byte string that also starts earlier (smaller doc_id, or same document, earlier start)
    goes. Null and empty texts have no bytes. A null doc_id counts as the smallest. Of rows that share a doc_id equal starts
    don't precede one another, so repeated rows get one result. Other columns, whatever their names, are left out. An empty
    table gives an empty result.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out: list[list] = [[], [], [], []]
            for text, items in zip(b.column("text").to_pylist(), b.column("items").to_pylist()):
                raw, n = (text or "").encode("utf-8", "surrogatepass"), 0
                size = len(raw)
                if items:
                    s, e = spans(np.array([x["start"] for x in items]), np.array([x["len"] for x in items]))
                    n = len(s)
                    raw = b"".join(raw[i:j] for i, j in zip([0, *e.tolist()], [*s.tolist(), size]))
                for x, y in zip(out, (size, size - len(raw), n, raw)):
                    x.append(y)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in out[3]])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    return removed_bytes(docs, window, k, crowd).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
