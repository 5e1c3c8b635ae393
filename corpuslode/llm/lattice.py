"""Embedding near-duplicates: random projections decoded to E8 lattice points, several tables, exact cosine check.

Unit vectors are projected to 8 dimensions by a seeded Gaussian matrix per table and decoded to the nearest points of the
E8 lattice (Conway and Sloane: the nearer of the nearest points in D8 and in D8 + 1/2). Each vector stands in the cells of
its nearest point and of the next `probes - 1` neighbours; two vectors meet in a table when they share one of those cells.
Pairs that meet are verified by their cosine in double precision. A cell's vectors are cut into blocks, and each pair of
blocks is one group of rows: nothing holds a whole cell, and no pair is ever a row. A pair is counted in the smallest of
the cells it shares only, so counts are exact. Equal vectors of a label are one member with a multiplicity.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import partitions, runs, stage
from corpuslode.llm.components import connected

PROBES, BLOCK, RECALL = 3, 2048, 0.998
#: Scales of the lattice, the share of pairs of unrelated vectors that meet in a table at scale 1, how much more a row with its
#: vector costs than one of a cell's key, and the members of a cell that cost as much to compare as such a row.
SCALES, CHANCE, VECTOR, FILL = (1.0, 1.2, 1.4, 1.6, 1.8, 2.0), 4e-4, 3, 64


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum of coordinates."""
    r = np.rint(x)
    odd = np.nonzero(r.sum(axis=1).astype(np.int64) & 1)[0]
    if len(odd):
        d = x[odd] - r[odd]
        worst = np.abs(d).argmax(axis=1)
        r[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return r


def decode_e8(x: np.ndarray) -> np.ndarray:
    """The nearest E8 lattice points of the rows of x (n, 8), doubled so that all coordinates are integers."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], a, b)).astype(np.int64)


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled: the steps to neighbouring cells."""
    out = [[2 * s * (k == i) + 2 * t * (k == j) for k in range(8)] for i in range(8) for j in range(i) for s in (-1, 1) for t in (-1, 1)]
    out += [[1 - 2 * (m >> k & 1) for k in range(8)] for m in range(256) if bin(m).count("1") % 2 == 0]
    return np.array(out, np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """(n, tables, probes) keys of the cells that each unit vector stands in; the order of keys means nothing."""
    n, dim = unit.shape
    rng = np.random.default_rng(seed)
    mix = rng.integers(1, 2**63, 8, dtype=np.uint64) | np.uint64(1)
    roots = _roots()
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        x = unit @ rng.standard_normal((dim, 8)) * scale
        home = decode_e8(x)
        gap = 2 * x - home
        # |gap - root|^2 = |gap|^2 - 2 gap.root + 8: the nearest neighbours have the largest gap.root
        best = np.argsort(-(gap @ roots.T), axis=1, kind="stable")[:, : probes - 1]
        points = np.concatenate([home[:, None], home[:, None] + roots[best]], axis=1)
        with np.errstate(over="ignore"):
            h = (points.astype(np.uint64) * mix).sum(axis=2, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[:, t] = ((h >> np.uint64(8)) | (np.uint64(t) << np.uint64(56))).view(np.int64)
    return out


@functools.cache
def found_share(least: float, probes: int, scale: float, seed: int = 5) -> float:
    """The share of pairs with the cosine `least` that meet in one table, by simulation; it hardly depends on the dimension."""
    rng = np.random.default_rng(seed)
    a, d = (rng.standard_normal((1000, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1)[:, None]
    d -= (d * a).sum(axis=1)[:, None] * a
    b = a * least + d / np.linalg.norm(d, axis=1)[:, None] * np.sqrt(1 - least**2)
    x, y = (cells(v, 8, probes, scale, seed) for v in (a, b))
    return float((x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean())


def settings(largest: int, least: float, probes: int = PROBES, recall: float = RECALL) -> tuple[float, int]:
    """(scale, tables) of the least work for labels of up to `largest` vectors: cells, rows in shared ones, and what they meet."""
    options = []
    for scale in SCALES:
        share = min(found_share(least, probes, scale), 1 - 1e-3)
        tables = max(2, ceil(log(1 - recall) / log(1 - share))) if share > 0.01 else 1000
        others = largest * CHANCE / scale**8
        options.append((tables * (1 + VECTOR * (1 - exp(-others) + others / FILL)), scale, tables))
    _, scale, tables = min(options)
    return scale, tables


def unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which of the vectors are usable (not null or zero, all components finite), and those as unit rows."""
    ok, rows = [], []
    for i, v in enumerate(vectors):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        if np.isfinite(x).all() and x.any():
            x = x / np.abs(x).max()
            ok.append(i)
            rows.append(x / np.sqrt((x * x).sum()))
    return np.array(ok, np.int64), rows


def _shared(a: np.ndarray, b: np.ndarray, cell: int) -> np.ndarray:
    """For pairs of rows of cells: whether `cell` is the smallest cell that both have."""
    both = (a[:, :, None] == b[:, None, :]) & (a[:, :, None] < cell)
    return ~both.any(axis=(1, 2))


def _joined(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Makes parent, in place, name the least member of each row's component, with the links (u, v) added."""
    while len(u):
        a, b = parent[u], parent[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def near_duplicates(vectors: DataFrame, least: float = 0.98, recall: float = RECALL, probes: int = PROBES, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors (vec_id, embedding, label).

    Only vectors of equal, non-null labels and equal dimension link. Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, nor does one whose label is null: n_links 0, a component of its own.
    Repeated rows (equal vec_id, label and embedding) are copies that link with each other. A null vec_id takes part in
    counts, and gets the component of its group. Other columns, whatever their names, are left out. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("e", lambda x: x != 0)
    # 128 bits of label and vector: two hashes, whose chains run through the elements from different seeds
    halves = [F.unhex(F.lpad(F.hex(h), 16, "0")) for h in (F.xxhash64("label", "e"), F.xxhash64("e", "label"))]
    key = F.when(F.col("label").isNull() | F.col("e").isNull() | bad, None).otherwise(F.concat(*halves))
    rows = stage(rows.select("vec_id", "label", "e", key.alias("key")), "vectors")
    largest = rows.where("key is not null").groupBy("label").count().agg(F.max("count")).first()[0] or 0
    scale, tables = settings(largest, least, probes, recall)
    groups = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("e").alias("e"))

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok, unit = unit_rows(b.column("e").to_pylist())
            for dim in sorted({len(u) for u in unit}):
                at = [k for k, u in enumerate(unit) if len(u) == dim]
                u = np.array([unit[k] for k in at])
                c = cells(u, tables, probes, scale, seed)
                own = b.take(pa.array(ok[at]))
                lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel(), kind))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("node"), own.column("copies"), own.column("label"), lists(u, pa.float64()), lists(c.reshape(len(at), -1), pa.int64())], names=["key", "node", "copies", "label", "e", "cells"])

    placed = stage(groups.mapInArrow(place, "key binary, node long, copies long, label string, e array<double>, cells array<long>"), "vectors-placed")
    where = placed.select("key", "label", F.size("e").alias("dim"), F.explode(F.array_distinct("cells")).alias("cell"))
    crowd = where.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    met = stage(where.join(crowd, ["label", "dim", "cell"]).select("key", "label", "dim", "cell", "blocks"), "vectors-met")
    mine = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    met = met.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "label", "dim", "cell", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    met = met.join(placed.select("key", "node", "copies", "e", "cells"), "key")

    keys = ["label", "dim", "cell", "i", "j"]

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in runs(it, keys):
            matrix = lambda n, kind: b.column(n).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(b.num_rows, -1)  # noqa: B023, E731
            dims = np.diff(b.column("e").offsets.to_numpy())
            flat, at, c = b.column("e").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(dims)]), matrix("cells", np.int64)
            key, copies, mine, cell, i, j = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "copies", "mine", "cell", "i", "j"))
            names, sums, ends = [], [], []
            for lo, hi in zip(bounds, bounds[1:]):
                x = flat[at[lo] : at[hi]].reshape(hi - lo, -1)
                first = np.nonzero(mine[lo:hi] == i[lo])[0] if i[lo] != j[lo] else np.arange(hi - lo)
                second = np.nonzero(mine[lo:hi] == j[lo])[0]
                linked, parent = np.zeros(hi - lo, np.int64), np.arange(hi - lo)
                for some in np.array_split(first, -(-len(first) // 256)):
                    hits = x[some] @ x[second].T >= least
                    if i[lo] == j[lo]:
                        hits &= some[:, None] < second
                    p, q = np.nonzero(hits)
                    p, q = some[p], second[q]
                    for k in range(0, len(p), 1 << 15):
                        u, v = p[k : k + (1 << 15)], q[k : k + (1 << 15)]
                        whole = _shared(c[lo + u], c[lo + v], cell[lo])
                        u, v = u[whole], v[whole]
                        np.add.at(linked, u, copies[lo + v])
                        np.add.at(linked, v, copies[lo + u])
                        _joined(parent, u, v)
                some = np.nonzero(linked)[0]
                names.append(key[lo + some])
                sums.append(linked[some])
                ends.append(np.where(parent[some] == some, None, key[lo + parent[some]]))
            if names:
                # the links of a vector in this block: their number, and another member of its component there
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names), pa.binary()), pa.array(np.concatenate(sums)), pa.array(np.concatenate(ends), pa.binary())], names=["key", "linked", "with"])

    dealt = met.repartition(partitions(met), *keys).sortWithinPartitions(*keys)
    found = stage(dealt.mapInArrow(verify, "key binary, linked long, with binary"), "vectors-links")
    counts = found.groupBy("key").agg(F.sum("linked").alias("linked"))
    ends = placed.select(F.col("key").alias("with"), F.col("node").alias("b"))
    edges = found.where("with is not null").select("key", "with").distinct().join(placed.select("key", F.col("node").alias("a")), "key").join(ends, "with")
    roots = connected(edges, "a", "b")
    named = placed.join(counts, "key", "left").join(roots, "node", "left").select("key", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = rows.select("vec_id", "key").join(named, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), (F.col("vec_id") == component).alias("kept"))
