"""Near copies by the Jaccard similarity of their sets of word shingles: every pair at the limit or above counts, by exact counts.

A prefix-filtered set join (Chaudhuri et al., 2006; Bayardo et al., 2007). The shingles of a set are put into an order that
is the same for all sets, rare ones first; two sets that are similar enough share a shingle among the first few of each, so
only those are dealt out. The order decides how many sets meet, not which pairs count; a sample tells the common shingles.

SimHash fingerprints of the sets (simhash.py) come first: the grid join of operator 1 finds the pairs within two bits, which
are counted, and what links makes the first components. At a similarity of 0.8 most fingerprints differ in more bits, so the
set join does the rest, and only that: it leaves out pairs that the fingerprints answer for and pairs in one component. Sets
that meet under a shingle are held against a few centres there, which mostly settles a large group of near copies, and
components made of what links; then all pairs that meet and lie in different components are. Pairs are ruled out by size, by
how many shingles are left after the shared one, by the bits in which parity bitmaps differ (each such bit takes a shingle
that only one of the two has), and last by counting the shingles that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslode.llm.common import batches, freed, id_text, partitions, result, runs, stage
from corpuslode.llm.components import connected
from corpuslode.llm.simhash import links as grid_links, shingle_hashes, simhash
from corpuslode.llm.tokens import released

#: Bits of a parity bitmap; one of so many texts is read for the common shingles, of which the commonest are kept.
BITS, SAMPLE, COMMON = 1024, 16, 1 << 18
#: Bits of the smaller parity bitmap that rules pairs out where they meet.
FEW = 256
#: Sets that all others under a shingle are held against first.
CENTRES = 4


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.encode("utf-8", "surrogatepass").lower().split() if text else [], shingle))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text) of rows with a doc_id; rows of one doc_id and different texts stay apart."""
    return id_text(docs).where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def common_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """The commonest shingles of a sample, the rarest of them first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in batches(it, "text"):
            t, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(t, shingle) for t in texts)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n)], names=["token", "n"])

    some = docs.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).select("text").mapInArrow(run, "token long, n long")
    top = some.groupBy("token").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "token").limit(COMMON)
    return top.toArrow().column("token").to_numpy()[::-1].view(np.uint64)


def described(docs: DataFrame, shingle: int, share: Fraction, common: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, node, n, fp, bits, few, prefix): node names the set, prefix has its first shingles (null if the batch has them)."""
    by_token = np.argsort(common)
    ordered = common[by_token]
    p, q = share.numerator, share.denominator

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for b in it:
            node, size, fps, bits, few, prefix, seen = [], [], [], [], [], [], {}
            for t in b.column("text").to_pylist():
                own = shingle_set(t, shingle)
                n = len(own)
                node.append(xxhash.xxh3_64_intdigest(own.tobytes()))
                size.append(n)
                odd = (np.bincount((own & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
                bits.append(np.packbits(odd).tobytes())
                few.append(np.packbits(np.bitwise_xor.reduce(odd.reshape(-1, FEW))).tobytes())
                first = None
                fps.append(seen[node[-1]] if node[-1] in seen else simhash(own))
                if n and node[-1] not in seen:
                    key = own >> np.uint64(1)
                    if len(ordered):
                        at = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
                        is_common = ordered[at] == own
                        key[is_common] = np.uint64(1 << 63) + by_token[at[is_common]].astype(np.uint64)
                    first = own[np.argsort(key, kind="stable")[: n - -(-n * p // q) + 1]].view(np.int64)
                seen[node[-1]] = fps[-1]
                prefix.append(first)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(size, pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(bits, pa.binary()), pa.array(few, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "node", "n", "fp", "bits", "few", "prefix"],
            )

    return docs.mapInArrow(run, "doc_id long, text_hash long, node long, n int, fp long, bits binary, few binary, prefix array<long>")


def _fits(n: np.ndarray, i: np.ndarray, a: np.ndarray, b: np.ndarray, share: Fraction) -> np.ndarray:
    """Whether sets in rows a and b, whose first common shingle is at i in each, can be similar enough."""
    p, q = share.numerator, share.denominator
    left = np.minimum(n[a] - i[a], n[b] - i[b])
    return (np.minimum(n[a], n[b]) * q >= np.maximum(n[a], n[b]) * p) & (left * (p + q) >= (n[a] + n[b]) * p)


def _by_token(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows), "token").sortWithinPartitions("token", "n", "node")


def meetings(prefixes: DataFrame, share: Fraction) -> DataFrame:
    """(token, node, n, i, centres): the rows of tokens that several sets have; centres: some of these that can be similar."""
    names, centres = ["token", "node", "n", "i"], [f"c{k}" for k in range(CENTRES)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _ in runs(it, ["token"]):
            token, node, n, i = (b.column(x).to_numpy().astype(np.int64) for x in names)
            once = np.ones(len(token), bool)
            once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
            token, node, n, i = (x[once] for x in (token, node, n, i))
            start = np.nonzero(np.append(True, token[1:] != token[:-1]))[0]
            size = np.diff(np.append(start, len(token)))
            number = np.repeat(np.arange(len(start)), size)
            by_node = np.lexsort((node, number))
            rows, keep, found = np.arange(len(token)), size[number] > 1, []
            for k in range(CENTRES):
                own = by_node[start + np.minimum(k, size - 1)][number]
                near = _fits(n, i, rows, own, share) & (own != rows)
                found.append(pa.array(node[own][keep], mask=~near[keep]))
            yield pa.RecordBatch.from_arrays([*(pa.array(x[keep]) for x in (token, node, n, i)), *found], names=[*names, *centres])

    found = _by_token(prefixes).mapInArrow(run, ", ".join(f"{x} long" for x in [*names, *centres]))
    return found.select(*names, F.array_distinct(F.array_compact(F.array(*centres))).alias("centres"))


def across(met: DataFrame, share: Fraction) -> DataFrame:
    """(a, b): the sets of different roots (token, node, n, i, root, few) that meet under a token and can be similar enough.

    Pairs are ruled out where they meet, by sizes, places and parity bitmaps; only what is left becomes a row.
    """
    p, q = share.numerator, share.denominator

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bounds in runs(it, ["token"]):
            node, n, i, root = (b.column(x).to_numpy() for x in ("node", "n", "i", "root"))
            few = np.frombuffer(b"".join(b.column("few").to_pylist()), np.uint64).reshape(-1, FEW // 64)
            end = np.repeat(bounds[1:], np.diff(bounds))
            at, d = np.arange(len(node)), 1
            while len(at):
                at = at[at + d < end[at]]
                at = at[n[at + d] * p <= n[at] * q]  # sizes ascend within a token
                two = at[root[at] != root[at + d]]
                two = two[_fits(n, i, two, two + d, share)]
                odd = np.bitwise_count(few[two] ^ few[two + d]).sum(axis=1, dtype=np.int64)
                two = two[odd * (p + q) <= (n[two] + n[two + d]) * (q - p)]
                if len(two):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[two], node[two + d])), pa.array(np.maximum(node[two], node[two + d]))], names=["a", "b"])
                d += 1

    return _by_token(met).mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, share: Fraction, only: Column) -> DataFrame:
    """The pairs (a, b) of nodes (node, n, fp, bits, lead, root, at) that are to be counted and have the share in common.

    `only` tells from both nodes' n, fp, lead and root (n_a, n_b, ...) which are to be counted.
    """
    p, q = share.numerator, share.denominator

    def alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bits_a", "bits_b"))
            odd = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            total = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(odd * (p + q) <= total * (q - p)))

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingle_set(t, shingle).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["node", "own"])

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = []
            for x, y in zip(b.column("own_a"), b.column("own_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both * q >= (len(x) + len(y) - both) * p)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda t, c, own: t.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in own])

    def linked() -> DataFrame:
        own = ["n", "fp", "bits", "lead", "root"]
        likely = pairs.join(side(nodes, "a", own), "a").join(side(nodes, "b", own), "b").where(only).select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
        likely = stage(likely.mapInArrow(alike, "a long, b long"), "set-pairs")
        freed(docs.sparkSession)
        needed = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "at.*")
        own = docs.join(needed, ["doc_id", "text_hash"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(sets, "node long, own binary")
        own = stage(own, "set-texts")
        freed(docs.sparkSession)
        both = likely.join(side(own, "a", ["own"]), "a").join(side(own, "b", ["own"]), "b").select("a", "b", "own_a", "own_b")
        return both.mapInArrow(counted, "a long, b long")

    return result(docs.sparkSession, "set-links", linked)


def within_two_bits(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of leads (nodes that are the first of their fingerprint) at 2 or fewer differing bits, and every
    other node with the lead of its fingerprint."""
    apart = grid_links(nodes.where("lead").select("node", "fp"), every=True)
    leads = nodes.where("lead").select("fp", F.col("node").alias("a"))
    return apart.unionByName(nodes.where("n > 0 and not lead").select("fp", F.col("node").alias("b")).join(leads, "fp").select("a", "b"))


def beyond_two_bits() -> Column:
    """Whether within_two_bits() leaves the pair of nodes a and b to others."""
    answered = F.when(F.col("lead_a") & F.col("lead_b"), 2).when(F.col("lead_a") | F.col("lead_b"), 0).otherwise(-1)
    return F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) > answered


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component) for every row of docs with a doc_id; text_hash: xxhash64 of the text.

    Texts link if the Jaccard similarity of their sets of shingles (of lower-cased words) is `similarity` or more. Null texts
    and texts without words have equal, empty sets and link; texts with fewer words than a shingle link if their words are
    equal. Repeated rows come as often as they are there, in one component. Rows without a doc_id are left out, and so are other
    columns, whatever their names. An empty table gives an empty result.
    """
    share = Fraction(similarity).limit_denominator(10_000)
    docs = keyed(docs)

    def groups() -> DataFrame:
        table = stage(described(docs, shingle, share, common_shingles(docs, shingle)), "sets")
        sets = stage(table.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.min("bits").alias("bits"), F.min("few").alias("few")), "sets-distinct")
        leads = stage(sets.where("n > 0").groupBy("fp").agg(F.min("node").alias("node")), "set-fingerprints").select("node", F.lit(True).alias("lead"))
        nodes = sets.join(leads, "node", "left").withColumns({"lead": F.coalesce("lead", F.lit(False)), "root": F.col("node")})

        def rooted(links: DataFrame) -> DataFrame:
            roots = stage(connected(links, "a", "b"), "set-roots")
            freed(docs.sparkSession)
            return nodes.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

        links = verified(within_two_bits(nodes), nodes, docs, shingle, share, F.lit(True))
        named = rooted(links)
        met = stage(meetings(table.select("node", "n", F.posexplode("prefix").alias("i", "token")), share), "set-meetings")
        freed(docs.sparkSession)
        rest = (F.col("root_a") != F.col("root_b")) & beyond_two_bits()
        star = met.select("node", F.explode("centres").alias("centre")).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        links = links.unionByName(verified(star.distinct(), named, docs, shingle, share, rest))
        named = rooted(links)
        pairs = across(met.drop("centres").join(named.select("node", "few", "root"), "node"), share)
        links = links.unionByName(verified(pairs, named, docs, shingle, share, rest))
        found = connected(links, "a", "b")
        return table.join(found, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("component"))

    return result(docs.sparkSession, "similar", groups)
