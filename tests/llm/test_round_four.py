"""Ranked search, divergence of sources, first-fit packing."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpuslode.llm import block_max, divergence, first_fit, queries
from corpuslode.llm.common import new_path, prepare
from corpuslode.llm.tokens import public
from corpuslode.operators import blockmax

SF = "/root/testdata/sf0.001"
R = random.Random(7)
WORDS = [f"w{i}" for i in range(30)] + ["the", "The", "ÄHNLICH", "ähnlich", "日本", "x1", "a.b", "c-d"]


def text(n):
    return " ".join(R.choice(WORDS[: R.choice([4, 12, len(WORDS)])]) for _ in range(n))


#: null and empty texts, ties, repeated rows, copies, a long text, null ids, languages and sources
ROWS = [(i, text(R.randint(1, 60)), R.choice(["en", "de", None]), R.choice(["a", "a", "b", "c"])) for i in range(150)]
ROWS += [(200, None, "en", None), (201, "", "fr", "z"), (202, " \n.,;", "", ""), (203, "the the", "en", "a"), (203, "the the", "en", "a"), (None, "the w1 w2", "en", "a"), (None, "the w1 w2", None, None)]
ROWS += [(300 + i, "w3 w4 w5 rare", "en", "b") for i in range(40)] + [(400, text(9000), "en", "a"), (401, "x" * 50_000, "en", "a")]
SCHEMA = "doc_id long, text string, lang string, source string, term string, shard long, id long, item string, row long, grp int"


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame([(*r, "t", 1, 2, "i", 3, 4) for r in ROWS], SCHEMA).repartition(5)


def ascii_lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def first_null(x):
    return (x is not None, x)


def ranked(rows, items, k=10):
    terms = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(s or ""))
    own = [(i, Counter(terms(t))) for i, t, *_ in rows]
    n, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, asked in items.items():
        scores = []
        for doc, c in own:
            m = 10 + (90 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(asked)) if t in c)
            if score > 0:
                scores.append((-score, first_null(doc), doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out)


def test_ranked_search(spark, docs):
    items = {1: "the w1 w1 rare", 2: "ähnlich ÄHNLICH 日本", 3: "", 4: "nothing here", 5: "w3 w4", 6: " ".join(WORDS)}
    asked = spark.createDataFrame([*items.items(), (7, None), (8, "w3"), (8, "w4 w5")], "item_id long, text string")
    path = new_path(spark, "block-max")
    block_max.write(docs, path)
    got = block_max.search(spark, path, asked).collect()
    assert got[0].asDict().keys() == {"item_id", "rank", "doc_id", "score"}
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == ranked(ROWS, {**items, 8: "w3 w4 w5"})
    block_max.write(docs.limit(0), empty := new_path(spark, "block-max"))
    assert block_max.search(spark, empty, asked).count() == 0 and block_max.search(spark, path, asked.limit(0)).count() == 0


def test_query_sets_go_through_in_blocks(spark, docs):
    index = blockmax.build(block_max._rows(docs), block_max.terms, block_max.Score(190, 13_000), shard_docs=40)
    asked = spark.createDataFrame([(q, f"w{(q * 7 + j) % 30}", 1 + (q + j) % 5) for q in range(60) for j in range(4)], "query_id long, term string, weight long")
    once, parts = (blockmax.search(index, asked, 3, block_max.Score(190, 13_000), True, most=most) for most in (1000, 50))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, parts.collect())) and once.count() > 100


def test_terms_end_with_their_text():
    texts = pa.array(["ab", "cd e", None, "", "É.f", "..", "g"])
    values, bounds = block_max.terms(texts.slice(1))
    own = values.to_pylist()
    assert [own[i:j] for i, j in zip(bounds, bounds[1:])] == [[b"cd", b"e"], [], [], ["É".encode(), b"f"], [], [b"g"]]


@pytest.mark.parametrize("width", [1, 2, 4])
def test_blocks_unpack(width):
    values = np.array([R.randrange(1 << (8 * width - 1)) for _ in range(300)] + [1 << (8 * width - 1)] * 2)
    starts = np.arange(0, 302, 128)
    got = blockmax.packed(values, starts)
    n = np.diff(np.append(starts, 302))
    assert np.concatenate([blockmax.unpacked(x, k) for x, k in zip(got.to_pylist(), n)]).tolist() == values.tolist()
    assert max(len(x) // k for x, k in zip(got.to_pylist(), n)) == width


def test_blocks_that_cannot_matter_stay_closed(monkeypatch):
    """A few documents hold the rare terms; the frequent ones' blocks elsewhere are passed over without decompressing."""
    rng = np.random.default_rng(3)
    own = [[f"c{j}" for j in rng.integers(0, 5, 40)] + (["rare", "scarce"] if i % 2000 == 7 else []) + ["pad"] * int(rng.integers(0, 200)) for i in range(8000)]
    held = blockmax._Shard()
    held.add(np.arange(8000), *blockmax.listed(pa.array(own)))
    score = block_max.Score(8000, sum(map(len, own)))
    rows = pa.Table.from_batches(list(held.rows(0, score)))
    for exact in (True, False):
        blocks = blockmax.Blocks(rows, score, exact)
        q = blockmax.Query(0, [(b"rare", 9000), (b"scarce", 9000), *((f"c{j}".encode(), 12) for j in range(5))])
        opened = blocks.search(q, 4, None, 0)
        asked = sum(hi - lo for t, (lo, hi) in blocks.at.items() if t != b"pad")
        assert sorted(q.best.ids.tolist()) == [7, 2007, 4007, 6007] and opened < asked / 5
        counted = {t: Counter(x)[t] for x in [own[2007]] for t in ("rare", "scarce", *(f"c{j}" for j in range(5)))}
        n = np.array([len(own[2007])])
        want = sum((9000 if t in ("rare", "scarce") else 12) * int(score(np.array([c]), n)[0]) for t, c in counted.items() if c)
        assert dict(zip(q.best.ids.tolist(), q.best.scores.tolist()))[2007] == want


def diverging(rows, least, top):
    terms = lambda s: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(s or ""))
    own = [(lang or "", source or "", Counter(terms(t))) for _, t, lang, source in rows]
    out = []
    for lang in {x[0] for x in own}:
        df = Counter(t for l, _, c in own if l == lang for t in c)
        kept = {t for t, n in df.items() if n >= least}
        groups = sorted({s for l, s, _ in own if l == lang})
        n = {g: Counter() for g in [*groups, None]}
        for l, s, c in own:
            for t in kept if l == lang else ():
                n[s][t] += c[t]
                n[None][t] += c[t]
        p = {g: {t: 1 + (10**9 * (n[g][t] + 5)) // (n[g].total() + 5 * len(kept)) for t in kept} for g in n}
        for g in groups:
            pair = [(-sum(abs(p[g][t] - p[h][t]) for t in kept), h) for h in groups if h != g]
            term = [(-(p[g][t] - p[None][t]), t) for t in kept if n[g][t] and p[g][t] > p[None][t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, g, part, item, -v, r) for r, (v, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(30, 50), (3, 5), (1000, 50)])
def test_divergence(docs, least, top):
    got = divergence.divergence(docs, least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == diverging(ROWS, least, top)
    assert divergence.divergence(docs.limit(0), least, top).count() == 0


def test_divergence_without_broadcasts(docs, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD", 10)
    assert sorted(map(tuple, divergence.divergence(docs, 3, 5).collect())) == diverging(ROWS, 3, 5)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["op11_block_max_search", "op12_source_divergence"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))


def naive_first_fit(sizes, room):
    bins, free = [], []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, f in enumerate(free) if f >= sizes[i]), len(bins))
        if k == len(bins):
            bins.append([])
            free.append(room)
        bins[k].append(i)
        free[k] -= sizes[i]
    return bins


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 64, 400])
def test_tournament_tree_is_first_fit(n):
    sizes = [R.randint(1, R.choice([5, 50, 99])) for _ in range(n)]
    bins = first_fit.first_fit_decreasing(sizes, 100)
    assert bins == naive_first_fit(sizes, 100)
    sequences = first_fit.without_gaps(sizes, bins, 128)
    loads = [sum(x[2] for x in s) for s in sequences]
    assert sum(loads) == sum(sizes) and all(x & (x - 1) == 0 for x in loads) and loads.count(128) == sum(sizes) // 128
    parts = sorted(x for s in sequences for x in s)
    assert all(sum(z for i, _, z in parts if i == k) == size for k, size in enumerate(sizes))
    assert all(i != j or a + z == b for (i, a, z), (j, b, _) in zip(parts, parts[1:]))


def test_first_fit_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public("word_bpe_49k.json"))
    want = Counter(tuple([*t.encode(x or "", add_special_tokens=False).ids, 2]) for _, x, *_ in ROWS)
    for per_group in (4096, 16):
        got = first_fit.pack(docs, per_group=per_group)
        assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        rows = got.collect()
        fills, at = Counter(), {}
        for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == at.get(r.sequence_id, 0) and r.length > 0
            at[r.sequence_id] = r.offset + r.length
            fills[r.sequence_id] += r.length
        assert all(x <= 4096 and x & (x - 1) == 0 for x in fills.values())  # 4096 is one too: no padding at all
        assert sum(fills.values()) == sum(len(k) * n for k, n in want.items())
        texts = {}
        for (i, x, *_), ids in zip(ROWS, ([*t.encode(x or "", add_special_tokens=False).ids, 2] for _, x, *_ in ROWS)):
            texts.setdefault((i, len(ids)), []).append(ids)
        for r in rows:
            own = texts[r.doc_id, r.doc_tokens]
            assert r.ids_crc32 in {zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for ids in own}
        for (i, n), own in texts.items():
            parts = sorted((r.start, r.length) for r in rows if (r.doc_id, r.doc_tokens) == (i, n))
            covered = Counter(x for s, z in parts for x in range(s, s + z))
            assert set(covered) == set(range(n)) and set(covered.values()) == {len(own)}
    assert first_fit.pack(docs.limit(0)).count() == 0


def test_special_tokens_in_a_text_are_ordinary_text():
    """As the vocabularies' own README does it: encode_special_tokens, so that no document can put an end token into a sequence."""
    from tokenizers import Tokenizer

    from corpuslode.llm.tokens import Encoder

    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        t = Tokenizer.from_file(public(name))
        special = {t.token_to_id(x) for x in ("<|endoftext|>", "<|startoftext|>")} - {None}
        t.encode_special_tokens = True
        for x in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|startoftext|>x"):
            ids = np.frombuffer(Encoder(public(name), spaces).encode(x), "<u4").tolist()
            assert ids == t.encode(x, add_special_tokens=False).ids and not special & set(ids)


def test_near_duplicate_stage_with_clashing_names(spark, tmp_path):
    from corpuslode.llm import stages

    prepare(spark)
    words = " ".join(f"v{i}" for i in range(80))
    rows = [(1, words, 5, 6, "n"), (2, words, 5, 6, "n"), (3, words + " more", 7, 8, "m"), (4, "other words of its own that stand alone here", 1, 2, "k"), (None, words, 0, 0, "z"), (5, None, 0, 0, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash long, component string")
    got = stages.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [rows[0], *rows[3:]]))
