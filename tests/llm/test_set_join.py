import random

from corpuslode.llm import set_join, stages
from corpuslode.llm.common import prepare
from corpuslode.llm.simhash import links, simhash


def shingles(text, n=5):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n, 0) + 1)) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    """Brute force over all pairs: the ids that stay, of rows (doc_id, text) with unique ids."""
    own, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for _ in own:
        before = dict(label)
        for a in own:
            for b in own:
                if similar(own[a], own[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return sorted(i for i in label if label[i] == i)


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_near_copies_go_at_a_similarity_of_0_8(spark, tmp_path):
    prepare(spark)
    r, rows = random.Random(7), [(900, None), (901, " \n"), (902, "one two"), (903, "One  two"), (904, "two one"), (905, "a b c d e"), (906, "a b c d e f")]
    for base in range(12):
        words = [f"w{r.randrange(40 if base % 2 else 4000)}" for _ in range(r.choice([9, 30, 120, 400]))]
        rows += [(base * 10 + k, edited(r, words, k * len(words) // 100)) for k in range(6)]
    rows += [(200 + k, edited(r, [f"x{i}" for i in range(100)], 2)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(x.doc_id for x in stages.near_duplicates(spark, docs, str(tmp_path)).collect())
    own = dict(rows)
    assert any(0.8 <= len(a & b) / len(a | b) < 0.9 for a in map(shingles, own.values()) for b in map(shingles, own.values()) if a | b)
    assert got == kept(rows)


def test_no_pair_is_lost_without_the_centres(spark, monkeypatch):
    prepare(spark)
    r = random.Random(8)
    rows = [(k, edited(r, [f"x{i}" for i in range(60)], 1 + k % 3)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(set_join, "CENTRES", 1)
    found = set_join.near_duplicates(docs).collect()
    first = {}
    for x in found:
        first[x.component] = min(first.get(x.component, x.doc_id), x.doc_id)
    assert sorted(first.values()) == kept(rows)
    assert set_join.near_duplicates(docs.limit(0)).count() == 0


def test_of_rows_with_one_id_only_copies_go(spark, tmp_path):
    prepare(spark)
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (2, b), (3, c), (3, c), (4, a), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(x) for x in stages.near_duplicates(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (2, b), (3, c), (None, a)], key=repr)


def test_fingerprints_answer_for_pairs_within_two_bits(spark, monkeypatch):
    """without the grid join, pairs at one or two bits come apart, and only they; with it, no link is missing."""
    prepare(spark)
    r, rows, near = random.Random(9), [], []
    for base in range(40):
        words = [f"b{base}w{i}" for i in range(r.choice([80, 200, 400]))]
        pair = [" ".join(words), edited(r, words, 1 + base % 2)]
        x, y = (simhash(set_join.shingle_set(t, 5)) for t in pair)
        if 1 <= (x ^ y).bit_count() <= 2:
            near.append(2 * base + 1)
        rows += [(2 * base, pair[0]), (2 * base + 1, pair[1])]
    assert 3 <= len(near) <= 37
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def stay():
        first = {}
        for x in set_join.near_duplicates(docs).collect():
            first[x.component] = min(first.get(x.component, x.doc_id), x.doc_id)
        return sorted(first.values())

    assert stay() == kept(rows)
    monkeypatch.setattr(set_join, "within_two_bits", lambda nodes: nodes.selectExpr("node as a", "node as b").limit(0))
    assert stay() == sorted(kept(rows) + near)


def test_every_pair_within_two_bits(spark):
    r = random.Random(10)
    fps = {r.getrandbits(64) for _ in range(6)}
    for x in list(fps):
        for _ in range(25):
            fps.add(x ^ (1 << r.randrange(12)) ^ (r.getrandbits(1) << r.randrange(64)) ^ (r.getrandbits(1) << 63))
    own = dict(enumerate(fps))
    signed = [(k, x - (x >> 63 << 64)) for k, x in own.items()]
    got = sorted(tuple(x) for x in links(spark.createDataFrame(signed, "node long, fp long"), every=True).collect())
    want = sorted((a, b) for a in own for b in own if a < b and (own[a] ^ own[b]).bit_count() <= 2)
    assert got == want and len(want) > 200


def test_no_link_is_lost_among_equal_fingerprints(spark, monkeypatch):
    """all sets with one of few fingerprints, so that most pairs within two bits are not answered for by leads."""
    prepare(spark)
    r = random.Random(11)
    rows = [(10 * g + k, edited(r, [f"g{g}x{i}" for i in range(60)], k % 4)) for g in range(6) for k in range(10)]
    rows += [(60 + k, " ".join(f"y{k}z{i}" for i in range(30))) for k in range(5)]
    monkeypatch.setattr(set_join, "simhash", lambda own: (int(own[0]) if len(own) else 0) & 3)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    first = {}
    for x in set_join.near_duplicates(docs).collect():
        first[x.component] = min(first.get(x.component, x.doc_id), x.doc_id)
    assert sorted(first.values()) == kept(rows)
