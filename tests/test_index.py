"""Versioned tables, and the index of segments against one built anew and against the search without an index."""

import os
import random

import pytest
from pyspark.sql import functions as F

from corpuslode.operators import blockmax
from corpuslode.operators import index as I
from corpuslode.operators import search as S
from corpuslode.sources.versions import Conflict, Manifests, VersionedTable

R = random.Random(5)
WORDS = [f"w{i}" for i in range(40)]


def texts(spark, ids, salt=0):
    r = random.Random(salt)
    rows = [(i, " ".join(r.choice(WORDS[: r.choice([5, 15, 40])]) for _ in range(r.randint(0, 30))) if i % 17 else None) for i in ids]
    return spark.createDataFrame(rows, "chunk_id long, text string")


def rows(df):
    return sorted(map(tuple, df.select("query_id", "chunk_id", "score", "rank").collect()))


def test_index_of_segments_is_the_index_built_anew(spark, tmp_path):
    q = spark.createDataFrame([(1, "w1 w2 W2"), (2, "w39"), (3, "nowhere"), (4, " ".join(WORDS)), (5, None), (6, "w3 w17 w5")], "query_id long, text string")
    index = I.Bm25Index(spark, str(tmp_path / "i"))
    index.fan, index.smallest = 3, 10
    now = {}

    def check():
        every = spark.createDataFrame(list(now.items()), "chunk_id long, text string") if now else texts(spark, [0]).limit(0)
        assert index.document_count() == len(now)
        for k in (1, 5):
            assert rows(index.search(q, k)) == rows(S.bm25(every, q, k))

    steps = [("add", texts(spark, range(60), 1)), ("add", texts(spark, range(40, 75), 2)), ("delete", range(0, 20)), ("add", texts(spark, range(70, 80), 3)), ("add", texts(spark, range(5, 9), 4)), ("delete", range(30, 75))]
    for verb, what in steps:
        if verb == "add":
            index.add(what)
            now.update({r.chunk_id: r.text for r in what.collect()})
        else:
            index.delete(spark.createDataFrame([(i,) for i in what], "chunk_id long"))
            now = {i: t for i, t in now.items() if i not in what}
        check()
    assert len(index.segments()) <= 3
    before = index.search(q, 3)
    gone = index.clean()
    assert gone and rows(before) == rows(index.search(q, 3))
    index.delete(spark.createDataFrame([(i,) for i in now], "chunk_id long"))
    assert index.document_count() == 0 and index.search(q, 3).count() == 0


def test_an_index_can_replace_other_ids(spark, tmp_path):
    index = I.Bm25Index(spark, str(tmp_path / "i"))
    index.index(texts(spark, range(1, 10)))
    index.add(texts(spark, [100, 101]), spark.createDataFrame([(3,), (4,)], "chunk_id long"))
    assert index.document_count() == 9
    assert {r.id for r in blockmax.lowest(index._rows(index.segments()), 4, index._gone(index._state())).collect()} == {1, 2, 5, 6}


def test_merged_shards_are_the_same_postings(spark):
    chunks = texts(spark, range(300), 9).repartition(4).select(F.col("chunk_id").alias("id"), F.split(F.coalesce("text", F.lit("")), " ").alias("terms"))
    index = blockmax.build(chunks, shard_docs=30)
    merged = blockmax.merged(index, shard_docs=120)
    flat = lambda df: sorted((r.term, r.total, r.n) for r in df.groupBy("term").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).where("term is not null").collect())
    assert flat(index) == flat(merged)
    assert merged.where("term is null").count() < index.where("term is null").count()


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path / "data") for f in names if f.startswith("part-")}


def test_versioned_table(spark, tmp_path):
    path = tmp_path / "t"
    t = VersionedTable(spark, str(path), ["k"], buckets=8)
    assert not t.exists()
    with pytest.raises(RuntimeError):
        t.read()
    t.upsert(spark.createDataFrame([(i, f"a{i}") for i in range(50)] + [(None, "null")], "k long, v string"))
    first, old = files(path), t.read()
    t.upsert(spark.createDataFrame([(3, "new", 1.5), (None, "again", None)], "k long, v string, extra double"))
    changed = t.files(1).items() ^ t.files(2).items()
    assert {k for k, _ in changed} == set(t._touched(spark.createDataFrame([(3,), (None,)], "k long"))) and first < files(path)
    now = {r.k: (r.v, r.extra) for r in t.read().collect()}
    assert now[3] == ("new", 1.5) and now[None] == ("again", None) and now[4] == ("a4", None) and len(now) == 51
    assert {r.k: r.v for r in old.collect()}[3] == "a3" and t.read(1).count() == 51  # a reader keeps its version
    t.update(spark.createDataFrame([(4, "up"), (5, None)], "k long, v string"))
    t.delete(spark.createDataFrame([(6,), (None,), (1000,)], "k long"))
    now = {r.k: r.v for r in t.read().collect()}
    assert (now[4], now[5], 6 in now, None in now, len(now)) == ("up", "a5", False, False, 49)
    assert t.manifests.versions() == [1, 2, 3, 4]
    t.clean(keep=2)
    assert t.manifests.versions() == [3, 4] and t.read().count() == 49 and t.read(3).count() == 51
    again = VersionedTable(spark, str(path), ["k"])
    assert again.buckets == 8 and again.read().count() == 49


def test_a_killed_write_leaves_no_trace(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, str(tmp_path / "t"), ["k"], buckets=4)
    t.replace(spark.createDataFrame([(i, "a") for i in range(20)], "k long, v string"))
    named = dict(t.files())

    def killed(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(t.manifests, "publish", killed)
        t.upsert(spark.createDataFrame([(1, "b")], "k long, v string"))
    assert t.manifests.latest() == 1 and t.files() == named and {r.v for r in t.read().collect()} == {"a"}
    assert len(t.clean()) == 1 and t.read().count() == 20


def test_two_writers_of_one_version(spark, tmp_path):
    m = Manifests(spark, str(tmp_path / "m"))
    assert m.latest() == 0 and m.read() == {} and m.publish(0, {"a": 1}) == 1
    with pytest.raises(Conflict):
        m.publish(0, {"a": 2})
    m.fs.createNewFile(m._at("claims", "2"))  # a writer that claimed its number and has not come further
    with pytest.raises(Conflict):
        m.publish(1, {"a": 3})
    assert m.read() == {"a": 1}
    m.stale = -1.0
    assert m.publish(1, {"a": 4}) == 2 and m.read() == {"a": 4} and m.read(1) == {"a": 1}


def test_bmx_differs_from_bm25(spark):
    """BM25 takes the chunk that is a word shorter, BMX the one that has both of the query's words."""
    rows = [(1, "rare x x x x x x x"), (2, "rare common x x x x x x x")] + [(i, "common y y y y y y y") for i in range(3, 40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, text string")
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    assert S.bm25(chunks, q, 1).first().chunk_id == 1 and S.bmx(chunks, q, 1).first().chunk_id == 2
    assert S.bmx(chunks, q.limit(0), 3).count() == 0 and S.bmx(chunks, spark.createDataFrame([(1, "no"), (2, None)], q.schema), 3).count() == 0


def test_dead_places_stand_on_a_shards_row_alone(spark):
    """One list a shard, not one a block; frequencies leave the dead out."""
    rows = spark.createDataFrame([(i, ["a", f"b{i % 3}", f"c{i}"]) for i in range(600)], "id long, terms array<string>").repartition(2)
    index = blockmax.build(rows).cache()
    dead = blockmax.places(index, spark.createDataFrame([(i,) for i in range(0, 300, 2)], "id long")).where("shard is not null")
    gone = dead.groupBy("shard").agg(F.collect_set("place").alias("places"))
    own = blockmax._with_dead(index, gone)
    assert own.where("term is not null and dead is not null").count() == 0
    assert own.where("term is null").selectExpr("sum(size(dead))").first()[0] == 150 and own.count() == index.count()
    asked = spark.createDataFrame([("a",), ("b0",), ("c0",), ("c1",)], "term string")
    assert {tuple(r) for r in blockmax.frequencies(index, asked, gone).collect()} == {("a", 450), ("b0", 150), ("c1", 1)}
