"""A consumer group that is killed and comes back; dead letters; state with timers."""

import json
import time

from pyspark.sql import functions as F

from corpuslode.streaming import consumer as C
from corpuslode.streaming.ingest import consume


def until(done, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if done():
            return True
        time.sleep(0.3)
    return False


def put(path, name, *messages):
    (path / f".{name}").write_text("".join(json.dumps(m) + "\n" for m in messages))
    (path / f".{name}").rename(path / name)


def test_pending_messages_come_first_and_poison_goes_to_the_dead_letters(spark, tmp_path):
    def process(raw):
        if "poison" in raw:
            raise ValueError("no good")
        return json.loads(raw)["text"].upper()

    log = tmp_path / "log"
    log.mkdir()
    put(log, "b.jsonl", {"text": "one"}, {"text": "poison"})
    put(log, "a.jsonl", {"text": "two"})
    out, dead = str(tmp_path / "out"), str(tmp_path / "dead")

    def killed(number):
        raise RuntimeError("killed")

    q = consume(C.consumed(spark, str(log), "g"), process, out, dead, str(tmp_path / "c1"), "s", "me", every="1 second", after=killed)
    assert until(lambda: not q.isActive) and "killed" in str(q.exception())
    group = C._Group(str(log), "g")
    assert group.numbers("given") == [1] and group.acked() == 0
    put(log, "0.jsonl", {"text": "later"})  # sorts before the others, and comes after what is pending
    seen = []
    q = consume(C.consumed(spark, str(log), "g"), process, out, dead, str(tmp_path / "c2"), "s", "me", every="1 second", after=seen.append)
    try:
        assert until(lambda: group.acked() >= 1 and len(seen) >= 2)
    finally:
        q.stop()
    rows = {(r.batch, r.source, r.result) for r in spark.read.parquet(out).collect()}
    assert rows == {(0, "b.jsonl:0", "ONE"), (0, "a.jsonl:0", "TWO"), (1, "0.jsonl:0", "LATER")}
    letters = spark.read.parquet(dead).collect()
    assert [(d.id, d.error_type, d.error_message, d.consumer) for d in letters] == [("b.jsonl:1", "ValueError", "no good", "me")]
    C.acknowledge(str(log), "g")
    assert group.acked() == 2
    other = C._Reader({"path": str(log), "group": "other"})
    assert other.initialOffset() == {"batch": 0} and len(other.partitions({"batch": 0}, other.latestOffset())) == 3


def run(stream, name, spark):
    return stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="200 milliseconds").start()


def test_state_with_timers(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    rows = spark.readStream.schema("path string, content_hash string, doc_id string").json(str(path))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    queries = [run(C.settled(rows, 1500), "settled", spark), run(C.rebuilds(rows, 3, 1500), "rebuilds", spark), run(C.newer(rows), "newer", spark)]
    try:
        row = lambda p, h, d: {"path": p, "content_hash": h, "doc_id": d}
        put(path, "1.json", row("a", "h1", "d1"), row("a", "h2", "d2"))
        got = lambda name: sorted(map(tuple, spark.table(name).collect()), key=repr)
        assert until(lambda: got("settled") == [("a", 2)]) and until(lambda: ("idle", 2) in got("rebuilds"))
        put(path, "2.json", row("b", "h1", "d3"), row("b", "h1", "d4"), row("c", "h3", "d5"), row("b", "h1", "d4"))
        assert until(lambda: ("count", 4) in got("rebuilds")) and until(lambda: len(got("settled")) == 3)
        assert got("settled") == [("a", 2), ("b", 3), ("c", 1)]
        assert until(lambda: len(got("newer")) == 5)
        assert set(got("newer")) == {("h1", "d1", None), ("h2", "d2", None), ("h1", "d3", "d1"), ("h1", "d4", "d3"), ("h3", "d5", None)}
    finally:
        for q in queries:
            q.stop()
        spark.conf.set("spark.sql.shuffle.partitions", before)
