"""Every stage of the pipeline against a plain Python version on its own input, and run() against the stages."""

import random
import zlib

import numpy as np
import pytest
from test_set_join import edited, kept
from tokenizers import Tokenizer

import corpus_pipeline
from corpuslode.llm import langid, nbsvm, packing, set_join
from corpuslode.llm.common import prepare, stage
from corpuslode.llm.tokens import public

GOOD = {
    "en": "the of and to in house water people which there would about time with garden river morning letter".split(),
    "de": "der die und nicht wasser haus leute welche dort würde über zeit mit garten fluss morgen brief wald".split(),
}
BAD = "click buy now free win cash prize offer deal bonus hot cheap".split()


def fixture():
    r = random.Random(21)
    docs, labels = [], []

    def add(text, lang, quality=None):
        docs.append((len(docs), text, lang, "s", len(text or "")))
        if quality is not None:
            labels.append((len(docs) - 1, quality, 0))

    text = lambda words, n: " ".join(r.choice(words) + str(r.randint(0, 40)) * (r.random() < 0.5) for _ in range(n))
    for i in range(240):
        lang = "en" if i % 2 else "de"
        add(text(GOOD[lang], r.randint(30, 90)), lang, 1)
    for i in range(120):
        add(text(BAD, r.randint(20, 60)), "en", 0)
    passage = text(GOOD["en"], 45)
    for i in range(10):
        add(f"{text(GOOD['en'], 25)} {passage} {text(GOOD['en'], 25)}", "en")
    base = text(GOOD["de"], 120).split()
    for i in range(6):
        add(edited(r, base, i % 3), "de")
    add(docs[0][1], "de"), add(None, "en"), add("", "en"), add("12 34 ½", None), add(text(GOOD["en"], 2500), "en")
    return docs, labels


@pytest.fixture(scope="module")
def stages_run(spark, tmp_path_factory):
    prepare(spark)
    docs, labels = fixture()
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    tables = [now]
    for name, step in corpus_pipeline.STAGES:
        now = stage(step(spark, now, sf), name)
        tables.append(now)
    return sf, tables, [sorted((tuple(r) for r in t.collect()), key=repr) for t in tables]


def test_filters(spark, stages_run):
    sf, tables, rows = stages_run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "substrings", "packing"]
    model = langid.fit(tables[0], ~langid.held_out("doc_id", 3, 1))
    assert rows[1] == [r for r in rows[0] if not model.predict(r[1])[2]] and len(rows[0]) - 12 <= len(rows[1]) <= len(rows[0]) - 3
    judge = nbsvm.fit(tables[1], spark.read.parquet(f"{sf}/labels.parquet"), ~nbsvm.held_out("doc_id", 5, 0))
    assert rows[2] == [r for r in rows[1] if judge.score(r[1]) >= nbsvm.THRESHOLD]
    bad = {r[0] for r in rows[1] if 240 <= r[0] < 360}
    assert len(bad & {r[0] for r in rows[2]}) <= 0.1 * len(bad) and all(t.columns == tables[0].columns for t in tables[:5])


def test_copies(stages_run):
    _, _, rows = stages_run
    stay = kept([(r[0], r[1]) for r in rows[2]])
    assert sorted(r[0] for r in rows[3]) == stay and len(rows[2]) - len(rows[3]) >= 5
    assert set(rows[3]) <= set(rows[2])


def test_passages(stages_run):
    _, _, rows = stages_run
    first, seen = {}, []
    for r in sorted(rows[3]):
        words = (r[1] or "").split()
        gone = bytearray(len(words))
        for k in range(len(words) - 19):
            key = tuple(words[k : k + 20])
            if key in first:
                gone[k : k + 20] = b"\1" * 20
            first.setdefault(key, (r[0], k))
        left = " ".join(w for w, g in zip(words, gone) if not g)
        text = left if any(gone) else r[1]
        seen.append((r[0], text, *r[2:4], len(text) if text is not None else None))
    assert sorted(r[:4] for r in rows[4]) == sorted(r[:4] for r in seen) and sum(a[1] != b[1] for a, b in zip(sorted(rows[3]), sorted(rows[4]))) >= 8


def test_sequences(spark, stages_run):
    sf, tables, rows = stages_run
    t = Tokenizer.from_file(public("byte_bpe_50k.json"))
    want = []
    for r in rows[4]:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(r[0], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = tables[5].collect()
    assert sorted((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert all(o == sum(n for _, n in sorted(own)[:k]) for own in by.values() for k, (o, _) in enumerate(sorted(own))) and all(sum(n for _, n in own) <= 1024 for own in by.values())
    assert len(by) <= len(packing.decreasing(np.array([x.length for x in got]), 1024))
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, sf).collect()), key=repr) == rows[5]


def test_empty_tables(spark, stages_run):
    sf, tables, _ = stages_run
    for (_, step), table in zip(corpus_pipeline.STAGES, tables):
        assert step(spark, table.limit(0), sf).count() == 0
    assert set_join.near_duplicates(tables[0].limit(0)).count() == 0
