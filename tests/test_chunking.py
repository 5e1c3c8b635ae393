import json

import pytest

from corpuslode.operators import chunking as C

TEXT = "Intro text here. It has two sentences.\n\n# One\n\nFirst paragraph of one. " + "Some words follow here. " * 60 + "\n\n## Two\n\nShort.\n\nAlso short.\n\n# Three\n\n" + "x" * 3000


@pytest.mark.parametrize("name", sorted(C.CHUNKERS))
def test_invariants(name):
    found = C.chunker(name)(TEXT)
    assert found
    for c in found:
        assert 0 <= c.start < c.end <= len(TEXT)
        assert c.text.endswith(TEXT[c.start : c.end])
    starts = [c.start for c in found]
    assert starts == sorted(starts)


@pytest.mark.parametrize("name", ["recursive", "fixed_size", "clauses", "sentences"])
def test_no_word_is_lost(name):
    text = " ".join(f"word{i}{'.' if i % 7 == 0 else ''}" for i in range(2000))
    found = C.chunker(name)(text)
    assert {w.strip(".") for c in found for w in c.text.split()} == {w.strip(".") for w in text.split()}


def test_sizes():
    assert all(len(c.text) <= 100 for c in C.recursive(TEXT, size=100))
    assert all(C.n_words(c.text) <= 75 for c in C.fixed_size(TEXT, size=100))
    assert all(C.n_tokens(c.text) <= 200 for c in C.sentences(TEXT))
    assert all(len(c.text) <= 300 for c in C.windows(TEXT, size=300, overlap=50))


def test_headings():
    found = C.heading(TEXT)
    assert [c.heading for c in found if "Short." in c.text] == ["## Two"]
    assert {c.heading for c in C.heading_based(TEXT)} == {None, "One", "One > Two", "Three"}
    assert not C.heading("# Only\n\n# Headings")


def test_unknown_name():
    with pytest.raises(ValueError, match="recursive"):
        C.chunker("nothing")


def test_table(spark):
    df = spark.createDataFrame([(1, TEXT, "x"), (2, None, "x"), (3, "", "x"), (4, "  \n ", "x")], "doc_id long, text string, chunk_index string")
    rows = C.chunked(df, "heading").collect()
    assert {r.doc_id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert C.chunked(df.limit(0), "heading").count() == 0


def test_stream(spark, tmp_path):
    from corpuslode.streaming.ingest import current, incoming, ingest

    source = tmp_path / "in"
    source.mkdir()
    record = {"source_file": "a/b.md", "headings": [{"heading": "h", "level": 1, "chunks": [{"text": "one", "entities": []}, {"text": "two", "entities": []}]}]}
    put = lambda n, x: (source / n).write_text(x)
    put("a.json", json.dumps(record))
    put("b.json", "{ not json")
    put("c.json", json.dumps({"headings": []}))
    put("d.json", json.dumps({"source_file": "d", "headings": []}))
    put("e.tmp", json.dumps(record))
    at = [str(tmp_path / x) for x in ("table", "quarantine", "checkpoint")]
    for _ in range(2):
        ingest(incoming(spark, str(source)), *at).awaitTermination()
        got = current(spark, at[0]).orderBy("chunk_index").collect()
        assert [r.text for r in got] == ["one", "two"] and got[0].doc_id.startswith("b_")
        put("f.json", json.dumps(record))  # the same content once more: replaces, does not add
    assert {r.error for r in spark.read.parquet(at[1]).collect()} == {"not JSON", "no source_file"}


def test_tokens_are_looked_for_once(monkeypatch):
    """A sentence of many words, and many sentences: what is read to count tokens is no more than the text."""
    from corpuslode.operators import chunking as C

    read, own = [], C.n_tokens
    monkeypatch.setattr(C, "n_tokens", lambda text: read.append(len(text)) or own(text))
    text = "word " * 2000 + "end. " + "Some short sentence. " * 300
    chunks = C.sentences(text)
    assert all(own(c.text) <= 200 for c in chunks) and len(chunks) > 10
    assert sum(read) <= len(text)


def test_counts_of_spans():
    from corpuslode.operators import chunking as C

    text = " one,two  three\n\nfour-five six "
    n = C.counted_words(text)
    assert all(n(i, j) == C.n_words(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1))
