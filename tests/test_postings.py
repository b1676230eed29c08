"""The inverted index against full scoring."""

import numpy as np
import pytest

from orrery.operators import postings, retrieval


def corpus(seed, n, vocabulary=60):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(vocabulary)])
    share = 1 / np.arange(1, vocabulary + 1)
    rows = [(int(i), " ".join(rng.choice(words, int(rng.integers(0, 40)), p=share / share.sum()))) for i in rng.permutation(n) * 3]
    return rows + [(10**12, "w1 w1 w1"), (10**12 + 1, ""), (10**12 + 2, None)]


def ranked(scores, top):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 8)) for r in retrieval.ranked(scores, ["query_id"], top).collect())


QUERIES = [(0, "w50 w55 w3 w1"), (1, "w0 w0 w1, w2"), (2, "nothing known"), (3, ""), (4, "W59 (w58) w57 w56 w40 w41"), (5, "w1")]


@pytest.mark.parametrize("top", [1, 5, 1000])
def test_same_as_full_scoring(spark, tmp_path, monkeypatch, top):
    monkeypatch.setattr(postings, "SEGMENT", 64)
    monkeypatch.setattr(postings, "BLOCK", 8)
    rows = corpus(1, 700)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    path = str(tmp_path / "index")
    # Written in two goes, the second one's segments beside the first one's.
    postings.write(df.filter("doc_id % 2 = 0"), path, "first")
    postings.write(df.filter("doc_id % 2 = 1"), path, "second")
    index = postings.read(spark, path)
    assert ranked(postings.search(index, queries, top), top) == ranked(retrieval.bm25(df, queries, top), top)
    sizes = postings.sizes(index).first()
    assert sizes.n_docs == len(rows)
    same = lambda df: sorted((r.term, r.df, round(r.idf, 9)) for r in df.select("term", "df", "idf").collect())
    assert same(postings.frequencies(index)) == same(retrieval.inverse_frequencies(df))


def test_many_queries_and_string_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "QUERY_BLOCK", 2)
    monkeypatch.setattr(postings, "SEGMENT", 50)
    df = spark.createDataFrame([(f"d{i}", t) for i, t in corpus(2, 200)], "doc_id string, text string")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in QUERIES], "query_id string, text string")
    postings.write(df, str(tmp_path / "index"))
    index = postings.read(spark, str(tmp_path / "index"))
    assert ranked(postings.search(index, queries, 7), 7) == ranked(retrieval.bm25(df, queries, 7), 7)


def test_negative_weights(spark, tmp_path):
    """Where most terms are in most documents, weights are below zero and no bounds; rankings stay those of full scoring."""
    df = spark.createDataFrame([(i, "a b" if i % 4 else "a b c") for i in range(30)], "doc_id long, text string")
    queries = spark.createDataFrame([(0, "a"), (1, "a c"), (2, "b b")], "query_id long, text string")
    postings.write(df, str(tmp_path / "index"))
    index = postings.read(spark, str(tmp_path / "index"))
    for top in (3, 20):
        assert ranked(postings.search(index, queries, top), top) == ranked(retrieval.bm25(df, queries, top), top)


def test_few_blocks_are_decoded(spark, tmp_path, monkeypatch):
    """A rare term decides, a common one is in every document: its blocks are looked at only where they span a match."""
    monkeypatch.setattr(postings, "SEGMENT", 500)
    monkeypatch.setattr(postings, "BLOCK", 16)
    rows = [(i, "common " * (1 + i % 2) + ("rare" if i % 97 == 0 else f"x{i} y{i % 400}")) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(0, "common rare")], "query_id long, text string")
    postings.write(df, str(tmp_path / "index"))
    index = postings.read(spark, str(tmp_path / "index"))
    assert ranked(postings.search(index, queries, 10), 10) == ranked(retrieval.bm25(df, queries, 10), 10)
    found = postings.Search(index, queries, 10).figures().first()
    assert found.n_decoded < found.n_blocks / 2 and found.n_read < found.n_postings / 2


def test_no_documents(spark, tmp_path):
    empty = spark.createDataFrame([(None, "no id")], "doc_id long, text string")
    queries = spark.createDataFrame(QUERIES, "query_id long, text string")
    postings.write(empty, str(tmp_path / "index"))
    assert postings.search(postings.read(spark, str(tmp_path / "index")), queries).count() == 0
