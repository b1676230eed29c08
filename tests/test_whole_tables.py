"""Whole tables, vectors by blocks, ties of the grid, and which bases there are."""

import os

import duckdb
import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from orrery.operators import latent, metadata, metrics, retrieval
from orrery.plans import frames
from orrery.plans import queries as plans
from orrery.plans import sql
from orrery.sources.writers import kept


@pytest.fixture
def folder(spark, tmp_path):
    """More documents and items than vectors."""
    tables = {
        "documents": spark.createDataFrame([(i, f"text {i}") for i in range(11)], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(i, f"item {i}") for i in range(6)], "item_id long, text string"),
        "embeddings": spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<float>"),
        "part": spark.createDataFrame([(i + 1, "brand") for i in range(3)], "p_partkey long, p_brand string"),
        "lineitem": spark.createDataFrame([(1, "1999-01-01")], "l_partkey long, l_shipdate string").withColumn("l_shipdate", F.to_date("l_shipdate")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_row_has_a_vector(spark, folder):
    got = {r.doc_id: r for r in frames.papers(spark, folder).collect()}
    assert {i: r.embedding[0] for i, r in got.items()} == {i: i % 4 for i in range(11)} and got[0].year == 1999 and got[9].citations is None
    assert {r.doc_id: r.embedding[0] for r in frames.other_papers(spark, folder).collect()} == {i: (i + 1) % 4 for i in range(11)}
    assert {r.query_id: r.embedding[0] for r in frames.topics(spark, folder).collect()} == {i: i % 4 for i in range(6)}
    assert {r.query_id: r.embedding[0] for r in frames.other_topics(spark, folder).collect()} == {i: (i + 1) % 4 for i in range(6)}


@pytest.mark.parametrize("passes", [1, 3])
def test_singular_vectors(spark, monkeypatch, passes):
    """Inner products of reduced rows are those of NumPy's decomposition, also with terms in parts."""
    monkeypatch.setattr(latent, "TERM_BLOCK", 7)
    monkeypatch.setattr(latent, "ROWS", 5)
    rng = np.random.default_rng(3)
    dense = rng.random((60, 40)) * (rng.random((60, 40)) < 0.2) @ np.diag(0.7 ** np.arange(40))
    dense[np.arange(60), rng.integers(0, 40, 60)] += 0.5
    rows = spark.createDataFrame([([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[np.flatnonzero(r)]]) for r in dense], "at array<int>, w array<double>").repartition(3)
    basis = latent.singular_vectors(kept(rows), 40, 5, passes, extra=8 if passes == 3 else 35)
    v = np.linalg.svd(dense)[2][:5].T
    assert basis.shape == (40, 5) and np.abs(basis.T @ basis - np.eye(5)).max() < 1e-9
    x, y = dense @ basis, dense @ v
    assert np.abs(x @ x.T - y @ y.T).max() < 1e-6
    assert latent.singular_vectors(rows, 40, 100, 2).shape[1] == 40


def test_driver_holds_no_vectors_over_the_terms(spark, monkeypatch):
    for name, value in (("TERM_BLOCK", 7), ("COLUMNS", 4), ("STEP", 3)):
        monkeypatch.setattr(latent, name, value)
    shared, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: shared.append(value) or broadcast(self, value))
    rng = np.random.default_rng(5)
    counts = rng.integers(0, 3, (80, 60)) * (rng.random((80, 60)) < 0.3)
    counts[:, 0] = 1
    texts = [(i, " ".join(f"t{j}t " * n for j, n in enumerate(row))) for i, row in enumerate(counts.tolist())]
    corpus = spark.createDataFrame(texts, "doc_id int, text string").repartition(3)
    latent.latent_vectors(corpus, corpus.withColumnRenamed("doc_id", "query_id"), rank=6, min_df=1, stop=[], passes=0)
    # No array of one row for each term is a value of the driver's: tasks get pieces, which are made on their way.
    assert not [v for v in shared if isinstance(v, np.ndarray) and len(v) == 60] and [v for v in shared if isinstance(v, latent._Piece)]
    # A few entries at a time give the same products.
    starts = np.concatenate(([0], np.cumsum((counts > 0).sum(axis=1))))
    terms, weights, block = np.nonzero(counts)[1], counts[counts > 0].astype(float), rng.random((60, 5))
    rows, total = latent._times(terms, weights, starts, block), np.zeros((60, 5))
    latent._added(total, terms, weights, starts, rows)
    assert np.allclose(rows, counts @ block) and np.allclose(total, counts.T @ counts @ block)


def test_best_of_equal_means(spark, monkeypatch):
    rows = [(n, 0.5, 0.4, 0.3, 0.2, 0.1) for n in ("0.30/0.20", "0.05/0.10", "0.10/0.00")]
    told = spark.createDataFrame(rows, "variant string, n10 double, hybrid_n10 double, p_holm double, p double, gain double")
    monkeypatch.setattr(plans, "_sensitivity_tests", lambda *_: told)
    assert plans.sensitivity_best(spark, "").first().best == "0.05/0.10"


def test_bases():
    assert retrieval.available_bases(True, True) == ["SBERT-Dense", "BGE-Dense", "Neural-Hybrid", "BGE-Hybrid"]
    assert retrieval.available_bases(False, True) == ["BGE-Dense", "BGE-Hybrid"]
    assert retrieval.available_bases(False, True, lexical=False) == ["BGE-Dense"]
    with pytest.raises(ValueError):
        retrieval.available_bases(False, False)


def test_diagnostics_of_nothing_relevant(spark):
    docs = spark.createDataFrame([(i, True, i, 2000) for i in range(3)], "doc_id long, has_record boolean, citations long, year int")
    got = metadata.diagnostics(docs, spark.createDataFrame([], "doc_id long")).collect()
    assert len(got) <= 1


def test_short_answers(spark):
    """A service that answers with fewer records than ids fails the query; no id is lost in silence."""
    ids = spark.createDataFrame([(str(i),) for i in range(5)], "doc_id string")
    with pytest.raises(Exception, match="4 records for 5 ids"):
        metadata.resolve(ids, lambda wanted: [None] * (len(wanted) - 1), tasks=1).collect()
    assert metadata.resolve(ids, lambda wanted: [None] * len(wanted), tasks=1).count() == 5


def test_merged_fields_agree_with_sql_where_places_tie(spark, tmp_path):
    rows = [
        (1, 1, 1, "R", "F", "1999-01-01"), (1, 1, 1, "N", "F", "1999-01-02"), (1, 2, 1, "A", "F", "1999-01-03"),
        (2, 1, 1, "N", "O", "1999-01-04"), (2, 1, 1, "A", "F", "1999-01-05"), (2, 1, 1, "A", "F", "1999-01-05"),
        (3, None, 1, "N", "F", "1999-01-06"), (3, 9, 1, "R", "F", "1999-01-07"), (None, 1, 1, "N", "F", "1999-01-08"),
        (4, 1, 1002, "A", "F", "1999-01-09"), (4, 2, 1, "R", "F", "1999-01-10"), (4, 3, 1, "N", "F", None), (5, 1, 1, None, None, None),
        (6, 1, 1, " ", "F", "1999-01-11"), (6, 2, 1, "N", "O", "1999-01-12"),
    ]
    lines = spark.createDataFrame(rows, "l_partkey long, l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, day string")
    lines.withColumn("l_shipdate", F.to_timestamp("day")).drop("day").write.parquet(f"{tmp_path}/lineitem.parquet")
    base = duckdb.connect()
    base.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = base.execute(sql.ORACLES["merge_fields"]).fetchall()
    got = [tuple(r) for r in plans.merge_fields(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 7


SMALLEST = "/root/testdata/sf0.001"


def test_runs_of_documents_stay_where_they_are_made(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b c d a"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "x A b c"), (8, "c d a b"), (9, "a b")], "query_id long, text string")
    found = metrics.overlap_judgements(docs, queries, 3)
    assert "hashpartitioning(run" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(7, 1), (8, 2)}
    assert {tuple(r) for r in found.collect()} == want
    monkeypatch.setattr(metrics, "SHARED_CHARS", 0)
    assert {tuple(r) for r in metrics.overlap_judgements(docs, queries, 3).collect()} == want


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the given tables")
def test_pairs_are_of_measures_that_are_kept(spark):
    """Differences don't read the tables again for each side of a pair."""
    assert not plans._diffs(spark, SMALLEST).inputFiles()


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="needs the given tables")
def test_documents_are_scored_once_for_both_encoders(spark, monkeypatch):
    calls, real = [], retrieval.score_table
    monkeypatch.setattr(retrieval, "score_table", lambda *given, **named: calls.append(1) or real(*given, **named))
    measured = plans._action_measures(spark, SMALLEST, actions=False)
    assert len(calls) == 1 and {r.base for r in measured.select("base").distinct().collect()} == set(retrieval.BASES)
