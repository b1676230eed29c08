"""Micro fixtures worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import generation, latent, metadata, metrics, policy, retrieval, router, stats
from orrery.sources import readers, writers


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_tokens(spark):
    df = spark.createDataFrame([("A-b, (c) d",), ("",), ("  X  ",), (None,)], "t string")
    assert [r.x for r in df.select(T.tokens(F.col("t")).alias("x")).collect()] == [["a", "b", "c", "d"], [""], ["x"], [""]]


def test_fixed_values(spark):
    """Values typed from the definition: marks, stop words, and the patterns of reviews and questions."""
    marks = ",.();:!?\"'[]{}<>/\\-"
    df = spark.createDataFrame([("a".join(marks),), ("a\\b C",), ("x\u00a0y\x1cz",)], "t string")
    assert [r.x for r in df.select(T.tokens(F.col("t")).alias("x")).collect()] == [["a"] * (len(marks) - 1), ["a", "b", "c"], ["x", "y", "z"]]
    assert set(T.STOP_WORDS) == set("a an the of in on for and or to is are with by".split())
    texts = ["A State-of-the-Art of x", "recent advances", "cats VS dogs", "compare these", "who is when where", "a systematic meta-analysis", "In 1999 IT Was re-done"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("w", T.words(F.col("t")))
    got = made.select("i", *[c.alias(n) for n, c in T.query_features(F.col("t"), F.col("w")).items()]).orderBy("i").collect()
    assert [r.is_review for r in got] == [1, 1, 0, 0, 0, 0, 0] and [r.is_question for r in got] == [0, 0, 1, 1, 0, 0, 0]
    last = got[-1]
    assert (last.n_tokens, last.n_digits, last.n_caps, last.has_year, last.n_hyphenated) == (5, 4, 1, 1, 1)
    assert last.stop_ratio == pytest.approx(1 / 5) and last.capital_ratio == pytest.approx(3 / 5) and last.unique_ratio == 1


def test_formats_and_ids(spark):
    row = spark.createDataFrame([("https://doi.org/10.1/AbC", "https://pubmed.gov/123/", "MED-7", 12, 0.12345, 0.0001234)], "doi string, pmid string, med string, n int, x double, p double")
    got = row.select(T.normalised_doi(F.col("doi")), T.normalised_pmid(F.col("pmid")), T.without_prefix(F.col("med")), T.corpus_key(F.col("n")), T.decimals(F.col("x")), T.percent(F.col("x")), T.p_text(F.col("p")), T.p_text(F.col("x")), T.year_of(F.lit("2020-01-02")), T.action_label(F.lit("recency"), F.lit(0.1)), T.year_of(F.lit("n/a"))).first()
    assert tuple(got) == ("10.1/abc", "123", "7", "CorpusId:12", "0.1235", "12.3%", "1.23e-04", "0.123", 2020, "recency:0.10", None)


def test_measures_count_queries_without_results(spark):
    run = spark.createDataFrame([("m", 1, 5, 1), ("k", 2, 9, 1)], "method string, query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "query_id int, doc_id int, gain int")
    got = {r.method: r for r in metrics.means(metrics.per_query(run, qrels, spark.createDataFrame([(1,), (2,)], "query_id int"))).collect()}
    assert (got["m"].n_queries, got["m"].r1, got["m"].mrr) == (2, 0.5, 0.5) and (got["k"].n_queries, got["k"].r10) == (2, 0)


def test_audits(spark):
    rows_ = spark.createDataFrame([("b", q, a) for q in (1, 2) for a in "xy"] + [("c", 1, "x")], "base string, query_id int, action string")
    got = {r.base: r for r in metrics.audit(rows_, "base", "action", 2).collect()}
    assert (got["b"].n_queries, got["b"].complete, got["b"].n_parts) == (2, True, 2) and not got["c"].complete
    both = spark.createDataFrame([(i, 0.5, 0.5 + (i == 0)) for i in range(10)], "query_id int, released double, rebuilt double")
    bad = metrics.reconstruction(both).first()
    assert (bad.mean_shift, bad.mismatches, bad.ok) == (pytest.approx(0.1), pytest.approx(0.1), False) and metrics.reconstruction(both.filter("query_id > 0")).first().ok
    measured = spark.createDataFrame([(m, q, *[v] * 5, "d" + str(q % 2)) for m, q, v in (("A", 1, 0.5), ("A", 2, 1.0), ("A", 4, 0.0), ("B", 1, 0.25), ("B", 2, 0.0), ("B", 4, 0.0))], "method string, query_id int, r1 double, r5 double, r10 double, n10 double, mrr double, dataset string")
    macro = {(r.dataset, r.method): r.n10 for r in metrics.over_datasets(measured).collect()}
    assert macro["d0", "A"] == 0.5 and macro["macro", "A"] == 0.5 and macro["macro", "B"] == 0.125
    gain = metrics.relative_gains(measured, "A").filter("measure = 'n10'").first()
    assert (gain.own, gain.difference) == (0.5, pytest.approx(0.5 - 0.25 / 3)) and gain.percent == pytest.approx(500)


def test_measures(spark):
    run = spark.createDataFrame([("m", 1, d, r) for r, d in enumerate((3, 1, 4, 2), 1)] + [("m", 2, 1, 1)], "method string, query_id int, doc_id int, rank int")
    qrels = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "query_id int, doc_id int, gain int")
    got = metrics.per_query(run, qrels, spark.createDataFrame([(1,), (2,)], "query_id int")).orderBy("query_id").collect()
    assert (got[0].r1, got[0].r5, got[0].mrr) == (0, 1, 0.5)
    assert got[0].n10 == pytest.approx(0.643322, abs=1e-6)
    assert (got[1].r10, got[1].n10, got[1].mrr) == (0, 0, 0)


def test_scaled():
    low, high = np.array([3.0, 0.0]), np.array([3.0, 10.0])
    got = retrieval._between(np.array([[3.0, 3.0, 3.0], [0.0, 5.0, 10.0]]), low, high)
    assert got.tolist() == [[0, 0, 0], [0, 0.5, 1]]


def small_corpus(spark, n=60, key=str):
    """Documents of few words with vectors of few values, so that scores tie, and three queries; one shares no word with any document."""
    rng = np.random.default_rng(3)
    terms = np.array("red green blue black white".split())
    docs = [(key(i), " ".join(rng.choice(terms, rng.integers(1, 5))), rng.integers(-1, 2, 3).astype(float).tolist(), int(rng.integers(0, 9)), 2000 + int(rng.integers(0, 20)), "v" + str(rng.integers(0, 3))) for i in range(n)]
    queries = [(1, "red green", [1.0, 0.0, 1.0]), (2, "blue blue", [0.0, -1.0, 0.5]), (3, "unknown", [1.0, 1.0, 1.0])]
    kind = "string" if key is str else "long"
    return spark.createDataFrame(docs, f"doc_id {kind}, text string, embedding array<double>, citations int, year int, venue string"), spark.createDataFrame(queries, "query_id int, text string, embedding array<double>")


def plain_scores(corpus, queries):
    """All pairs' raw and scaled scores, pair by pair."""
    docs, asked = corpus.toPandas(), queries.toPandas()
    bm = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(corpus, queries).collect()}
    out = {}
    for q in asked.itertuples():
        raw = {d.doc_id: (bm.get((q.query_id, d.doc_id), 0.0), float(np.dot(q.embedding, d.embedding))) for d in docs.itertuples()}
        edges = [(min(x), max(x)) for x in zip(*raw.values())]
        out[q.query_id] = {d: (*x, *[(v - lo) / (hi - lo) if hi - lo > 1e-12 else 0.0 for v, (lo, hi) in zip(x, edges)]) for d, x in raw.items()}
    return out


def first(scores, top):
    return sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:top]


@pytest.fixture(params=["cells", "tasks"])
def small_blocks(request, monkeypatch):
    """Few pairs at a time; queries in a grid of cells, or all of them with every task."""
    monkeypatch.setattr(retrieval, "PAIRS", 40)
    if request.param == "cells":
        monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
        monkeypatch.setattr(retrieval, "DOC_BLOCK", 16)


@pytest.mark.parametrize("key", (str, int))
def test_fused_rankings(spark, small_blocks, key):
    corpus, queries = small_corpus(spark, key=key)
    plain, table = plain_scores(corpus, queries), retrieval.score_table(corpus, queries, top=5)
    got = {m: {} for m in ("BM25", "SBERT-Dense", "Neural-Hybrid", "Alpha-Hybrid")}
    for r in retrieval.all_runs(table).filter("rank <= 5").orderBy("rank").collect():
        if r.method in got:
            got[r.method].setdefault(r.query_id, []).append(r.doc_id)
    ways = {"BM25": lambda x: x[0], "SBERT-Dense": lambda x: x[1], "Neural-Hybrid": lambda x: 0.5 * x[2] + 0.5 * x[3], "Alpha-Hybrid": lambda x: 0.6 * x[2] + 0.4 * x[3]}
    for method, way in ways.items():
        assert got[method] == {q: first({d: way(x) for d, x in s.items()}, 5) for q, s in plain.items()}, method


@pytest.mark.parametrize("key", (str, int))
def test_reciprocal_ranks(spark, small_blocks, key):
    corpus, queries = small_corpus(spark, key=key)
    got = {}
    for r in retrieval.reciprocal_ranks(corpus, queries, k=2, top=5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, round(r.score, 9)))
    for q, s in plain_scores(corpus, queries).items():
        places = [{d: i for i, d in enumerate(first({d: x[at] for d, x in s.items()}, None))} for at in (0, 1)]
        fused = {d: 1 / (2 + places[0][d]) + 1 / (2 + places[1][d]) for d in s}
        assert got[q] == [(d, round(fused[d], 9)) for d in first(fused, 5)]


def test_tasks_leave_enough_for_the_top(spark, small_blocks):
    corpus, queries = small_corpus(spark)
    for method in (retrieval.dense, retrieval.bm25):
        few, every = (rows(retrieval.ranked(method(corpus, queries, top), ["query_id"], 5), "query_id", "rank") for top in (5, 60))
        assert few == every and len(few) == 15
        assert method(corpus, queries, 5).count() < method(corpus, queries, 60).count() == 180


def test_reranking_by_any_share(spark, small_blocks):
    corpus, queries = small_corpus(spark)
    got = {}
    for r in retrieval.reranked_corpus(corpus, queries, [("x", 0.35, 0.0, 0.0)]).filter("rank <= 5").orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == {q: first({d: 0.35 * x[2] + 0.65 * x[3] for d, x in s.items()}, 5) for q, s in plain_scores(corpus, queries).items()}


def test_no_documents_or_queries(spark):
    corpus, queries = small_corpus(spark)
    for c, q in ((corpus.limit(0), queries), (corpus, queries.limit(0))):
        assert not retrieval.all_runs(retrieval.score_table(c, q)).count()
        assert not retrieval.reciprocal_ranks(c, q).count()
        assert not retrieval.bm25(c, q).count()


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "family string, name string, p double")
    assert [round(r.p_holm, 9) for r in stats.holm(df, ["family"]).orderBy("name").collect()] == [0.03, 0.06, 0.06]


def test_cohens_d_and_signed_rank(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 3.0), ("m", 0.0)], "method string, diff double")
    assert stats.cohens_d(df.filter("diff > 0"), ["method"]).first().d == 2
    got = stats.signed_rank(df, ["method"]).first()
    assert (got.w_plus, got.n, got.tie_term) == (6, 3, 0)
    zero = spark.createDataFrame([("z", 0.0)], "method string, diff double")
    assert stats.wilcoxon(zero, ["method"]).first().p == 1


def test_weighted_effect(spark):
    df = spark.createDataFrame([("a", 1.0, 0.3), ("a", 0.0, 0.3)], "action string, effect double, sim double")
    got = stats.weighted_effects(df, ["action"]).first()
    assert (got["mean"], got.n_eff, got.df) == (pytest.approx(0.5), pytest.approx(2), 1)
    assert got.se == pytest.approx(0.5)


def test_t_critical():
    assert stats.t_critical(1, 0.05) == pytest.approx(6.313752, abs=1e-5)
    assert stats.t_critical(10, 0.05) == pytest.approx(1.812461, abs=1e-5)
    assert stats.t_critical(7, 0.025) == pytest.approx(2.364624, abs=1e-5)


def test_mann_whitney(spark):
    df = spark.createDataFrame([(1, 3, True), (1, 1, True), (1, 2, False)], "g int, v int, p boolean")
    assert stats.mann_whitney(df, ["g"], "v", "p").first().auc == 0.5


def test_confusion(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "t string, p string")
    got = stats.confusion(df, "t", "p", ["a", "b"]).first()
    assert (got.accuracy, got.kappa) == (0.75, 0.5)
    assert got.macro_f1 == pytest.approx((2 / 3 + 0.8) / 2)


def test_signals(spark):
    docs = spark.createDataFrame([(1, "a b", 9, 2014, "x"), (2, "a", None, 2025, None), (3, None, 0, None, "x")], "doc_id int, text string, citations int, year int, venue string")
    got = {r.doc_id: r for r in retrieval.signals(docs).collect()}
    assert got[1].c == pytest.approx(1)
    assert (round(got[1].r, 6), round(got[2].r, 6)) == (0.367879, 1.105171)
    assert got[3].r == pytest.approx(math.exp(-0.1 * (2024 - 2019)))
    assert (got[1].v, got[2].v, got[1].len, got[3].len) == (1, 0, 2, 1)


def test_bm25_by_hand(spark):
    docs = {1: "a b b", 2: "b c", 3: "d e f g"}
    corpus = spark.createDataFrame(list(docs.items()), "doc_id int, text string")
    queries = spark.createDataFrame([(7, "b c b")], "query_id int, text string")
    df = {t: sum(t in x.split() for x in docs.values()) for t in "abcdefg"}
    raw = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    want = {}
    for i, x in docs.items():
        w = x.split()
        s = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / 3)) for t in "b c b".split() if t in w)
        want[i] = pytest.approx(s)
    assert {r.doc_id: r.score for r in retrieval.bm25(corpus, queries).collect()} == want


def test_citations_and_judges(spark):
    records = spark.createDataFrame([(1, [1, 2, 3, 4, 5], "x [1] y [7] z [1]", 'so {"relevance": 4, "faithfulness": 5}'), (2, [1], "none", "nothing")], "query_id int, doc_ids array<int>, answer string, verdict string")
    qrels = spark.createDataFrame([(1, 1, 1)], "query_id int, doc_id int, gain int")
    got = generation.judged(generation.citation_precision(records, qrels)).orderBy("query_id").collect()
    assert (got[0].citation_precision, got[0].n_citations, got[0].relevance, got[0].faithfulness) == (1, 1, 4, 5)
    assert (got[1].citation_precision, got[1].n_citations, got[1].relevance) == (None, 0, None)


def test_keep_best_and_merge(spark):
    df = spark.createDataFrame([("u1", "", 2019, 1), ("u1", "10.1/x", 2020, 2), ("u1", "10.1/y", 2021, 3)], "uid string, doi string, year int, row_pos int")
    assert readers.first_supplied(df, "uid", "row_pos", "doi").first().year == 2020
    assert metadata.merged(df, "uid", "row_pos", ["doi"]).first().doi == "10.1/x"


def test_merging_overrides_when_a_field_is_supplied(spark):
    """The rows of a key in order, as (s2, pmid); a row that supplies what is missing overrides all that it has."""
    cases = {
        "u": ([("A", ""), ("B", "p")], ("B", "p")), "v": ([("A", "q"), ("B", "p")], ("A", "q")), "w": ([("", "q"), ("", "r"), (" C ", "")], ("C", "q")),
        "x": ([("", ""), (None, "z"), ("D", None), ("E", "y")], ("D", "z")), "y": ([("", None)], ("", "")),
    }
    df = spark.createDataFrame([(k, i, *r) for k, (given, _) in cases.items() for i, r in enumerate(given)], "uid string, at int, s2 string, pmid string")
    assert {r.uid: (r.s2, r.pmid) for r in metadata.merged(df, "uid", "at", ["s2", "pmid"]).collect()} == {k: want for k, (_, want) in cases.items()}


def test_second_pass_and_doi_chain(spark):
    known = spark.createDataFrame([("a", True, 3, 2000, "v"), ("b", False, None, None, None), ("c", True, None, 1999, ""), ("d", False, None, None, None)], "doc_id string, has_record boolean, citations int, year int, venue string")
    keys = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "")], "doc_id string, key string")
    got = metadata.second_pass(known, keys, lambda w: [{"citations": int(k), "year": 1, "venue": "w"} for k in w], tasks=1)
    assert rows(got, "doc_id") == [("a", True, 3, 2000, "v"), ("b", True, 2, 1, "w"), ("c", True, 3, 1999, "w"), ("d", False, None, None, None)]
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "doc_id string")
    bib = spark.createDataFrame([("a", "10.1/X", "2001", "j"), ("b", "10.1/x", "n/a", ""), ("c", "", "1990", "k")], "doc_id string, doi string, year string, venue string")
    records = spark.createDataFrame([("10.1/x", 5, None, "")], "doi string, citations int, year int, venue string")
    assert rows(metadata.by_doi(ids, bib, records), "doc_id") == [("a", 5, 2001, "j"), ("b", 5, None, ""), ("c", None, 1990, "k"), ("d", None, None, "")]


def test_resolve_stops_and_tries_again(spark):
    def service(wanted):
        seen.append(wanted)
        if len(seen) < 3:
            raise OSError
        return [None] * len(wanted)

    seen = []
    ids = spark.createDataFrame([("a",)], "doc_id string")
    assert metadata.resolve(ids, service, tasks=1).first().has_record is False
    assert metadata.resolve(ids, service, tasks=1, budget=-1.0).count() == 0


def test_resolve_uses_the_client(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    got = metadata.resolve(ids, lambda wanted: [{"citations": 3, "year": None, "venue": "v"} if w == "a" else None for w in wanted], tasks=1)
    assert rows(got, "doc_id") == [("a", True, 3, None, "v"), ("b", False, None, None, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"_id": "1", "title": "T", "text": null}\n{"_id": "2", "title": null, "text": "x"}\n')
    assert rows(readers.corpus(spark, str(tmp_path / "c.jsonl")), "doc_id") == [("1", "T "), ("2", " x")]
    (tmp_path / "q.tsv").write_text("query-id\tcorpus-id\tscore\n1\t5\t1\nshort\n1\t5\t2.0\n1\t6\t0\n")
    assert rows(readers.judgements(spark, str(tmp_path / "q.tsv")), "doc_id") == [("1", "5", 2), ("1", "6", 0)]
    (tmp_path / "m.json").write_text('{"1": {"citations": 2, "year": 2000, "venue": "v"}, "2": null}')
    assert rows(readers.metadata(spark, str(tmp_path / "m.json")), "doc_id") == [("1", True, 2, 2000, "v"), ("2", False, None, None, None)]


def test_append_missing(spark, tmp_path):
    path, df = str(tmp_path / "log"), spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    writers.append_missing(spark, df.filter("k = 1"), path, ["k"])
    writers.append_missing(spark, df, path, ["k"])
    assert rows(spark.read.parquet(path), "k") == [(1, "a"), (2, "b")]


def test_policy_abstains_and_acts(spark):
    texts = [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta") for i in range(40)]
    queries = spark.createDataFrame(texts, "query_id int, text string")
    bases = spark.createDataFrame([("b", i, 0.5) for i, _ in texts], "base string, query_id int, outcome double")
    outcomes = spark.createDataFrame([("b", i, a, 0.9 if i % 2 and a == "up" else 0.1) for i, _ in texts for a in ("up", "down")], "base string, query_id int, action string, outcome double")
    routes, scored, fallback = policy.route(queries, bases, outcomes)
    got = [r for r in routes.collect() if r.policy == "local_mean"]
    assert len(got) == 40
    for r in got:
        assert r.action == ("up" if r.query_id % 2 else None)
        assert r.outcome == (0.9 if r.query_id % 2 else r.fallback)
    assert {r.policy for r in policy.summary(routes).collect()} == set(policy.POLICIES)
    risk = policy.risk_coverage(scored, fallback, outcomes).orderBy("scale").collect()
    coverage = [r.coverage for r in risk]
    assert coverage == sorted(coverage, reverse=True) and risk[0].coverage == 0.5
    assert risk[0].gain == pytest.approx(0.2) and risk[0].harmed == 0 and risk[0].n_queries == 40
    told = {r.policy: r for r in policy.with_p(policy.summary(routes)).collect()}["local_mean"]
    assert (told.improved, told.harmed, told.unchanged_all, told.improved_all) == (20, 0, 20, 20) and told.w_plus == 210 and told.p < 1e-4
    assert {(r.policy, r.action): r.n for r in policy.selected_counts(routes).collect()}["local_mean", "fallback"] == 20
    span = {r.policy: r for r in policy.intervals(routes).collect()}["local_mean"]
    assert 0 < span.low < 0.2 < span.high < 0.4


def test_policy_repeats_and_transfer(spark):
    texts = [(i, "alpha beta gamma" if i % 2 else "delta epsilon zeta") for i in range(24)]
    queries = spark.createDataFrame(texts, "query_id int, text string")
    bases = spark.createDataFrame([("b", i, 0.5) for i, _ in texts], "base string, query_id int, outcome double")
    outcomes = spark.createDataFrame([("b", i, a, 0.9 if i % 2 and a == "up" else 0.1) for i, _ in texts for a in ("up", "down")], "base string, query_id int, action string, outcome double")
    got = {r.policy: r for r in policy.repeated_summary(policy.repeated(queries, bases, outcomes, seeds=2, folds=3)).collect()}
    assert set(got) == set(policy.POLICIES)
    assert got["local_mean"].n_seeds == 2 and got["local_mean"].coverage_mean == pytest.approx(0.5) and got["local_mean"].gain_mean == pytest.approx(0.2)
    routes = policy.transfer(queries.filter("query_id < 16"), queries.filter("query_id >= 16"), bases, outcomes)[0]
    local = {r.query_id: r.action for r in routes.filter("policy = 'local_mean'").collect()}
    assert local == {i: "up" if i % 2 else None for i in range(16, 24)}
    with pytest.raises(ValueError):
        policy.transfer(queries, queries.filter("query_id = 3"), bases, outcomes)


def test_router(spark):
    rows_ = [(m, i, *[float(m == ("A" if i % 3 == 0 else "C"))] * 5) for i in range(60) for m in "ABC"] + [(m, 60, 0.5, 0.5, 0.5, 0.5, 0.5) for m in "ABC"]
    measured = spark.createDataFrame(rows_, "method string, query_id int, r1 double, r5 double, r10 double, n10 double, mrr double")
    labels = router.labelled(measured, ["A", "B", "C"])
    assert {r.query_id: r.label for r in labels.collect()} == {**{i: 0 if i % 3 == 0 else 2 for i in range(60)}, 60: 2}
    assert {r.method: r.n for r in router.label_histogram(labels, ["A", "B", "C"]).collect()} == {"A": 20, "B": 0, "C": 41}
    folds = router.stratified_folds(labels, "label").groupBy("label", "fold").count().collect()
    assert {(r.label, r.fold): r["count"] for r in folds} == {**{(0, f): 4 for f in range(5)}, **{(2, f): 8 + (f == 0) for f in range(5)}}
    texts = spark.createDataFrame([(i, "what is 1999" if i % 3 == 0 else "Plain words of no question - HERE") for i in range(61)], "query_id int, text string")
    got = router.summary(router.route(texts, labels), measured, ["A", "B", "C"]).first()
    # Query 60 has the text of its label's opposite, and its methods tie at one half.
    assert got.n_queries == 61 and got.accuracy == pytest.approx(60 / 61) and got.n10 == pytest.approx(60.5 / 61)


def test_latent_scores(spark):
    texts = ["red apple pie", "green apple tart", "red red wine", "blue sea wave", "wave of the sea", "", "unseen"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    queries = spark.createDataFrame([(0, "apple"), (1, "sea and red"), (2, None)], "query_id int, text string")
    docs, asked = latent.latent_vectors(corpus, queries, rank=2, stop=["of", "the", "and"])
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.dense(docs, asked).collect()}
    known = ["red", "apple", "sea", "wave"]
    count = lambda t: np.array([t.lower().split().count(w) for w in known], float)
    tf = np.array([count(t) for t in texts])
    idf = np.log((1 + len(texts)) / (1 + (tf > 0).sum(axis=0))) + 1
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-9)
    x = unit(tf * idf)
    v = np.linalg.svd(x)[2][:2].T
    want = unit(unit(np.array([count(t) for t in ("apple", "sea and red", "")]) * idf) @ v) @ unit(x @ v).T
    assert len(got) == 21
    for (q, d), score in got.items():
        assert score == pytest.approx(want[q, d], abs=1e-6)
    none, _ = latent.latent_vectors(corpus.filter("doc_id > 4"), queries)
    assert [r.embedding for r in none.collect()] == [[0.0], [0.0]]


def test_bootstrap(spark):
    diffs = spark.createDataFrame([(i, float(i % 4)) for i in range(400)], "query_id int, diff double")
    got = stats.bootstrap(diffs, resamples=2000)
    low, high = got.first()
    error = 1.96 * np.std([0, 1, 2, 3]) / 20
    assert low == pytest.approx(1.5 - error, abs=0.02) and high == pytest.approx(1.5 + error, abs=0.02)
    assert got.first() == stats.bootstrap(diffs, resamples=2000).first()


def test_sampled_background(spark):
    known = spark.createDataFrame([(i,) for i in range(50)], "doc_id int")
    relevant = spark.createDataFrame([(3,), (3,), (4,)], "doc_id int")
    got = [r.doc_id for r in metadata.sampled_background(known, relevant).collect()]
    assert len(got) == len(set(got)) == 20 and not {3, 4} & set(got)
    assert len(metadata.sampled_background(known, relevant, times=100).collect()) == 48


def test_readers_and_stages(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"_id": "1", "text": null}\n{"_id": "2", "text": "x"}\n')
    texts = readers.query_texts(spark, str(tmp_path / "q.jsonl"))
    assert rows(texts, "query_id") == [("1", ""), ("2", "x")]
    assert readers.require_texts(texts.select("query_id"), texts).count() == 2
    with pytest.raises(Exception, match="no text for query 3"):
        readers.require_texts(spark.createDataFrame([("3",)], "query_id string"), texts).count()
    qrels = spark.createDataFrame([("1", "a", 2), ("2", "a", 0), ("2", "b", 1)], "query_id string, doc_id string, gain int")
    assert rows(readers.judged_sets(qrels), "doc_id", "relevant") == [("a", False), ("a", True), ("b", True)]
    (tmp_path / "b.csv").write_text('cord_uid,doi,publish_time,journal,s2_id,pubmed_id\nu1,10.1/x,2020,"a ""b"", c",s,7\nu2,,2021,j,,\n')
    wanted = spark.createDataFrame([("u1",)], "cord_uid string")
    assert [(r.cord_uid, r.journal) for r in readers.bibliography(spark, str(tmp_path / "b.csv"), wanted).collect()] == [("u1", 'a "b", c')]
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string"), spark.createDataFrame([(1, "c"), (2, "d")], "k int, y string")
    assert rows(readers.aligned(left, right, "k"), "k") == [(1, "a", "c"), (2, "b", "d")]
    for odd in (right.filter("k = 1"), right.unionByName(right)):
        with pytest.raises(Exception, match="keys aren't on both sides once"):
            readers.aligned(left, odd, "k").collect()
    made = []
    for _ in range(2):
        got = writers.stage(spark, str(tmp_path / "stage"), lambda: made.append(1) or left)
    assert rows(got, "k") == [(1, "a"), (2, "b")] and made == [1]
    writers.results(left.withColumn("dataset", F.lit("d")), str(tmp_path / "tall"))
    assert spark.read.parquet(str(tmp_path / "tall")).filter("dataset = 'd'").count() == 2
    writers.documents_json(left.select(F.struct("k", "x").alias("r")), str(tmp_path / "json"))
    assert {r.r.x for r in spark.read.json(str(tmp_path / "json")).collect()} == {"a", "b"}
    assert rows(readers.spread(left), "k") == rows(left, "k") and rows(writers.kept(left), "k") == rows(left, "k")


def test_encoder_and_language_model_are_given(spark):
    texts = spark.createDataFrame([("1", "ab"), ("2", None)], "doc_id string, text string")
    got = retrieval.encode_with(lambda x: np.array([[len(t), 1.0] for t in x]), texts, "query: ")
    assert rows(got.select("doc_id", "embedding"), "doc_id") == [("1", [9.0, 1.0]), ("2", [7.0, 1.0])]
    asked = spark.createDataFrame([("q", "c"), ("fail", "c")], "question string, context string")

    def client(prompt):
        if "fail" in prompt:
            raise OSError("down")
        return prompt.upper()

    got = generation.answered(asked, client, lambda q, c: f"{q} {c}", lambda q, a: f"judge {q} {a}").orderBy("question").collect()
    assert (got[0].answer, got[0].error) == (None, "down") and (got[1].answer, got[1].verdict, got[1].error) == ("Q C", "JUDGE Q Q C", None)
    records = got[1].asDict() | {"relevance": 3}
    assert generation.scored_well(spark.createDataFrame([(3, None), (0, None), (None, None), (4, "down")], "relevance int, error string")).count() == 1 and records["relevance"] == 3


def test_tasks_and_pairs(spark):
    runs = spark.createDataFrame([(m, q, d, r) for m in ("Neural-Hybrid", "CA-HR", "BM25") for q in (1, 2) for r, d in enumerate((7, 8, 9, 5, 6, 4), 1)], "method string, query_id int, doc_id int, rank int")
    corpus = spark.createDataFrame([(d, None if d == 7 else f"T{d}", "x" * 2000 if d == 8 else f"text {d}") for d in range(4, 10)], "doc_id int, title string, text string")
    queries = spark.createDataFrame([(1, "one", "d"), (2, "two", "d")], "query_id int, text string, dataset string")
    qrels = spark.createDataFrame([(1, 7, 1), (1, 4, 1), (1, 9, 0)], "query_id int, doc_id int, gain int")
    got = {(r.query_id, r.system): r for r in generation.tasks(runs, corpus, queries, qrels).collect()}
    assert set(got) == {(q, m) for q in (1, 2) for m in ("Neural-Hybrid", "CA-HR")}
    one = got[1, "CA-HR"]
    assert (one.doc_ids, one.n_rel_context, got[2, "CA-HR"].n_rel_context) == ([7, 8, 9, 5, 6], 1, 0)
    parts = one.context.split("\n\n")
    assert parts[0] == "[1] . text 7" and len(parts[1]) == 4 + 1200 and parts[4] == "[5] T6. text 6"
    assert generation.sampled_queries(queries, 1).count() == 1
    records = spark.createDataFrame([("d", q, s, t, float(q + (s == "a") + t)) for q in range(12) for s in "ab" for t in (0, 1)], "dataset string, query_id int, system string, turn int, x double")
    pairs = generation.paired(records, ["x"], "a", "b").collect()
    assert len(pairs) == 12 and {(r.b, r.diff) for r in pairs} == {(q + 1.0, 1.0) for q in range(12)}
    assert generation.paired(records.filter("query_id < 5"), ["x"], "a", "b").count() == 0


def test_tests_of_both_kinds(spark):
    df = spark.createDataFrame([("m", float(v)) for v in (1, 2, -3, 4, 0)], "method string, diff double")
    one, two, few = (stats.wilcoxon(df, ["method"], *a).first().p for a in (("greater",), ("two-sided",), ("greater", 5)))
    z = (7 - 5) / math.sqrt(7.5)
    assert one == pytest.approx(0.5 * math.erfc(z / math.sqrt(2))) and two == pytest.approx(2 * one) and few == 1
    with pytest.raises(ValueError):
        stats.wilcoxon(df, ["method"], "less")
    rows_ = spark.createDataFrame([(1, v, p) for v, p in ((1, False), (2, False), (2, True), (5, True), (7, True))], "g int, v int, p boolean")
    got = stats.mann_whitney(rows_, ["g"], "v", "p").first()
    z = (5.5 - 3 - 0.5) / math.sqrt(6 / 12 * (6 - 6 / 20))
    assert got.u == 5.5 and got.z == pytest.approx(z) and got.p == pytest.approx(math.erfc(z / math.sqrt(2)))


def test_effects_near_each_other(spark):
    """Variances far below the mean's square, which a difference of sums would lose."""
    df = spark.createDataFrame([("a", 1e6 + i * 1e-3, 0.5) for i in range(3)], "action string, effect double, sim double")
    assert stats.weighted_effects(df, ["action"]).first().variance == pytest.approx(1e-6, rel=1e-3)


def test_counted_measures(spark):
    """Measures from flags and counts are those from judgements."""
    run = spark.createDataFrame([("m", q, d, d) for q in (1, 2, 3) for d in range(1, 13)], "method string, query_id int, doc_id int, rank int")
    good = {(1, 2), (1, 7), (1, 12), (2, 1)}
    qrels = spark.createDataFrame([(q, d, 1) for q, d in good], "query_id int, doc_id int, gain int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    want = rows(metrics.per_query(run, qrels, queries).drop("method"), "query_id")
    flagged = run.join(qrels, ["query_id", "doc_id"], "left").select("query_id", "rank", F.col("gain").isNotNull().alias("relevant"))
    sizes = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "query_id int, n_rel long")
    got = rows(metrics.per_query_counted(flagged, sizes), "query_id")
    assert [tuple(round(x, 9) for x in r) for r in got] == [tuple(round(x, 9) for x in r) for r in want]
