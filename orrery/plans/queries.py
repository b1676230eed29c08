"""Queries by name; `orrery.plans.sql` has the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import text as T
from orrery.operators import generation, latent, metadata, metrics, policy, postings, retrieval, router, stats
from orrery.plans import frames
from orrery.sources.readers import first_supplied, table
from orrery.sources.writers import kept, missing, new_folder, write_checked

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROUTED = ["UMA-RAG", "LP-RAG", "CA-HR"]


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals: sums in another order differ far behind them."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def doc_length_stats(spark: SparkSession, d: str) -> DataFrame:
    n = frames.documents(spark, d).select(F.size(T.tokens(F.col("text"))).alias("n"))
    return rounded(n.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("mean_len"), F.min("n").alias("min_len"), F.max("n").alias("max_len"), F.median("n").alias("median_len")), "mean_len")


@query
def bm25_idf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.inverse_frequencies(frames.documents(spark, d)), "idf")


def _bm25_run(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.ranked(retrieval.bm25(frames.documents(spark, d), frames.items(spark, d)), ["query_id"])


@query
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_bm25_run(spark, d), "score")


@query
def bm25_indexed_topk(spark: SparkSession, d: str) -> DataFrame:
    """The same from an inverted index, which is written first."""
    path = new_folder(spark, "index")
    postings.write(frames.documents(spark, d), path)
    return rounded(retrieval.ranked(postings.search(postings.read(spark, path), frames.items(spark, d)), ["query_id"]), "score")


@query
def judgements(spark: SparkSession, d: str) -> DataFrame:
    return frames.judged(spark, d, frames.documents(spark, d), frames.items(spark, d))


def _bm25_measured(spark: SparkSession, d: str) -> DataFrame:
    docs, items = frames.documents(spark, d), frames.items(spark, d)
    return metrics.per_query(_bm25_run(spark, d).withColumn("method", F.lit("BM25")), frames.judged(spark, d, docs, items), items)


@query
def bm25_metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_bm25_measured(spark, d), *metrics.MEASURES)


@query
def bm25_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.means(_bm25_measured(spark, d)), *metrics.MEASURES)


def _dense_run(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    docs = vectors.select(F.col("vec_id").alias("doc_id"), "embedding")
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.ranked(retrieval.dense(docs, queries, retrieval.TOP + 1).filter("query_id <> doc_id"), ["query_id"])  # one more, for its own


@query
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_dense_run(spark, d), "score")


@query
def dense_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    """A vector is relevant for another one with its label. Relevant ones are counted by label, and only those found are looked at."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "label")
    run = _dense_run(spark, d).select("query_id", "doc_id", "rank").join(F.broadcast(q), "query_id").join(v.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("own")), "doc_id")
    sizes = q.join(v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_rel")), "label").select("query_id", "n_rel")
    return rounded(metrics.means(metrics.per_query_counted(run.select("query_id", "rank", (F.col("label") == F.col("own")).alias("relevant")), sizes).withColumn("method", F.lit("Dense"))), *metrics.MEASURES)


@query
def metadata_signals(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.signals(frames.papers(spark, d)), "c", "r", "v")


def _run_of(method: str, second: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(retrieval.run_of(*_sides(spark, d, second), method).drop("method"), "score")

    return run


def _sides(spark: SparkSession, d: str, second: bool = False) -> tuple[DataFrame, DataFrame]:
    """Corpus and queries, with the first or the second encoder's vectors."""
    return (frames.other_papers(spark, d), frames.other_topics(spark, d)) if second else (frames.papers(spark, d), frames.topics(spark, d))


RUNS = {"hybrid_topk": "Neural-Hybrid", "alpha_topk": "Alpha-Hybrid", "uma_topk": "UMA-RAG", "lp_topk": "LP-RAG", "cahr_topk": "CA-HR"}
QUERIES.update({name: _run_of(method) for name, method in RUNS.items()})
#: The same by the second encoder.
OTHER_RUNS = {"second_dense_topk": "SBERT-Dense", "second_hybrid_topk": "Neural-Hybrid", "second_cahr_topk": "CA-HR"}
QUERIES.update({name: _run_of(method, True) for name, method in OTHER_RUNS.items()})


@query
def rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.reciprocal_ranks(*_sides(spark, d)), "score")


@query
def second_rrf_topk(spark: SparkSession, d: str) -> DataFrame:
    return rounded(retrieval.reciprocal_ranks(*_sides(spark, d, True)), "score")


def _measured(spark: SparkSession, d: str, run: DataFrame, by: str = "method") -> DataFrame:
    topics = frames.topics(spark, d)
    # A few rows for each query and method, and few judgements, which the measures read more than once. Texts are looked through as they
    # are read: only the documents found are held against those that are papers.
    qrels = frames.judged(spark, d, frames.documents(spark, d), topics).join(frames.papers(spark, d).select("doc_id"), "doc_id", "left_semi")
    return metrics.per_query(kept(run), kept(qrels), topics, by)


def _all_runs(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.all_runs(kept(retrieval.score_table(*_sides(spark, d), alphas=(retrieval.ALPHA,))))


def _all_measured(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, _all_runs(spark, d))


@query
def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_all_measured(spark, d), *metrics.MEASURES)


@query
def metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.means(_all_measured(spark, d)), *metrics.MEASURES)


@query
def metrics_by_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Means of each dataset and method, and the mean of these over the datasets as dataset `macro`."""
    measured = _all_measured(spark, d).withColumn("dataset", frames.dataset_of("query_id"))
    return rounded(metrics.over_datasets(measured), *metrics.MEASURES)


@query
def oracle_routed(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.oracle(_all_measured(spark, d), ROUTED), "best_mean", "oracle", "headroom")


@query
def oracle_measures(spark: SparkSession, d: str) -> DataFrame:
    """The best routed method of each query by each measure, and what it gains over the best mean."""
    return rounded(metrics.oracles(_all_measured(spark, d), ROUTED), "best_mean", "oracle", "headroom")


@query
def relative_gains(spark: SparkSession, d: str) -> DataFrame:
    """What CA-HR's means have more than each other method's, also in percent of these."""
    return rounded(metrics.relative_gains(_all_measured(spark, d), "CA-HR"), "own", "other", "difference", "percent")


@query
def ablation_grid(spark: SparkSession, d: str) -> DataFrame:
    run = retrieval.reranked_corpus(*_sides(spark, d), retrieval.ABLATIONS)
    return rounded(metrics.means(_measured(spark, d, run, "variant"), "variant"), *metrics.MEASURES)


def _sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the grid by the second encoder, and of its hybrid as variant `hybrid`."""
    run = retrieval.reranked_corpus(*_sides(spark, d, True), [*retrieval.SENSITIVITY, ("hybrid", 0.5, 0.0, 0.0)])
    return _measured(spark, d, run, "variant")


@query
def sensitivity_grid(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.means(_sensitivity(spark, d), "variant"), *metrics.MEASURES)


def _action_measures(spark: SparkSession, d: str, actions: bool = True) -> DataFrame:
    """`base`, `action` (none: the base itself), `query_id` and measures of all actions, or of none, on the four content bases.

    Documents are scored once for both encoders.
    """
    bases = {second: retrieval.available_bases(not second, second) for second in (False, True)}
    alphas = tuple(sorted({retrieval.BASES[base][1] for own in bases.values() for base in own}))
    found = kept(retrieval.score_table(frames.both_papers(spark, d), frames.both_topics(spark, d), wanted=(), alphas=alphas))
    runs = None
    for second, own in bases.items():
        grid = [row for base, alpha in ((base, retrieval.BASES[base][1]) for base in own) for row in [*(retrieval.action_grid(alpha, base) if actions else ()), (f"{base}|none", alpha, 0.0, 0.0)]]
        mine = found.filter(F.col("query_id").startswith("second|" if second else "first|")).withColumn("query_id", F.substring_index("query_id", "|", -1).cast("long"))
        run = retrieval.reranked(mine, grid)
        runs = run if runs is None else runs.unionByName(run)
    measured = _measured(spark, d, runs, "variant")
    return measured.withColumns({"base": F.substring_index("variant", "|", 1), "action": F.substring_index("variant", "|", -1)}).drop("variant")


@query
def action_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_action_measures(spark, d).select("base", "action", "query_id", F.col("n10").alias("outcome")), "outcome")


@query
def archive_audit(spark: SparkSession, d: str) -> DataFrame:
    """For each content base its number of actions and queries, and whether every query has each action once."""
    return metrics.audit(_action_measures(spark, d).filter("action <> 'none'"), "base", "action", len(retrieval.ACTIONS))


@query
def content_results(spark: SparkSession, d: str) -> DataFrame:
    """A column for each content base: every query's NDCG."""
    rows = _action_measures(spark, d, actions=False)
    wide = rows.groupBy("query_id").agg(*[F.max(F.when(F.col("base") == b, F.col("n10"))).alias(b.lower().replace("-", "_")) for b in ("SBERT-Dense", "BGE-Dense", "Neural-Hybrid", "BGE-Hybrid")])
    return rounded(wide, *wide.columns[1:])


@query
def reconstruction_check(spark: SparkSession, d: str) -> DataFrame:
    """The hybrid as a re-ranking without weights against the hybrid ranked directly: shift of the mean, share of queries that differ, verdict."""
    own = _action_measures(spark, d, actions=False).filter("base = 'Neural-Hybrid'").select("query_id", F.col("n10").alias("rebuilt"))
    released = _measured(spark, d, retrieval.run_of(*_sides(spark, d), "Neural-Hybrid")).select("query_id", F.col("n10").alias("released"))
    return rounded(metrics.reconstruction(own.join(released, "query_id")), "mean_shift", "mismatches")


def _diffs(spark: SparkSession, d: str) -> DataFrame:
    # Numbers for each query and method, of which both sides of a pair are taken.
    return metrics.paired(kept(_all_measured(spark, d)), "CA-HR")


@query
def paired_effects(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.cohens_d(_diffs(spark, d), ["method", "measure"]), "mean", "sd", "d")


@query
def signed_ranks(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.signed_rank(_diffs(spark, d), ["method", "measure"]), "w_plus", "z")


@query
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return _diffs(spark, d).groupBy("method", "measure").agg(*metrics.outcome_counts())


@query
def wilcoxon_holm(spark: SparkSession, d: str) -> DataFrame:
    """One-sided tests by all measures, those with fewer than five differences at 1, adjusted within each measure."""
    tests = stats.wilcoxon(_diffs(spark, d), ["method", "measure"], least=5)
    return rounded(stats.holm(tests.select("measure", "method", "n", "p"), ["measure"]), "p", "p_holm")


@query
def encoder_tests(spark: SparkSession, d: str) -> DataFrame:
    """The second encoder's NDCG against the first one's, method by method: signed ranks, two-sided p, effect."""
    values = None
    for second in (False, True):
        runs = retrieval.all_runs(retrieval.score_table(*_sides(spark, d, second), wanted=("BM25", "SBERT-Dense", "Neural-Hybrid", "Alpha-Hybrid", "UMA-RAG", "LP-RAG"), alphas=(retrieval.ALPHA,)))
        own = _measured(spark, d, runs).select("method", "query_id", F.col("n10").alias("second" if second else "first"))
        values = own if values is None else values.join(own, ["method", "query_id"])
    diffs = values.filter("method <> 'BM25'").select("method", "query_id", (F.col("second") - F.col("first")).alias("diff"))
    effects = stats.cohens_d(diffs, ["method"]).select("method", "mean", "d")
    return rounded(stats.wilcoxon(diffs, ["method"], "two-sided").select("method", "w_plus", "n", "z", "p").join(effects, "method"), "w_plus", "z", "p", "mean", "d")


@query
def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.bootstrap(_diffs(spark, d).filter("method = 'BM25' AND measure = 'n10'")), "low", "high")


@query
def metadata_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    papers = frames.documents(spark, d).join(frames.bibliography(spark, d), "doc_id")
    found = metadata.diagnostics(papers, frames.judged(spark, d, papers, frames.items(spark, d)))
    numbers = ("coverage", "mean_citations", "zero_share", "mean_positive", "mean_background", "auc", "low", "high", "z")
    return rounded(found.drop("p"), *numbers)


@query
def second_pass(spark: SparkSession, d: str) -> DataFrame:
    """Parts without a record, asked for again under another key; a stand-in for the service knows two thirds of them."""
    known = frames.bibliography(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    keys = known.select("doc_id", F.concat(F.lit("k"), F.col("doc_id").cast("long") + 1).alias("key"))
    service = lambda wanted: [None if int(k[1:]) % 3 == 0 else {"citations": int(k[1:]) % 50, "year": 2000, "venue": k} for k in wanted]
    return metadata.second_pass(known, keys, service)


@query
def doi_chain(spark: SparkSession, d: str) -> DataFrame:
    """Parts as rows that share DOIs, suppliers as the records these lead to."""
    part = table(spark, d, "part")
    rows = part.select((F.col("p_partkey") - 1).alias("doc_id"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("10.X/"), F.col("p_partkey") % 1001)).alias("doi"), F.when(F.col("p_size") > 10, (F.col("p_size") + 1950).cast("string")).otherwise("n/a").alias("year"), F.col("p_brand").alias("venue"))
    records = table(spark, d, "supplier").select(F.concat(F.lit("10.x/"), "s_suppkey").alias("doi"), F.col("s_nationkey").alias("citations"), F.when(F.col("s_suppkey") % 2 == 0, 2010).otherwise(0).alias("year"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise("").alias("venue"))
    return metadata.by_doi(frames.documents(spark, d), rows, records)


@query
def query_features(spark: SparkSession, d: str) -> DataFrame:
    # The words in a step of their own, so that they are found once for all features.
    texts = frames.documents(spark, d).withColumn("w", T.words(F.col("text")))
    features = T.query_features(F.col("text"), F.col("w"))
    return texts.select("doc_id", *[F.round(c, 6).alias(name) for name, c in features.items()])


@query
def word_drop(spark: SparkSession, d: str) -> DataFrame:
    return frames.items(spark, d).select("query_id", T.drop_words(F.col("text"), F.col("query_id"), 0.3).alias("text"))


@query
def robustness(spark: SparkSession, d: str) -> DataFrame:
    """Three methods on queries without a tenth to four tenths of their words."""
    papers, topics = _sides(spark, d)
    noisy = None
    for share in (0.1, 0.2, 0.3, 0.4):
        # Two steps: within the lambda that drops words, a name made in the same select would stand for the new column.
        dropped = topics.select("query_id", T.drop_words(F.col("text"), F.col("query_id"), share).alias("text"), "embedding")
        dropped = dropped.withColumn("query_id", F.concat(F.lit(f"{share}|"), "query_id"))
        noisy = dropped if noisy is None else noisy.unionByName(dropped)
    found = retrieval.score_table(papers, noisy, wanted=("BM25", "Neural-Hybrid"), alphas=(retrieval.ALPHA,))
    run = retrieval.ranked_methods(found, ("BM25", "Neural-Hybrid")).unionByName(retrieval.reranked(found, [retrieval.CA_HR]).withColumnRenamed("variant", "method"))
    run = run.withColumn("method", F.concat_ws("|", F.substring_index("query_id", "|", 1), "method")).withColumn("query_id", F.substring_index("query_id", "|", -1).cast("long"))
    means = metrics.means(_measured(spark, d, run))
    return rounded(means.select(F.substring_index("method", "|", 1).alias("noise"), F.substring_index("method", "|", -1).alias("method"), *metrics.MEASURES, "n_queries"), *metrics.MEASURES)


@query
def keep_best(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as bibliographic rows: of each part's, the first that wasn't returned, or else the first."""
    rows = table(spark, d, "lineitem").select("l_partkey", "l_orderkey", F.when(F.col("l_returnflag") == "N", F.col("l_linestatus")).otherwise("").alias("doi"), F.struct("l_orderkey", "l_linenumber").alias("row_pos"))
    return first_supplied(rows, "l_partkey", "row_pos", "doi").select("l_partkey", "l_orderkey", "doi")


@query
def merge_fields(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as duplicates of a record, merged in order."""
    rows = table(spark, d, "lineitem").select("l_partkey", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise("").alias("flag"), F.when(F.col("l_returnflag") == "N", F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise("").alias("shipped"), (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("row_pos"))
    return metadata.merged(rows, "l_partkey", "row_pos", ["flag", "shipped"], strip=False)


@query
def resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents that have no label yet."""
    return missing(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), ["doc_id"])


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Answers of two systems to each turn that has one: the turn's text, citing three numbers that depend on the ids and the system."""
    turns = table(spark, d, "conversations").filter("role = 'assistant'").withColumn("s", F.explode(F.array(F.lit(0), F.lit(1))))
    cite = lambda a: F.concat(F.lit(" ["), (F.col("conv_id") * a + F.col("turn") + 2 * F.col("s")) % 7, F.lit("]"))
    ids = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.col("conv_id") * 5 + i)
    verdict = F.concat(F.lit('Verdict: {"relevance": '), ((F.col("conv_id") + F.col("s")) % 5 + 1).cast("string"), F.when(F.col("turn") % 3 == 0, F.lit("}")).otherwise(F.concat(F.lit(', "faithfulness": '), ((F.col("turn") + F.col("conv_id") * F.col("s")) % 5 + 1).cast("string"), F.lit("}"))))
    return turns.select(F.col("conv_id").alias("query_id"), "turn", F.when(F.col("s") == 0, "plain").otherwise("guided").alias("system"), F.concat(F.lit("d"), F.col("conv_id") % 3).alias("dataset"), F.concat(F.coalesce("text", F.lit("")), cite(1), cite(3), cite(1)).alias("answer"), ids.alias("doc_ids"), verdict.alias("verdict"))


def _answer_judgements(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "conversations").select("conv_id").distinct()
    return ids.select(F.col("conv_id").alias("query_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select("query_id", (F.col("query_id") * 5 + F.col("i")).alias("doc_id"), F.when((F.col("query_id") + F.col("i")) % 2 == 0, 1).otherwise(0).alias("gain"))


@query
def citation_precision(spark: SparkSession, d: str) -> DataFrame:
    out = generation.citation_precision(_records(spark, d), _answer_judgements(spark, d))
    return rounded(out.select("query_id", "turn", "system", "n_citations", "citation_precision"), "citation_precision")


MEASURED = ["relevance", "faithfulness", "citation_precision", "n_citations"]


def _judged_records(spark: SparkSession, d: str) -> DataFrame:
    return generation.scored_well(generation.judged(generation.citation_precision(_records(spark, d), _answer_judgements(spark, d))))


@query
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(generation.summary(_judged_records(spark, d), MEASURED), *[f"{m}_{s}" for m in MEASURED for s in ("mean", "std")])


@query
def generation_paired(spark: SparkSession, d: str) -> DataFrame:
    """Both systems on the same queries: means, signed ranks over differences that aren't zero, and their score."""
    pairs = generation.paired(_judged_records(spark, d), MEASURED, "plain", "guided")
    means = pairs.groupBy("measure").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("a").alias("mean_plain"), F.avg("b").alias("mean_guided"))
    ranks = stats.signed_rank(pairs, ["measure"]).select("measure", "w_plus", "z")
    return rounded(means.join(ranks, "measure", "left").fillna(0.0, ["w_plus", "z"]), "mean_plain", "mean_guided", "w_plus", "z")


def _titled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), "text")


@query
def generation_contexts(spark: SparkSession, d: str) -> DataFrame:
    return generation.contexts(_bm25_run(spark, d), _titled(spark, d)).select("query_id", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"), F.md5("context").alias("context_md5"))


@query
def generation_tasks(spark: SparkSession, d: str) -> DataFrame:
    """What two systems would be asked, for a sample of each dataset's queries."""
    papers, topics = _sides(spark, d)
    found = retrieval.score_table(papers, topics, wanted=("Neural-Hybrid",), alphas=(retrieval.ALPHA,))
    runs = retrieval.ranked_methods(found, ("Neural-Hybrid",)).unionByName(retrieval.reranked(found, [retrieval.CA_HR]).withColumnRenamed("variant", "method"))
    tasks = generation.tasks(runs, _titled(spark, d), topics.withColumn("dataset", frames.dataset_of("query_id")), frames.judged(spark, d, papers, topics), most=10)
    return tasks.select("dataset", "query_id", "system", F.array_join(F.col("doc_ids").cast("array<string>"), ",").alias("doc_ids"), "n_rel_context", F.md5("context").alias("context_md5"))


@query
def folds(spark: SparkSession, d: str) -> DataFrame:
    return policy.with_folds(frames.items(spark, d)).select("query_id", "fold")


def _policy_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, what each content base gives them, and what each action gives on each base, by NDCG."""
    # A few numbers for each query, which every step of the policy reads again.
    rows = kept(_action_measures(spark, d).select("base", "action", "query_id", F.col("n10").alias("outcome")))
    return frames.topics(spark, d).select("query_id", "text"), rows.filter("action = 'none'").drop("action"), rows.filter("action <> 'none'")


def _route(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return policy.route(*_policy_tables(spark, d))


@query
def policy_bases(spark: SparkSession, d: str) -> DataFrame:
    """The content base that each fold falls back to: the best one on the other folds' queries."""
    queries, bases, _ = _policy_tables(spark, d)
    return policy.best_bases(policy.splits(policy.with_folds(queries)), bases)


@query
def policy_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Each query's nearest training queries."""
    return rounded(policy.neighbours(policy.splits(policy.with_folds(frames.topics(spark, d).select("query_id", "text")))), "sim")


@query
def policy_routes(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_route(spark, d)[0], "score", "outcome", "fallback")


@query
def policy_summary(spark: SparkSession, d: str) -> DataFrame:
    routes = _route(spark, d)[0]
    out = policy.with_p(policy.summary(routes)).join(policy.intervals(routes), "policy")
    return rounded(out, "outcome", "fallback", "gain", "coverage", "w_plus", "z", "p", "low", "high")


@query
def policy_datasets(spark: SparkSession, d: str) -> DataFrame:
    """The strict policy against its fallback, cross-fitted and tested dataset by dataset."""
    queries, bases, outcomes = _policy_tables(spark, d)
    routes = kept(policy.route_datasets(queries.withColumn("dataset", frames.dataset_of("query_id")), bases, outcomes))
    return rounded(policy.primary_family(routes), "outcome", "fallback", "gain", "coverage", "d", "p", "p_holm")


@query
def action_archive(spark: SparkSession, d: str) -> DataFrame:
    """Every query's outcomes of all actions on all bases, written under checks that fail the write, and read back."""
    path = new_folder(spark, "archive")
    rows = metrics.archive(_action_measures(spark, d).select("base", "action", "query_id", F.col("n10").alias("outcome")))
    write_checked(rows, path, metrics.archive_checks(list(retrieval.BASES), [name for name, *_ in retrieval.ACTIONS]))
    told = spark.read.parquet(path).select("query_id", F.inline("outcomes"))
    fallback = told.filter("action = 'none'").select("query_id", "base", F.col("outcome").alias("fallback"))
    return rounded(told.filter("action <> 'none'").join(fallback, ["query_id", "base"]), "fallback", "outcome")


@query
def selected_counts(spark: SparkSession, d: str) -> DataFrame:
    return policy.selected_counts(_route(spark, d)[0])


@query
def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    queries, bases, outcomes = _policy_tables(spark, d)
    _, scored, fallback = policy.route(queries, bases, outcomes)
    return rounded(policy.risk_coverage(scored, fallback, outcomes), "coverage", "gain")


@query
def policy_ablations(spark: SparkSession, d: str) -> DataFrame:
    """The strict policy with one family of features, and with half and double the neighbours."""
    tables, every = _policy_tables(spark, d), None
    for name, mode, multiplier in (("word_only", "word", 1.0), ("char_only", "char", 1.0), ("k_half", "both", 0.5), ("k_double", "both", 2.0)):
        one = policy.summary(policy.route(*tables, mode=mode, multiplier=multiplier)[0]).withColumn("ablation", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return rounded(every.filter("policy = 'pessimistic'"), "outcome", "fallback", "gain", "coverage", "w_plus", "z")


@query
def policy_repeats(spark: SparkSession, d: str) -> DataFrame:
    out = policy.repeated_summary(policy.repeated(*_policy_tables(spark, d)))
    return rounded(out, *[c for c in out.columns if c not in ("policy", "n_seeds")])


@query
def policy_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Learned from three fifths of the queries, used on the others."""
    queries, bases, outcomes = _policy_tables(spark, d)
    told = policy.with_folds(queries)
    routes = policy.transfer(told.filter("fold < 3"), told.filter("fold >= 3"), bases, outcomes)[0]
    return rounded(policy.summary(routes), "outcome", "fallback", "gain", "coverage", "w_plus", "z")


@query
def report_primary(spark: SparkSession, d: str) -> DataFrame:
    """The table of main results as text: each dataset's and method's means with four decimals."""
    measured = _all_measured(spark, d).withColumn("dataset", frames.dataset_of("query_id"))
    return metrics.over_datasets(measured).select("dataset", "method", *[T.decimals(F.col(m)).alias(m) for m in metrics.MEASURES], F.col("n_queries").cast("string").alias("n_queries"))


@query
def report_datasets(spark: SparkSession, d: str) -> DataFrame:
    """The table of datasets: queries, judgements, and how much of the corpus has which metadata, in percent."""
    papers, topics = _sides(spark, d)
    qrels = frames.judged(spark, d, papers, topics).withColumn("dataset", frames.dataset_of("query_id"))
    queries = topics.groupBy(frames.dataset_of("query_id").alias("dataset")).agg(F.count(F.lit(1)).alias("n_queries"))
    judged = qrels.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_judgements"))
    share = lambda c: T.percent(F.avg(F.col(c).isNotNull().cast("double"))).alias(f"{c}_share")
    corpus = papers.agg(F.count(F.lit(1)).alias("n_docs"), *[share(c) for c in ("citations", "year", "venue")])
    return queries.join(judged, "dataset", "left").fillna(0, ["n_judgements"]).crossJoin(F.broadcast(corpus))


@query
def router_labels(spark: SparkSession, d: str) -> DataFrame:
    """The method that each query is best served by, and its fold."""
    return router.stratified_folds(router.labelled(_all_measured(spark, d), ROUTED), "label")


@query
def label_histogram(spark: SparkSession, d: str) -> DataFrame:
    return router.label_histogram(router.labelled(_all_measured(spark, d), ROUTED), ROUTED)


@query
def router_summary(spark: SparkSession, d: str) -> DataFrame:
    measured = kept(_all_measured(spark, d))
    routes = router.route(frames.topics(spark, d).select("query_id", "text"), router.labelled(measured, ROUTED))
    return rounded(router.summary(routes, measured, ROUTED), "accuracy", "macro_f1", "kappa", *metrics.MEASURES)


def _sensitivity_tests(spark: SparkSession, d: str) -> DataFrame:
    measured = _sensitivity(spark, d)
    base = measured.filter("variant = 'hybrid'").select("query_id", F.col("n10").alias("own"))
    diffs = measured.filter("variant <> 'hybrid'").join(base, "query_id").select("variant", "query_id", "n10", "own", (F.col("n10") - F.col("own")).alias("diff"))
    gains = diffs.groupBy("variant").agg(F.avg("n10").alias("n10"), F.avg("own").alias("hybrid_n10"), F.avg("diff").alias("gain"))
    tests = stats.wilcoxon(diffs, ["variant"]).withColumn("family", F.lit("grid")).select("family", "variant", "p")
    return stats.holm(tests, ["family"]).drop("family").join(gains, "variant")


@query
def sensitivity_tests(spark: SparkSession, d: str) -> DataFrame:
    """Each pair of weights against the hybrid without metadata, by signed ranks; p-values after Holm over the grid."""
    return rounded(_sensitivity_tests(spark, d), "p", "p_holm", "n10", "hybrid_n10", "gain")


@query
def sensitivity_best(spark: SparkSession, d: str) -> DataFrame:
    """The best pair of weights, the hybrid, and whether the surest pair gains something after Holm."""
    rows = _sensitivity_tests(spark, d)
    # Of equal means the first of the grid counts.
    place = F.array_position(F.array(*[F.lit(row[0]) for row in retrieval.SENSITIVITY]), F.col("variant"))
    best = F.max_by("variant", F.struct(F.round("n10", 9), -place)).alias("best")
    sure = F.min_by(F.struct("p_holm", "gain"), F.struct(F.col("p_holm"), F.col("variant")))
    out = rows.agg(best, F.max("n10").alias("best_n10"), F.first("hybrid_n10").alias("hybrid_n10"), sure.alias("s"))
    return rounded(out.select("best", "best_n10", "hybrid_n10", F.col("s.p_holm").alias("least_p"), ((F.col("s.p_holm") < 0.05) & (F.col("s.gain") > 0)).alias("any_significant_gain")), "best_n10", "hybrid_n10", "least_p")


@query
def query_sample(spark: SparkSession, d: str) -> DataFrame:
    """Ten queries of each dataset, drawn by md5."""
    return generation.sampled_queries(frames.items(spark, d).withColumn("dataset", frames.dataset_of("query_id")), 10).select("dataset", "query_id")


@query
def background_sample(spark: SparkSession, d: str) -> DataFrame:
    papers = frames.documents(spark, d).join(frames.bibliography(spark, d), "doc_id").filter("has_record")
    return metadata.sampled_background(papers, frames.judged(spark, d, frames.documents(spark, d), frames.items(spark, d)))


def _seven_measured(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the seven compared methods, of which one ranks by latent-semantic vectors of the same corpus."""
    papers, topics = frames.papers(spark, d), frames.topics(spark, d)
    docs, asked = latent.latent_vectors(papers.select("doc_id", "text"), topics.select("query_id", "text"))
    latent_run = retrieval.ranked(retrieval.dense(docs, asked), ["query_id"]).withColumn("method", F.lit("LSA-Dense"))
    return _measured(spark, d, _all_runs(spark, d).filter("method <> 'Alpha-Hybrid'").unionByName(latent_run))


@query
def seven_metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.means(_seven_measured(spark, d)), *metrics.MEASURES)


@query
def seven_wilcoxon_holm(spark: SparkSession, d: str) -> DataFrame:
    """CA-HR against the six other methods by all measures: effects, one-sided tests, p-values after Holm within each measure."""
    diffs = kept(metrics.paired(_seven_measured(spark, d), "CA-HR"))
    tests = stats.holm(stats.wilcoxon(diffs, ["method", "measure"], least=5).select("measure", "method", "n", "p"), ["measure"])
    return rounded(tests.join(stats.cohens_d(diffs, ["method", "measure"]).select("method", "measure", "mean", "d"), ["method", "measure"]), "p", "p_holm", "mean", "d")


@query
def latent_topk(spark: SparkSession, d: str) -> DataFrame:
    docs, queries = latent.latent_vectors(frames.documents(spark, d), frames.items(spark, d))
    return rounded(retrieval.ranked(retrieval.dense(docs, queries, retrieval.TOP), ["query_id"]), "score")
