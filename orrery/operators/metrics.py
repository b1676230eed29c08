"""Measures of rankings against judgements, and how methods compare by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import word_grams, words

MEASURES = ("r1", "r5", "r10", "n10", "mrr")
#: Characters of queries whose runs of words go to all tasks.
SHARED_CHARS = 1_000_000


def overlap_judgements(docs: DataFrame, queries: DataFrame, width: int = 8) -> DataFrame:
    """`query_id`, `doc_id` that share a run of `width` words (lower-cased, between white space)."""
    def runs(df: DataFrame, key: str) -> DataFrame:
        # The words are a column of their own, so that they are made once a row and not once a run.
        told = df.select(key, words(F.lower("text")).alias("terms")).filter(F.size("terms") >= width)
        return told.select(key, F.explode(F.array_distinct(word_grams(F.col("terms"), width))).alias("run"))

    asked = runs(queries, "query_id")
    # Where queries are few, documents' runs are looked up where they are made: dealt out, they are many times the corpus.
    if (queries.agg(F.sum(F.length("text"))).first()[0] or 0) <= SHARED_CHARS:
        asked = F.broadcast(asked)
    return runs(docs, "doc_id").join(asked, "run").select("query_id", "doc_id").distinct()


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, by: str = "method") -> DataFrame:
    """One row for each method of the run and each query: recall at 1, 5 and 10, NDCG at 10 (linear gain), reciprocal rank.

    qrels (query_id, doc_id, gain) must name documents of the corpus only. Queries without relevant documents, and those for
    which a method finds nothing, get zeros.
    """
    ideal = qrels.filter("gain >= 1").withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "doc_id")))
    ideal = ideal.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rel"), F.sum(F.when(F.col("at") <= 10, F.col("gain") / F.log2(F.col("at") + 1.0))).alias("ideal"))
    hits = lambda k: F.sum(F.when(F.col("rank") <= k, 1).otherwise(0))
    # Only judged documents count, so that the others needn't be grouped.
    found = run.join(qrels.filter("gain >= 1"), ["query_id", "doc_id"]).groupBy(by, "query_id").agg(
        hits(1).alias("h1"), hits(5).alias("h5"), hits(10).alias("h10"),
        F.sum(F.when(F.col("rank") <= 10, F.col("gain") / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"),
        F.min("rank").alias("first"),
    )
    methods = run.select(by).distinct()
    every = queries.select("query_id").join(ideal, "query_id", "left").crossJoin(F.broadcast(methods))
    joined = every.join(found, [by, "query_id"], "left")
    share = lambda c: F.when(F.col("n_rel") > 0, F.coalesce(c, F.lit(0)) / F.col("n_rel")).otherwise(F.lit(0.0))
    return joined.select(by, "query_id", share("h1").alias("r1"), share("h5").alias("r5"), share("h10").alias("r10"), F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(F.lit(0.0)).alias("n10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def per_query_counted(run: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same measures where all gains are 1: from a ranking with a flag `relevant`, and `sizes` (query_id, n_rel)."""
    flag = F.col("relevant").cast("int")
    hits = lambda k: F.sum(F.when(F.col("rank") <= k, flag).otherwise(0))
    found = run.groupBy("query_id").agg(hits(1).alias("h1"), hits(5).alias("h5"), hits(10).alias("h10"), F.sum(F.when(F.col("rank") <= 10, flag / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    told = sizes.join(found, "query_id", "left")
    n = F.col("n_rel")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    share = lambda c: F.when(n > 0, F.coalesce(c, F.lit(0)) / n).otherwise(F.lit(0.0))
    return told.select("query_id", share("h1").alias("r1"), share("h5").alias("r5"), share("h10").alias("r10"), F.when(n > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(F.lit(0.0)).alias("n10"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"))


def means(measured: DataFrame, by: str = "method") -> DataFrame:
    """Macro means of every measure."""
    return measured.groupBy(by).agg(*[F.avg(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("n_queries"))


def over_datasets(measured: DataFrame) -> DataFrame:
    """Means of each `dataset` and method, and as dataset `macro` each method's mean of these."""
    each = measured.groupBy("dataset", "method").agg(*[F.avg(m).alias(m) for m in MEASURES], F.count(F.lit(1)).alias("n_queries"))
    whole = each.groupBy("method").agg(*[F.avg(m).alias(m) for m in MEASURES], F.sum("n_queries").alias("n_queries")).withColumn("dataset", F.lit("macro"))
    return each.unionByName(whole)


def relative_gains(measured: DataFrame, own: str) -> DataFrame:
    """For each other method and measure both means, their difference, and this in percent of the other (null if that is 0)."""
    mean = long(measured).groupBy("method", "measure").agg(F.avg("value").alias("mean"))
    mine = mean.filter(F.col("method") == own).select("measure", F.col("mean").alias("own"))
    told = mean.filter(F.col("method") != own).join(F.broadcast(mine), "measure")
    gap = F.col("own") - F.col("mean")
    return told.select("method", "measure", "own", F.col("mean").alias("other"), gap.alias("difference"), (100 * gap / F.nullif("mean", F.lit(0.0))).alias("percent"))


def audit(rows: DataFrame, by: str, part: str, wanted: int) -> DataFrame:
    """For each `by` the number of parts and queries, and whether every query has all `wanted` parts, each once."""
    per = rows.groupBy(by, "query_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(part).alias("parts"))
    whole = rows.groupBy(by).agg(F.countDistinct(part).alias("n_parts"))
    return per.groupBy(by).agg(F.count(F.lit(1)).alias("n_queries"), F.min((F.col("n") == wanted) & (F.col("parts") == wanted)).alias("complete")).join(whole, by)


def reconstruction(both: DataFrame, most_shift: float = 1e-3, most_mismatches: float = 0.01) -> DataFrame:
    """One row: how far the mean of `rebuilt` is from that of `released`, the share of queries that differ, whether both are small enough."""
    gap = F.col("rebuilt") - F.col("released")
    told = both.agg(F.count(F.lit(1)).alias("n_queries"), F.abs(F.avg(gap)).alias("mean_shift"), F.avg((F.abs(gap) > 1e-9).cast("double")).alias("mismatches"))
    return told.withColumn("ok", (F.col("mean_shift") <= most_shift) & (F.col("mismatches") <= most_mismatches))


def reconstruction_checks(most_shift: float = 1e-3, most_mismatches: float = 0.01) -> dict[str, Column]:
    """The same limits as checks on the rows `rebuilt`, `released` while they are written (`writers.write_checked`)."""
    gap = F.col("rebuilt") - F.col("released")
    near = F.abs(F.avg(gap)) <= most_shift
    few = F.sum((F.abs(gap) > 1e-9).cast("long")) <= F.ceil(most_mismatches * F.count(F.lit(1)))
    return {"mean of rebuilt is near that of released": near, "few queries differ": few, "no outcome is missing": F.bool_and(gap.isNotNull())}


def archive(rows: DataFrame) -> DataFrame:
    """From `base`, `action`, `query_id`, `outcome` a row for each query: `outcomes`, sorted structs of the other three."""
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("base", "action", "outcome"))).alias("outcomes"))


def archive_checks(bases: list[str], actions: list[str]) -> dict[str, Column]:
    """That an archive's queries have every base without an action (`none`) and with each action once, and finite outcomes."""
    wanted = F.array(*[F.struct(F.lit(b), F.lit(a)) for b in sorted(bases) for a in sorted([*actions, "none"])])
    names = F.transform("outcomes", lambda o: F.struct(o["base"], o["action"]))
    finite = F.forall("outcomes", lambda o: o["outcome"].isNotNull() & ~F.isnan(o["outcome"]) & (F.abs(o["outcome"]) < float("inf")))
    return {"each action once on each base": F.bool_and(names == wanted), "finite outcomes": F.bool_and(finite)}


def oracles(measured: DataFrame, routed: list[str]) -> DataFrame:
    """For every measure the mean of each query's best routed method, the best method's mean, and the room between them."""
    chosen = long(measured.filter(F.col("method").isin(routed)))
    best = chosen.groupBy("measure", "query_id").agg(F.max("value").alias("best")).groupBy("measure").agg(F.avg("best").alias("oracle"))
    single = chosen.groupBy("measure", "method").agg(F.avg("value").alias("mean")).groupBy("measure").agg(F.max("mean").alias("best_mean"))
    return best.join(single, "measure").withColumn("headroom", F.col("oracle") - F.col("best_mean"))


def oracle(measured: DataFrame, routed: list[str], measure: str = "n10") -> DataFrame:
    """Mean of the best routed method of each query, the best single method, and the room between them."""
    chosen = measured.filter(F.col("method").isin(routed))
    best = chosen.groupBy("query_id").agg(F.max(measure).alias("best")).agg(F.avg("best").alias("oracle"))
    order = F.array_position(F.array(*map(F.lit, routed)), F.col("method"))
    mean = chosen.groupBy("method").agg(F.avg(measure).alias("mean")).withColumn("at", order)
    single = mean.withColumn("n", F.row_number().over(Window.orderBy(F.round("mean", 9).desc(), "at"))).filter("n = 1")
    return single.crossJoin(best).select(F.col("method").alias("best_single"), F.col("mean").alias("best_mean"), "oracle", (F.col("oracle") - F.col("mean")).alias("headroom"))


def long(measured: DataFrame, by: str = "method") -> DataFrame:
    """A row for each method, query and measure."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES]))
    return measured.select(by, "query_id", each.alias("m")).select(by, "query_id", "m.measure", "m.value")


def paired(measured: DataFrame, own: str) -> DataFrame:
    """`method`, `measure`, `query_id`, `diff`: what one method has more than each other one, query by query."""
    told = long(measured)
    mine = told.filter(F.col("method") == own).select("query_id", "measure", F.col("value").alias("own"))
    return told.filter(F.col("method") != own).join(mine, ["query_id", "measure"]).select("method", "measure", "query_id", (F.col("own") - F.col("value")).alias("diff"))


def outcome_counts() -> list[Column]:
    """How many differences are above, near and below zero."""
    d = F.col("diff")
    flag = lambda test: F.sum(test.cast("long"))
    return [flag(d > 1e-12).alias("improved"), flag(F.abs(d) <= 1e-12).alias("unchanged"), flag(d < -1e-12).alias("harmed")]
