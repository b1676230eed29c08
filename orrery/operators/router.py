"""A trained router: for each query the method that a classifier of its surface expects to do best, in crossed folds."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import hash_unit, query_features, words
from orrery.operators.metrics import MEASURES
from orrery.operators.stats import confusion
from orrery.sources.writers import kept

#: Parts of a label's queries that are numbered on their own.
BUCKETS = 256


def labelled(measured: DataFrame, routed: list[str], measure: str = "n10") -> DataFrame:
    """`query_id`, `label`: number of the routed method with the best measure; the last one wins what it ties, else the first."""
    value = lambda m: F.max(F.when(F.col("method") == m, F.col(measure)))
    wide = measured.filter(F.col("method").isin(routed)).groupBy("query_id").agg(*[value(m).alias(f"m{i}") for i, m in enumerate(routed)])
    columns = [F.col(f"m{i}") for i in range(len(routed))]
    most, last = F.greatest(*columns), len(routed) - 1
    first = F.coalesce(*[F.when(c == most, F.lit(i)) for i, c in enumerate(columns)])
    return wide.select("query_id", F.when(columns[last] >= most - 1e-9, F.lit(last)).otherwise(first).alias("label"))


def stratified_folds(rows: DataFrame, label: str, key: str = "query_id", folds: int = 5, seed: int = 42) -> DataFrame:
    """`rows` with `fold`: each label's rows in the order of the md5 of seed and key, dealt in turn.

    The order is counted in parts of a label, which then take up where the part before ended, so no task holds a whole label.
    """
    unit = hash_unit(F.lit(seed), F.col(key))
    told = rows.withColumn("_unit", unit).withColumn("_part", F.floor(F.col("_unit") * BUCKETS).cast("int"))
    sizes = told.groupBy(label, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(label, "_part", F.coalesce(before, F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_unit", key)) - 1
    placed = told.withColumn("_own", own).join(F.broadcast(starts), [label, "_part"])
    return placed.withColumn("fold", ((F.col("_start") + F.col("_own")) % folds).cast("int")).drop("_unit", "_part", "_own", "_start")


def route(queries: DataFrame, labels: DataFrame, folds: int = 5, seed: int = 42, c: float = 1.0) -> DataFrame:
    """`query_id`, `label`, `fold`, `predicted`: each fold by a classifier of the other folds.

    queries: query_id, text; labels: query_id, label. Features are scaled by the mean and deviation of the folds learned from.
    Each of the few folds is one model. If the others have a single label, that is the prediction.
    """
    features = query_features(F.coalesce("text", F.lit("")), F.col("w"))
    names = list(features)
    told = kept(stratified_folds(labels, "label", folds=folds, seed=seed).join(queries.withColumn("w", words(F.col("text"))).select("query_id", *[e.alias(n) for n, e in features.items()]), "query_id"))
    every = None
    for fold in range(folds):
        train = told.filter(F.col("fold") != fold)
        edges = train.agg(*[F.avg(n).alias(f"mean_{n}") for n in names], *[F.stddev_pop(n).alias(f"sd_{n}") for n in names], F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("kinds"), F.first("label").alias("only")).first()
        if not edges["n"]:
            continue
        if edges["kinds"] == 1:
            part = told.filter(F.col("fold") == fold).select("query_id", "label", "fold", F.lit(edges["only"]).alias("predicted"))
        else:
            scaled = told.withColumns({n: (F.col(n) - edges[f"mean_{n}"]) / (edges[f"sd_{n}"] or 1.0) for n in names})
            ready = VectorAssembler(inputCols=names, outputCol="features").transform(scaled)
            learner = LogisticRegression(family="multinomial", regParam=1 / (c * edges["n"]), standardization=False, maxIter=2000, tol=1e-6, predictionCol="_predicted")
            model = learner.fit(ready.filter(F.col("fold") != fold))
            part = model.transform(ready.filter(F.col("fold") == fold)).select("query_id", "label", "fold", F.col("_predicted").cast("int").alias("predicted"))
        every = part if every is None else every.unionByName(part)
    return told.select("query_id", "label", "fold", F.col("label").alias("predicted")) if every is None else every


def label_histogram(labels: DataFrame, routed: list[str]) -> DataFrame:
    """`method`, `n`: for how many queries each routed method is the label; zero where for none."""
    spark = labels.sparkSession
    names = spark.createDataFrame(list(enumerate(routed)), "label int, method string")
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, "label", "left").select("method", F.coalesce("n", F.lit(0)).alias("n"))


def summary(routes: DataFrame, measured: DataFrame, routed: list[str]) -> DataFrame:
    """Accuracy, macro F1 and kappa of the router, and the mean of every measure under its choices."""
    names = F.array(*map(F.lit, routed))
    chosen = routes.select("query_id", F.element_at(names, F.col("predicted") + 1).alias("method"))
    means = measured.join(chosen, ["query_id", "method"]).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(m).alias(m) for m in MEASURES])
    return confusion(routes, "label", "predicted", list(range(len(routed)))).crossJoin(F.broadcast(means))
