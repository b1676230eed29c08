"""Paired and unpaired tests. Sums and ranks are Spark's; only closing formulas on single numbers are Python's."""

from __future__ import annotations

import math
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orrery.sources.writers import kept

#: Differences up to which signed ranks, and members of the smaller group up to which U, have exact distributions.
EXACT, EXACT_GROUP = 50, 8
#: Different rows that a task resamples at once.
BUCKET = 4096


def cohens_d(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Mean of `diff` by its sample standard deviation; 0 if that is next to nothing."""
    out = diffs.groupBy(*by).agg(F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("d", F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd")).otherwise(F.lit(0.0)))


def tied_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """`rows` with `avg_rank` within each group and `ties`, how many rows share the value.

    Ranks come from counts of different values, so that only one row for each value goes through the ordered window.
    """
    values = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    below = F.sum("ties").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("avg_rank", F.coalesce(below, F.lit(0)) + (F.col("ties") + 1) / 2)
    return rows.join(values, [*by, value])


def signed_rank(diffs: DataFrame, by: list[str]) -> DataFrame:
    """Wilcoxon's W+ over differences that aren't zero, their number, and the normal score with ties taken into account."""
    moved = diffs.filter(F.abs("diff") > 1e-15).withColumn("size", F.round(F.abs("diff"), 12))
    rows = tied_ranks(moved, by, "size")
    ties = F.col("ties")
    sums = rows.groupBy(*by).agg(
        F.sum(F.when(F.col("diff") > 0, F.col("avg_rank")).otherwise(0.0)).alias("w_plus"),
        F.count(F.lit(1)).alias("n"),
        # Each of t equal values adds t^2 - 1: together t^3 - t.
        F.sum(ties * ties - 1).alias("tie_term"),
    )
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    return sums.withColumn("z", F.when(spread > 0, (F.col("w_plus") - n * (n + 1) / 4) / spread).otherwise(F.lit(0.0)))


@F.pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    """The normal distribution's share above z."""
    return z.map(lambda v: 0.5 * math.erfc(v / math.sqrt(2)))


def rank_sum_counts(n: Column) -> Column:
    """How many sets of ranks from 1 to n have each sum, from 0 on: rank by rank, each set with and without it."""
    first = F.array(F.lit(1.0))
    none = lambda k: F.array_repeat(F.lit(0.0), k.cast("int"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))), first, lambda c, k: F.zip_with(F.concat(c, none(k)), F.concat(none(k), c), lambda a, b: a + b))


def exact_signed_tails(w_plus: Column, n: Column) -> tuple[Column, Column]:
    """The chances of a signed-rank sum of at least, and of at most, `w_plus` for n differences without ties; n of 1 to EXACT."""
    counts, sets = rank_sum_counts(n), F.pow(F.lit(2.0), n)
    at = F.round(w_plus).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / sets
    return total(F.slice(counts, at + 1, F.size(counts))), total(F.slice(counts, F.lit(1), at + 1))


@F.pandas_udf(DoubleType())
def exact_u_tail(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """The chance of a Mann-Whitney U of at least `u` (whole) without ties, in whole numbers to the last division.

    The counts of U are the coefficients of the product of (1 - x^(larger + i)) / (1 - x^i) for i up to the smaller size.
    """

    def tail(u: float, a: int, b: int) -> float:
        few, many = sorted((a, b))
        counts = np.zeros(few * many + 1, object)
        counts[0] = 1
        for i in range(1, few + 1):
            if many + i < len(counts):
                counts[many + i :] = counts[many + i :] - counts[: -(many + i)]
            padded = np.concatenate((counts, np.zeros(-len(counts) % i, object))).reshape(-1, i)
            counts = np.cumsum(padded, axis=0).ravel()[: len(counts)]
        return float(Fraction(int(counts[int(u) :].sum()), int(counts.sum())))

    return pd.Series([tail(*x) for x in zip(u, n1.astype(int), n2.astype(int))], dtype=float)


def wilcoxon(diffs: DataFrame, by: list[str], alternative: str = "greater", least: int = 1) -> DataFrame:
    """`signed_rank` with `p`; 1 if fewer than `least` differences aren't zero.

    alternative: greater (than zero) or two-sided. Up to EXACT differences, none zero and no two of one size, p is exact; else the
    normal approximation is taken.
    """
    if alternative not in ("greater", "two-sided"):
        raise ValueError(f"no such alternative: {alternative}")
    tested = signed_rank(diffs, by)
    p = upper_tail("z") if alternative == "greater" else F.least(F.lit(1.0), 2 * upper_tail(F.abs("z")))
    above, below = exact_signed_tails(F.col("w_plus"), F.col("n"))
    exact = above if alternative == "greater" else F.least(F.lit(1.0), 2 * F.least(above, below))
    every = diffs.groupBy(*by).agg(F.count("diff").alias("_all")).join(tested, by, "left")
    plain = (F.col("n") <= EXACT) & (F.col("tie_term") == 0) & (F.col("n") == F.col("_all"))
    return every.withColumn("p", F.when(F.coalesce("n", F.lit(0)) < least, F.lit(1.0)).when(plain, exact).otherwise(p)).drop("_all")


def holm(tests: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Step-down adjusted p-values within each family."""
    order = Window.partitionBy(*by).orderBy(p, *[c for c in tests.columns if c not in (*by, p)])
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    step = F.least(F.lit(1.0), (size - F.row_number().over(order) + 1) * F.col(p))
    stepped = tests.withColumn("_step", step)
    return stepped.withColumn("p_holm", F.max("_step").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_step")


def mann_whitney(rows: DataFrame, by: list[str], value: str, positive: str) -> DataFrame:
    """U of the positives, the area U / (n1 n2), its Hanley-McNeil interval at 95 %, cut at 0 and 1, and z and two-sided p.

    z is normal, with ties taken into account and half a step towards the middle. p is exact where no two values are equal and
    one of the groups has EXACT_GROUP members at most, else by z.
    """
    t = F.col("ties")
    r = tied_ranks(rows, by, value).groupBy(*by).agg(F.sum(F.when(F.col(positive), F.col("avg_rank"))).alias("rank_sum"), F.sum(F.col(positive).cast("long")).alias("n_pos"), F.sum((~F.col(positive)).cast("long")).alias("n_neg"), F.sum(t * t - 1).alias("tie_term"))
    a, n1, n2 = F.col("auc"), F.col("n_pos"), F.col("n_neg")
    r = r.withColumn("u", F.col("rank_sum") - n1 * (n1 + 1) / 2).withColumn("auc", F.col("u") / (n1 * n2))
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    error = F.sqrt(F.greatest(F.lit(0.0), (a * (1 - a) + (n1 - 1) * (q1 - a * a) + (n2 - 1) * (q2 - a * a)) / (n1 * n2)))
    n, off = n1 + n2, F.col("u") - n1 * n2 / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("tie_term") / (n * (n - 1))))
    z = F.when(spread > 0, F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5) / spread).otherwise(F.lit(0.0))
    r = r.select(*by, "n_pos", "n_neg", "u", "auc", F.greatest(F.lit(0.0), a - 1.96 * error).alias("low"), F.least(F.lit(1.0), a + 1.96 * error).alias("high"), z.alias("z"), (F.col("tie_term") == 0).alias("_plain"))
    exact = F.col("_plain") & (F.least("n_pos", "n_neg") <= EXACT_GROUP) & (F.least("n_pos", "n_neg") > 0)
    # The null distribution is the same from either end.
    ends = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    tail = exact_u_tail(F.when(exact, ends).otherwise(0.0), F.when(exact, n1).otherwise(1), F.when(exact, n2).otherwise(1))
    return r.withColumn("p", F.least(F.lit(1.0), F.when(exact, 2 * tail).otherwise(2 * upper_tail(F.abs("z"))))).drop("_plain")


def resampled(diffs: DataFrame, resamples: int, seed: int, by: list[str]) -> DataFrame:
    """`*by`, `resample`, `times`, `total`: of each resample of `diff` (query_id, diff), how many rows it draws, and their sum.

    A resample draws as many rows as the group has, with replacement. Rows are dealt to buckets by hash, and buckets are leaves of a
    tree: at each node a binomial draw says how many of the node's rows come from its left half. A node's draws depend on the seed,
    the group and the node alone, so every task gets the same ones and needs no other rows than its buckets'; equal rows of a query
    are one row with a weight. Null differences count for nothing.
    """
    group = F.to_json(F.struct(F.lit(0), *by), {"ignoreNullFields": "false"})
    # Read for sizes, the tree and the rows: kept, so that differences are made once.
    told = kept(diffs.filter("diff IS NOT NULL").select(group.alias("_g"), *by, F.col("diff").cast("double").alias("diff"), F.xxhash64("query_id", "diff").alias("_key")))
    names = told.select("_g", *by).dropDuplicates(["_g"])
    rows = told.groupBy("_g", "_key", "diff").agg(F.count(F.lit(1)).alias("weight"))
    # As many buckets, a power of two, as leave about BUCKET different rows in each.
    sizes = rows.groupBy("_g").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count(F.lit(1)) / BUCKET))).cast("int").alias("bits"))
    bucket = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(_key, 64 - bits)"))
    rows = rows.join(sizes, "_g").withColumn("bucket", bucket)
    leaves = rows.groupBy("_g", "bits", "bucket").agg(F.sum("weight").alias("weight"))
    up = lambda level: F.expr(f"shiftright(bucket, bits - {level})")
    nodes = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("bits")))).groupBy("_g", "level", up("level").alias("node")).agg(F.sum("weight").alias("weight"))
    # The nodes above a bucket, each with its rows and those of its left half; a bucket that is the root itself has one line too.
    path = leaves.select("_g", "bits", "bucket", F.explode(F.sequence(F.lit(0), F.greatest(F.col("bits") - 1, F.lit(0)))).alias("level"))
    path = path.withColumn("node", up("level")).withColumn("left", F.col("node") * 2).withColumn("below", F.col("level") + 1)
    path = path.withColumn("right", (F.col("bits") > 0) & (up("below") != F.col("left")))
    path = path.join(nodes, ["_g", "level", "node"])
    halves = nodes.select("_g", F.col("level").alias("below"), F.col("node").alias("left"), F.col("weight").alias("half"))
    path = path.join(halves, ["_g", "below", "left"], "left").fillna(0, ["half"])
    path = path.select(F.col("_g").alias("g"), F.col("bucket").alias("leaf"), F.col("bits").alias("depth"), "level", "node", "right", F.col("weight").alias("whole"), "half")
    rows = rows.select("_g", "bucket", "_key", "diff", "weight")

    def run(key: tuple, rows: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        own = zlib.crc32(key[0].encode())
        drawn = None
        for depth, level, node, right, whole, half in path.sort_values("level")[["depth", "level", "node", "right", "whole", "half"]].itertuples(index=False):
            drawn = np.full(resamples, whole, np.int64) if drawn is None else drawn
            if depth:
                left = np.random.default_rng([seed, own, level, node]).binomial(drawn, half / whole)
                drawn = drawn - left if right else left
        rows = rows.sort_values(["_key", "diff"])
        diff, ends = rows["diff"].to_numpy(), np.append(0, np.cumsum(rows["weight"].to_numpy()))
        rng, total, open_nodes = np.random.default_rng([seed, own, 2**20, key[1]]), np.zeros(resamples), [(0, len(diff), drawn)]
        while open_nodes:
            a, b, times = open_nodes.pop()
            if b - a == 1:
                total += times * diff[a]
                continue
            middle = (a + b) // 2
            left = rng.binomial(times, (ends[middle] - ends[a]) / (ends[b] - ends[a]))
            open_nodes += [(a, middle, left), (middle, b, times - left)]
        return pd.DataFrame({"_g": key[0], "resample": np.arange(resamples), "times": drawn, "total": total})

    drawn = rows.groupBy("_g", "bucket").cogroup(path.groupBy("g", "leaf")).applyInPandas(run, "_g string, resample int, times long, total double")
    out = drawn.groupBy("_g", "resample").agg(F.sum("times").alias("times"), F.sum("total").alias("total"))
    return out.join(names, "_g").select(*by, "resample", "times", "total")


def bootstrap(diffs: DataFrame, resamples: int = 10_000, seed: int = 2026, by: list[str] | None = None) -> DataFrame:
    """2.5 and 97.5 percentiles of the mean of resampled `diff` (query_id, diff), for each group of `by`."""
    by = by or []
    means = resampled(diffs, resamples, seed, by).withColumn("mean", F.col("total") / F.col("times"))
    return means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("low"), F.percentile("mean", F.lit(0.975)).alias("high"))


def weighted_effects(neighbours: DataFrame, by: list[str]) -> DataFrame:
    """From `effect` and `sim`: weighted mean, its standard error, effective number, degrees of freedom.

    A neighbour weighs max(sim, 0) + 0.001, weights add up to 1. The mean comes first, then the squares around it.
    """
    group = Window.partitionBy(*by)
    rows = neighbours.withColumn("w", F.greatest("sim", F.lit(0.0)) + 1e-3).withColumn("w", F.col("w") / F.sum("w").over(group))
    rows = rows.withColumn("mean", F.sum(F.col("w") * F.col("effect")).over(group))
    off = F.col("effect") - F.col("mean")
    sums = rows.groupBy(*by).agg(F.first("mean").alias("mean"), F.sum(F.col("w") * F.col("w")).alias("s2"), F.sum(F.col("w") * off * off).alias("squares"))
    s2, variance = F.col("s2"), F.col("squares") / F.greatest(1 - F.col("s2"), F.lit(1e-12))
    return sums.select(*by, "mean", variance.alias("variance"), F.sqrt(F.greatest(variance, F.lit(0.0)) * s2).alias("se"), (1 / s2).alias("n_eff"), F.greatest(F.floor(1 / s2) - 1, F.lit(1)).cast("int").alias("df"))


def bernstein(mean: Column, variance: Column, n_eff: Column, n_actions: int, alpha: float = 0.05) -> Column:
    """Lower bound of a mean after Bernstein, with the estimated variance."""
    log = math.log(3 * n_actions / alpha)
    return mean - (F.sqrt(2 * variance * log / n_eff) + 6 * log / n_eff)


def t_critical(df: int, tail: float) -> float:
    """The value that a t-distributed number exceeds with probability `tail`; by bisection on the exact integral."""

    def above(t: float) -> float:
        # Closed sums for whole degrees of freedom, in the angle whose tangent is t / sqrt(df).
        angle = math.atan2(t, math.sqrt(df))
        if df % 2:
            total, term = 0.0, math.cos(angle)
            for i in range(1, df - 1, 2):
                total += term
                term *= math.cos(angle) ** 2 * (i + 1) / (i + 2)
            inside = 2 / math.pi * (angle + math.sin(angle) * total)
        else:
            total, term = 0.0, 1.0
            for i in range(0, df, 2):
                total += term
                term *= math.cos(angle) ** 2 * (i + 1) / (i + 2)
            inside = math.sin(angle) * total
        return (1 - inside) / 2

    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > tail else (low, middle)
    return high


def confusion(rows: DataFrame, truth: str, predicted: str, labels: list) -> DataFrame:
    """Accuracy, macro F1 and Cohen's kappa over the given labels, from one count of (truth, predicted)."""
    table = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    s = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    flat = table.agg(F.sum("n").alias("n"), s(F.col("t") == F.col("p")).alias("hit"), *[x for i, v in enumerate(labels) for x in (s((F.col("t") == v) & (F.col("p") == v)).alias(f"tp{i}"), s(F.col("t") == v).alias(f"t{i}"), s(F.col("p") == v).alias(f"p{i}"))])
    f1 = [F.when(F.col(f"t{i}") + F.col(f"p{i}") > 0, 2 * F.col(f"tp{i}") / (F.col(f"t{i}") + F.col(f"p{i}"))).otherwise(F.lit(0.0)) for i in range(len(labels))]
    agreed = F.col("hit") / F.col("n")
    chance = sum((F.col(f"t{i}") * F.col(f"p{i}") for i in range(len(labels))), F.lit(0)) / (F.col("n") * F.col("n"))
    return flat.select(agreed.alias("accuracy"), (sum(f1, F.lit(0.0)) / len(labels)).alias("macro_f1"), F.when(chance < 1, (agreed - chance) / (1 - chance)).otherwise(F.lit(0.0)).alias("kappa"))
