"""Exact null distributions against enumeration."""

from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import stats


def signed_p(values, alternative):
    order = sorted(range(len(values)), key=lambda i: abs(values[i]))
    own = sum(r + 1 for r, i in enumerate(order) if values[i] > 0)
    sums = [sum(r + 1 for r, s in enumerate(signs) if s) for signs in product((0, 1), repeat=len(values))]
    above, below = (sum(test(s) for s in sums) / len(sums) for test in (lambda s: s >= own, lambda s: s <= own))
    return above if alternative == "greater" else min(1.0, 2 * min(above, below))


@pytest.mark.parametrize("alternative", ["greater", "two-sided"])
def test_signed_ranks(spark, alternative):
    rng = np.random.default_rng(7)
    groups = {n: (rng.permutation(n) + 1.0) * rng.choice([-1, 1], n) for n in range(1, 13)}
    df = spark.createDataFrame([(n, i, float(v)) for n, values in groups.items() for i, v in enumerate(values)], "g int, query_id int, diff double")
    got = {r.g: r.p for r in stats.wilcoxon(df, ["g"], alternative).collect()}
    for n, values in groups.items():
        assert got[n] == pytest.approx(signed_p(values, alternative), abs=1e-12)


def test_counts_of_sums(spark):
    counts = spark.range(1).select(stats.rank_sum_counts(F.lit(50)).alias("c")).first().c
    assert sum(counts) == 2.0**50 and len(counts) == 1276 and counts == counts[::-1] and counts[:8] == [1, 1, 1, 2, 2, 3, 4, 5]


def test_the_switch(spark):
    """A zero, two equal sizes, or more than 50 differences: the normal approximation."""
    rows = {"exact": [1.0, 2.0, -3.0, 4.0], "zero": [0.0, 1.0, 2.0, -3.0, 4.0], "tie": [1.0, 2.0, -3.0, 3.0], "many": [float(i) for i in range(1, 52)], "most": [float(i) for i in range(1, 51)]}
    df = spark.createDataFrame([(g, i, v) for g, vs in rows.items() for i, v in enumerate(vs)], "g string, query_id int, diff double")
    got = {r.g: r for r in stats.wilcoxon(df, ["g"]).withColumn("normal", stats.upper_tail("z")).collect()}
    assert {g for g, r in got.items() if r.p == r.normal} == {"zero", "tie", "many"}
    assert got["most"].p == 2.0**-50 and got["exact"].p == signed_p(rows["exact"], "greater")


def test_mann_whitney(spark):
    rng = np.random.default_rng(8)
    groups = []
    for a, b in ((1, 1), (2, 5), (4, 4), (3, 8), (8, 4)):
        values = rng.permutation(a + b)
        groups.append((values[:a], values[a:]))
    df = spark.createDataFrame([(g, float(v), side == 0) for g, sides in enumerate(groups) for side, vs in enumerate(sides) for v in vs], "g int, v double, p boolean")
    got = {r.g: r for r in stats.mann_whitney(df, ["g"], "v", "p").collect()}
    for g, (x, y) in enumerate(groups):
        n = len(x) + len(y)
        u = sum(a > b for a in x for b in y)
        every = [sum(a > b for a in some for b in set(range(n)) - set(some)) for some in combinations(range(n), len(x))]
        far = max(u, len(x) * len(y) - u)
        assert got[g].u == u and got[g].p == pytest.approx(min(1.0, 2 * sum(v >= far for v in every) / len(every)), abs=1e-12)


def test_mann_whitney_switch(spark):
    rng = np.random.default_rng(9)
    rows = [("tied", float(v), i < 4) for i, v in enumerate([1, 2, 3, 4, 4, 5, 6])] + [("large", float(v), i < 9) for i, v in enumerate(rng.permutation(20))] + [("wide", float(v), i < 8) for i, v in enumerate(rng.permutation(2000))]
    got = {r.g: r for r in stats.mann_whitney(spark.createDataFrame(rows, "g string, v double, p boolean"), ["g"], "v", "p").withColumn("normal", 2 * stats.upper_tail(F.abs("z"))).collect()}
    assert got["tied"].p == min(1, got["tied"].normal) and got["large"].p == min(1, got["large"].normal)
    assert got["wide"].p != got["wide"].normal and got["wide"].p == pytest.approx(got["wide"].normal, abs=0.02)
