import os

import pytest
from pyspark.sql import functions as F

from orrery.operators import metrics, policy
from orrery.sources.writers import write_checked

ROWS = [(b, a, q, q + len(a) / 10) for q in range(5) for b in ("x", "y") for a in ("none", "one", "three")]
SCHEMA = "base string, action string, query_id int, outcome double"


def test_whole_archive_is_written_in_one_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    rows = metrics.archive(spark.createDataFrame(ROWS, SCHEMA)).withColumn("again", counted(F.lit(1.0) * F.col("query_id")))
    write_checked(rows, str(tmp_path / "a"), metrics.archive_checks(["y", "x"], ["three", "one"]))
    assert seen.value == 5 and os.listdir(tmp_path) == ["a"]
    assert [o.action for o in spark.read.parquet(str(tmp_path / "a")).first().outcomes] == ["none", "one", "three"] * 2
    with pytest.raises(ValueError, match="there already"):
        write_checked(rows, str(tmp_path / "a"), {})


@pytest.mark.parametrize("broken, check", [(ROWS[1:], "each action"), ([*ROWS, ROWS[3]], "each action"), ([*ROWS[:-1], (*ROWS[-1][:3], None)], "finite"), ([*ROWS[:-1], (*ROWS[-1][:3], float("nan"))], "finite"), ([], "each action")])
def test_broken_archive_raises_and_leaves_nothing(spark, tmp_path, broken, check):
    with pytest.raises(ValueError, match=check):
        write_checked(metrics.archive(spark.createDataFrame(broken, SCHEMA)), str(tmp_path / "a"), metrics.archive_checks(["x", "y"], ["one", "three"]))
    assert os.listdir(tmp_path) == []


@pytest.mark.parametrize("off, check", [({}, None), ({3: 0.05}, None), ({3: 1e-6, 4: 1e-6}, "few queries"), ({3: 0.5}, "mean of rebuilt"), ({3: None}, "missing")])
def test_reconstruction_fails_the_write(spark, tmp_path, off, check):
    both = spark.createDataFrame([(i, 0.5, None if off.get(i, 0) is None else 0.5 + off.get(i, 0)) for i in range(100)], "query_id int, released double, rebuilt double")
    write = lambda: write_checked(both, str(tmp_path / "a"), metrics.reconstruction_checks())
    if check:
        with pytest.raises(ValueError, match=check):
            write()
    else:
        write()
    assert os.listdir(tmp_path) == ([] if check else ["a"])


def test_primary_family(spark):
    """Three datasets worked out by hand: five gains of different sizes, none, and one of two."""
    rows = [("a", i, 0.1 * i, 0.0, "act") for i in range(1, 6)] + [("b", 10 + i, 0.5, 0.5, None) for i in range(3)] + [("c", 20, 0.7, 0.5, "act"), ("c", 21, 0.4, 0.5, "act")]
    routes = spark.createDataFrame([("pessimistic", *r) for r in rows] + [("global_best", "a", 1, 9.0, 0.0, "act")], "policy string, dataset string, query_id int, outcome double, fallback double, action string")
    got = {r.dataset: r for r in policy.primary_family(routes).collect()}
    assert set(got) == {"a", "b", "c", "macro"}
    assert got["a"].p == pytest.approx(2 / 32) and got["a"].p_holm == pytest.approx(6 / 32) and got["a"].d == pytest.approx(0.3 / 0.025**0.5)
    assert (got["b"].p, got["b"].p_holm, got["b"].d, got["b"].coverage) == (1, 1, 0, 0)
    # Sizes 0.2 and 0.1: sums of at least 2 have a chance of 1/2.
    assert got["c"].p == 1 and got["c"].gain == pytest.approx(0.05)
    assert got["macro"].gain == pytest.approx((0.3 + 0 + 0.05) / 3) and got["macro"].n_queries == 10 and got["macro"].p is None


def test_datasets_are_routed_as_if_alone(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    told = [(f"d{i % 2}", i, " ".join(words[(i * k) % 8] for k in (1, 2, 3, 5))) for i in range(40)]
    queries = spark.createDataFrame(told, "dataset string, query_id int, text string")
    bases = spark.createDataFrame([(b, i, ((i * m) % 7) / 7) for _, i, _ in told for b, m in (("x", 3), ("y", 5))], "base string, query_id int, outcome double")
    outcomes = spark.createDataFrame([(b, i, a, ((i * m) % 11) / 11) for _, i, _ in told for b in "xy" for a, m in (("p", 2), ("q", 9))], "base string, query_id int, action string, outcome double")
    columns = ("policy", "query_id", "base", "action", "score", "outcome", "fallback")
    plain = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in df.select(*columns).collect())
    both = policy.route_datasets(queries, bases, outcomes)
    alone = [r for name in ("d0", "d1") for r in plain(policy.route(queries.filter(F.col("dataset") == name).drop("dataset"), bases, outcomes)[0])]
    assert plain(both) == sorted(alone)
