import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import stats


@pytest.mark.parametrize("bucket", [4096, 8])
def test_each_resample_draws_n_rows(spark, monkeypatch, bucket):
    """With a group's rows in one bucket, and in many that are leaves of one tree."""
    monkeypatch.setattr(stats, "BUCKET", bucket)
    rows = [("a", i, float(i % 5)) for i in range(300)] + [("b", 1, 2.0)] * 7 + [("b", 2, 9.0)] + [(None, 3, 1.0), ("b", 3, None)]
    diffs = spark.createDataFrame(rows, "policy string, query_id int, diff double").repartition(3)
    got = stats.resampled(diffs, 500, 7, ["policy"]).toPandas()
    drawn = {k: g for k, g in got.groupby("policy", dropna=False)}
    assert {k if isinstance(k, str) else None: (len(g), set(g.times)) for k, g in drawn.items()} == {"a": (500, {300}), "b": (500, {8}), None: (500, {1})}
    # Means and spread of a multinomial resample: variance of the diffs by n.
    mean = (drawn["a"].total / 300).to_numpy()
    assert mean.mean() == pytest.approx(2, abs=4 * np.sqrt(2 / 300 / 500)) and mean.std() == pytest.approx(np.sqrt(2 / 300), rel=0.15)
    # Seven equal rows weigh seven times one.
    nines = (drawn["b"].total - 16) / 7
    assert set(nines) <= set(range(9)) and nines.mean() == pytest.approx(1, abs=0.2)


def test_draws_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(stats, "BUCKET", 16)
    diffs = spark.range(200).select(F.col("id").alias("query_id"), F.sin("id").alias("diff"))
    one, many = (sorted((r.resample, round(r.total, 9)) for r in stats.resampled(diffs.repartition(n), 50, 1, []).collect()) for n in (1, 9))
    assert one == many and len(one) == 50
    other = sorted((r.resample, round(r.total, 9)) for r in stats.resampled(diffs, 50, 2, []).collect())
    assert other != one


def test_no_rows(spark):
    assert stats.resampled(spark.createDataFrame([], "p int, query_id int, diff double"), 10, 1, ["p"]).count() == 0
