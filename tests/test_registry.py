"""Names agree, and queries give what their SQL gives on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
CHECKED = ("bm25_topk", "bm25_metrics_mean", "dense_metrics_mean", "cahr_topk", "metadata_signals", "query_features", "citation_precision", "generation_summary", "keep_best", "merge_fields", "robustness", "background_sample", "metadata_diagnostics", "doi_chain", "generation_tasks", "policy_bases")


def test_names():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")
@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, name):
    base = duckdb.connect()
    for file in os.listdir(FOLDER):
        base.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    want = base.execute(driver.oracle_sql()[name]).df()
    got = driver.queries()[name](spark, FOLDER).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted(tuple("" if pd.isna(v) else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert [t for t in plain(got)] == [t for t in plain(want)]


def test_latent_rank(monkeypatch):
    """The registered query takes the operator's own rank."""
    import inspect

    from orrery.operators import latent
    from orrery.plans import queries as plans

    seen, real = [], inspect.signature(latent.latent_vectors)

    def told(*given, **named):
        bound = real.bind(*given, **named)
        bound.apply_defaults()
        seen.append(bound.arguments["rank"])
        raise StopIteration

    monkeypatch.setattr(plans.latent, "latent_vectors", told)
    for name in ("documents", "items"):
        monkeypatch.setattr(plans.frames, name, lambda *_: None)
    try:
        plans.latent_topk(None, "")
    except StopIteration:
        pass
    assert seen == [latent.RANK] and latent.RANK == 384
