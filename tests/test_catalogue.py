"""Every query runs on the smallest tables; those with SQL give the same rows as DuckDB."""

import math

import duckdb
import numpy as np
import pytest

import jobs
from sigspark.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is not None and type(x).__name__ == "NAType" or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, (bool, np.bool_)):
        return bool(x)
    if isinstance(x, (int, float, np.number)):
        return round(float(x), 5) + 0.0
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(v) for v in x)
    return x


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, small, duck, name):
    got = catalogue.queries()[name](spark, small).toPandas()
    assert len(got)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.execute(sql).df())


@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_job(spark, small, duck, name):
    assert rows(jobs.queries()[name](spark, small).toPandas()) == rows(duck.execute(jobs.oracle_sql()[name]).df())


def test_entry(spark):
    import __spark_entry__

    frame = __spark_entry__.entry(spark)
    assert {"label", "recall", "precision", "f1"} <= set(frame.columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_fits_have_the_rounds_of_their_operators(spark, small, monkeypatch):
    """20 of profile HMMs, 10 of barycentres, 50 in studies: whatever is not converged has used them."""
    from sigspark.functions import profile_hmm
    from sigspark.operators import consensus

    most = {f.__name__: f.__kwdefaults__["max_iter"] if f.__kwdefaults__ else f.__defaults__[f.__code__.co_varnames[: f.__code__.co_argcount].index("max_iter") - f.__code__.co_argcount] for f in (profile_hmm.fit, consensus.barycentre)}
    assert most == {"fit": 20, "barycentre": 10} and catalogue.STUDY_ROUNDS == 50
    hmm = catalogue.profile_hmm_fit(spark, small).collect()
    assert all(r["converged"] or r["n_iter"] == 20 for r in hmm)
    assert all(r["converged"] or r["iterations"] == 10 for r in catalogue.dba_consensus(spark, small).collect())
    seen = []
    for name in ("ablation", "compare_representations", "medoid_robustness"):
        monkeypatch.setattr(catalogue.studies, name, lambda *a, **b: seen.append(b["max_iter"]) or (None, None))
    monkeypatch.setattr(catalogue, "r6", lambda frame, *a, **b: frame)
    for name in ("study_ablation", "study_ablation_differences", "study_representations", "study_medoid_robustness"):
        getattr(catalogue, name)(spark, small)
    assert seen == [50] * 4


def test_medoid_robustness_tries_five_candidates(spark, small):
    got = catalogue.study_medoid_robustness(spark, small).toPandas()
    assert set(got.groupby("label")["rank"].max()) == {5}
    assert got[got["rank"] > 1]["accuracy"].notna().all()


def test_trims_shorten_the_full_anchor(spark, small):
    anchors = [catalogue.boundary_anchor(spark, small, t).first()["mean"] for t in (0, 4, 9)]
    assert list(catalogue.TRIMS) == list(range(10)) and len(anchors[0]) > 49
    assert anchors[1] == anchors[0][:-4] and anchors[2] == anchors[0][:-9]
