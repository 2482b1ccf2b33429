"""Distributed exact ranks and quantiles against pandas / numpy (WIN-1, AGG-4, AGG-11)."""

import numpy as np
import pandas as pd
import pytest

from clientele.functions.ranking import exact_quantiles, modes, percentile_ranks, value_ranks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    # a hot value holding a third of the rows, ties, and a long tail
    v = np.concatenate([np.full(1000, 5.0), rng.integers(0, 300, 1500).astype(float), rng.normal(0, 100, 500)])
    g = np.where(np.arange(len(v)) % 2 == 0, "a", "b")
    pdf = pd.DataFrame({"g": g, "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_percentile_rank_matches_pandas(data):
    pdf, df = data
    got = percentile_ranks(df, "v", n_buckets=16).toPandas().set_index("v")["pct"]
    want = pdf.assign(r=pdf["v"].rank(pct=True)).drop_duplicates("v").set_index("v")["r"]
    assert np.allclose(got.sort_index().values, want.sort_index().values)


def test_grouped_quantiles_match_numpy(data):
    pdf, df = data
    got = exact_quantiles(df, "v", [0.25, 0.5, 0.75], group="g", names=["a", "b", "c"], n_buckets=8).toPandas()
    for _, r in got.iterrows():
        vals = pdf[pdf.g == r["g"]]["v"].values
        assert np.allclose([r["a"], r["b"], r["c"]], np.percentile(vals, [25, 50, 75]))


def test_single_row_and_nulls(spark):
    df = spark.createDataFrame([(3.0,), (None,)], "v double")
    q = exact_quantiles(df, "v", [0.25, 0.75]).first()
    assert (q.q25, q.q75) == (3.0, 3.0)
    r = value_ranks(df, "v").first()
    assert (r.cnt, r.before, r.n) == (1, 0, 1)


def test_modes_lowest_on_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,), (None,), (None,)], "v string")
    assert modes(df, "v").first().v == "a"
