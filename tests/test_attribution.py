"""Exact attribution against brute force over all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from clientele.functions.clean import clean_numbers
from clientele.operators.attribution import NODES, by_cells, explain, node_paths, node_table, shapley, with_covers
from clientele.operators.churn_model import train_churn, train_value
from clientele.sources import fixtures as fx


def brute(nodes, x, n_features):
    """Shapley values by their definition: v(S) follows known features and averages over the others' branches."""
    trees = {}
    for r in nodes:
        trees.setdefault(r.tree, {})[r.id] = r

    def v(tree, i, known):
        r = tree[i]
        if r.left < 0:
            return r.value
        if r.feature in known:
            return v(tree, r.left if x[r.feature] is not None and x[r.feature] <= r.threshold else r.right, known)
        a, b = tree[r.left], tree[r.right]
        return (a.cover * v(tree, r.left, known) + b.cover * v(tree, r.right, known)) / r.cover

    def total(known):
        return sum(v(t, 0, known) for t in trees.values())
    out = []
    for i in range(n_features):
        rest = [j for j in range(n_features) if j != i]
        out.append(sum(math.factorial(len(s)) * math.factorial(n_features - len(s) - 1) / math.factorial(n_features) * (total({*s, i}) - total({*s}))
                       for n in range(len(rest) + 1) for s in itertools.combinations(rest, n)))
    return out, total(set()), total(set(range(n_features)))


@pytest.mark.parametrize("kind", ["churn", "value"])
def test_fitted_model(spark, sf_small, kind):
    df = fx.churn_customers(spark, sf_small)
    if kind == "churn":
        fitted, _ = train_churn(df, max_iter=6, max_depth=4)
    else:
        fitted, _ = train_value(df, max_iter=4, max_depth=5)
    rows = explain(fitted, df).collect()
    k = len(fitted.features)
    assert len(rows) == df.count() * k
    by = {}
    for r in rows:
        by.setdefault(r.customerID, []).append(r)
    scored = fitted.transform(clean_numbers(df))
    own = 2 * vector_to_array("__raw")[1] if kind == "churn" else F.col("__pred")
    inputs = {r.customerID: r for r in scored.select("customerID", vector_to_array("__features").alias("x"), own.alias("s")).collect()}
    nodes = node_table(fitted).collect()
    for i, own_rows in by.items():
        assert own_rows[0].score == pytest.approx(inputs[i].s, abs=1e-9, rel=1e-12)
        assert sum(r.contribution for r in own_rows) == pytest.approx(inputs[i].s - own_rows[0].base_value, abs=1e-9, rel=1e-9)
        assert sorted(r.rank for r in own_rows) == list(range(1, k + 1))
    for i in sorted(by)[:6]:
        want, base, score = brute(nodes, inputs[i].x, k)
        got = {r.feature: r.contribution for r in by[i]}
        scale = max(1.0, abs(score))
        assert [got[f] for f in fitted.features] == pytest.approx(want, abs=1e-9 * scale)
        assert by[i][0].base_value == pytest.approx(base, abs=1e-9 * scale)


TREES = [(0, 0, 1, 2, 0, 3.0, 0.0, None), (0, 1, 3, 4, 1, 0.5, 0.0, None), (0, 2, -1, -1, -1, None, -1.0, None), (0, 3, 5, 6, 0, 1.0, 0.0, None),
         (0, 4, -1, -1, -1, None, 2.0, None), (0, 5, -1, -1, -1, None, 0.25, None), (0, 6, -1, -1, -1, None, 0.75, None),
         (1, 0, -1, -1, -1, None, 0.5, None)]


def test_chosen_population_and_odd_rows(spark):
    """Covers counted on a population; one feature twice on a path, a tree of one leaf, repeated ids, missing values."""
    nodes = spark.createDataFrame(TREES, NODES)
    rng = np.random.default_rng(1)
    people = [(i % 7, [float(rng.integers(0, 6)), float(rng.random()), float(i)]) for i in range(50)]
    rows = spark.createDataFrame(people, "k int, x array<double>")
    covered = with_covers(nodes, rows, "x")
    counts = {(r.tree, r.id): r.cover for r in covered.collect()}
    assert counts[0, 0] == counts[1, 0] == 50 and counts[0, 1] + counts[0, 2] == 50
    assert counts[0, 5] == sum(x[0] <= 1 and x[1] <= 0.5 for _, x in people)
    out = shapley(rows, "x", ["a", "b", "idle"], covered, ["k"]).collect()
    assert len(out) == 150 and {r.contribution for r in out if r.feature == "idle"} == {0.0}
    table = covered.collect()
    want = sorted(tuple(round(c, 9) for c in brute(table, x, 3)[0]) for _, x in people)
    shuffled = shapley(rows.repartition(5), "x", ["a", "b", "idle"], covered, ["k", "x"]).groupBy("k", "x").agg(
        *[F.collect_list(F.when(F.col("feature") == f, F.round("contribution", 9))).alias(f) for f in ("a", "b", "idle")]).collect()
    got = sorted(t for r in shuffled for t in zip(r.a, r.b, r.idle))
    assert np.allclose(got, want, atol=2e-9)
    missing = shapley(spark.createDataFrame([(1, [None, 0.2, 1.0])], "k int, x array<double>"), "x", ["a", "b", "idle"], covered, ["k"])
    assert missing.count() == 3
    assert shapley(rows.limit(0), "x", ["a", "b", "idle"], covered, ["k"]).count() == 0


def test_rows_of_one_cell_are_worked_out_once(spark):
    """400 different rows over three thresholds fall into a few cells, and each still gets its own exact result."""
    nodes = spark.createDataFrame(TREES, NODES)
    rng = np.random.default_rng(2)
    odd = [[None, 0.2, 1.0], [float("nan"), 0.7, 2.0], [3.0, 0.5, 3.0], [1.0, None, 4.0], [float("-inf"), 0.1, 5.0], [float("inf"), 0.1, 5.0]]
    people = [(i, [float(rng.random() * 5), float(rng.random()), float(i)]) for i in range(400)] + [(1000 + i, x) for i, x in enumerate(odd)]
    rows = spark.createDataFrame(people, "k int, x array<double>")
    covered = with_covers(nodes, rows, "x")
    leaves = node_paths(covered).filter("leaf")
    placed, cells, _ = by_cells(rows, "x", 3, leaves, ["k"])
    assert placed.count() == 406 and cells.count() <= 4 * 3  # (1.0, 3.0 and missing) x (0.5 and missing) x none
    table, got = covered.collect(), {}
    for r in shapley(rows, "x", ["a", "b", "idle"], covered, ["k"]).collect():
        got.setdefault(r.k, {})[r.feature] = r.contribution
    assert len(got) == 406
    for k, x in people[:400:20] + [(1002, odd[2]), (1005, odd[5])]:
        assert [got[k][f] for f in ("a", "b", "idle")] == pytest.approx(brute(table, x, 3)[0], abs=1e-9)
