"""Exact trees, running totals and Euclidean silhouettes against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.functions.ranking import running_totals
from clientele.operators.rules_tree import condition, fit_tree, leaf_column, tree_table
from clientele.operators.segment_model import euclidean_silhouette, k_sweep_sample, segment_rules


def plain_tree(x, y, classes, depth, node=1, out=None):
    """Every boundary of every feature tried; ids, features, thresholds and counts of the nodes."""
    out = {} if out is None else out
    counts = [int((y == c).sum()) for c in classes]
    out[node] = [None, None, counts]
    if depth == 0 or max(counts) == len(y):
        return out
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for v, w in zip(values[:-1], values[1:]):
            left = x[:, f] <= v
            score = sum(sum(int((y[s] == c).sum()) ** 2 for c in classes) / int(s.sum()) for s in (left, ~left))
            if best is None or score > best[0]:
                best = (score, f, (v + w) / 2)
    if best:
        out[node][:2] = best[1:]
        left = x[:, best[1]] <= best[2]
        plain_tree(x[left], y[left], classes, depth - 1, 2 * node, out)
        plain_tree(x[~left], y[~left], classes, depth - 1, 2 * node + 1, out)
    return out


@pytest.mark.parametrize("seed,n,levels", [(0, 300, 5), (1, 200, 100), (2, 60, 2)])
def test_tree_is_the_plain_one(spark, seed, n, levels):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, levels, n), rng.integers(0, levels, n) / 7, np.full(n, 3.0)], axis=1)
    y = (x[:, 0] > levels / 2).astype(int) * 2 + (rng.random(n) < 0.2)
    rows = [(float(a), float(b), float(c), f"g{k}") for (a, b, c), k in zip(x, y)] + [(None, 1.0, 1.0, "g0"), (1.0, float("nan"), 1.0, "g1"), (1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, g string")
    want = plain_tree(x, y, sorted(set(y.tolist())), 3)
    for parts in (1, 7):
        nodes, names = fit_tree(df.repartition(parts), ["a", "b", "c"], "g", 3)
        assert names == [f"g{c}" for c in sorted(set(y.tolist()))]
        got = {m.id: [None if m.feature is None else "abc".index(m.feature), m.threshold, m.counts] for m in nodes}
        assert got == want
    reached = df.where("g is not null and a is not null and not isnan(b)").groupBy(leaf_column(nodes).alias("leaf")).count().collect()
    assert {r.leaf: r["count"] for r in reached} == {m.id: m.rows for m in nodes if m.feature is None}


def test_tree_odd_cases(spark):
    none = spark.createDataFrame([], "a double, g int")
    assert fit_tree(none, ["a"], "g") == ([], []) and tree_table(none, ["a"], "g").count() == 0
    same = spark.createDataFrame([(1.0, i % 2) for i in range(6)], "a double, g int")
    t = tree_table(same, ["a"], "g").collect()
    assert [(r.node, r.feature, r.condition, r.rows, r.gini, r.predicted, r.purity) for r in t] == [(1, None, "TRUE", 6, 0.5, 0, 0.5)]
    one = tree_table(same.where("g = 1"), ["a"], "g").collect()
    assert [(r.gini, r.predicted) for r in one] == [(0.0, 1)]
    two = spark.createDataFrame([(float(i), i // 3) for i in range(9)], "a double, Cluster int")
    assert [tuple(r) for r in segment_rules(two, ["a"]).collect()] == [(0, "a <= 2.5000", 0, 3, 1.0), (1, "a > 2.5000 AND a <= 5.5000", 1, 3, 1.0),
                                                                      (2, "a > 2.5000 AND a > 5.5000", 2, 3, 1.0)]
    assert condition([]) == "TRUE"


def test_running_totals_over_partitions(spark):
    """A group over many ranges: sums before, in all, and the next value."""
    rows = [(g, float(v), v % 3 + 1, 1) for g, m in (("x", 400), ("y", 1), ("z", 7)) for v in range(m)]
    df = spark.createDataFrame(rows, "g string, v double, a long, b long").repartition(5)
    out = {(r.g, r.v): r for r in running_totals(df, ["g"], "v", ["a", "b"], n_buckets=9).collect()}
    assert len(out) == len(rows)
    for g, v, a, b in rows:
        r, own = out[g, v], [x for x in rows if x[0] == g]
        assert r.before_a == sum(x[2] for x in own if x[1] < v) and r.all_a == sum(x[2] for x in own)
        assert r.before_b == v and r.next == (v + 1 if v + 1 < len(own) else None)


def plain_silhouette(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i in range(len(x)):
        own = (c == c[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][c == c[i]].sum() / (own - 1)
        b = min(d[i][c == k].mean() for k in set(c.tolist()) if k != c[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_euclidean_silhouette(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 1, (40, 2)) for m in (0, 4, 9)] + [np.zeros((3, 2)), [[50.0, 50.0]]])
    c = np.array([0] * 40 + [1] * 40 + [2] * 40 + [0] * 3 + [7])
    df = spark.createDataFrame([(i, *map(float, p), int(k)) for i, (p, k) in enumerate(zip(x, c))], "id long, a double, b double, c int").repartition(4)
    for blocks in (1, 6):
        r = euclidean_silhouette(df, ["a", "b"], "c", "id", None, blocks).first()
        assert r.silhouette == pytest.approx(plain_silhouette(x, c), abs=1e-12) and (r.rows, r.clusters) == (124, 4)
    assert euclidean_silhouette(df.where("c = 1"), ["a", "b"], "c", "id").first().silhouette is None
    sample = df.orderBy(F.md5(F.col("id").cast("string").cast("binary"))).limit(50).collect()
    want = plain_silhouette(np.array([[r.a, r.b] for r in sample]), np.array([r.c for r in sample]))
    assert euclidean_silhouette(df, ["a", "b"], "c", "id", 50).first().silhouette == pytest.approx(want, abs=1e-12)


def test_sample_sweep_finds_the_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal(10 * (i % 3), 0.5)), float(rng.normal(-5 * (i % 3), 0.5)), 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "CustomerID long, Recency double, Frequency double, Monetary double").withColumn("Monetary", F.col("Recency") * 2)
    out = {r.k: r for r in k_sweep_sample(df, "CustomerID", ks=(2, 3, 4), n=90, restarts=2).collect()}
    assert out[3].best and out[3].silhouette > 0.8 and sum(r.best for r in out.values()) == 1
