"""Exact classification trees (ML-9): level-wise CART on distinct values.

Every boundary between two neighbouring distinct values of every feature is a
candidate, as in a sort-based tree; there are no bins. One level is one
aggregation: rows become (node, feature, value) with a count per class, running
counts over the values (``functions.ranking.running_totals``, spread by ranges)
give both sides of each boundary, and the best one per node is a ``max``. Only
that best split (at most 2^depth rows) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.partitioning import materialize
from ..functions.ranking import running_totals

MOST_CLASSES = 1000  # each class is a column of the counts


@dataclass
class Node:
    id: int
    depth: int
    counts: list[int]
    path: list[tuple[str, str, float]] = field(default_factory=list)
    feature: str | None = None
    threshold: float | None = None

    @property
    def rows(self) -> int:
        return sum(self.counts)

    @property
    def gini(self) -> float:
        return 1.0 - sum(c * c for c in self.counts) / (self.rows * self.rows) if self.rows else 0.0

    @property
    def top(self) -> int:
        """Place of the most frequent class (the first of equals)."""
        return max(range(len(self.counts)), key=lambda i: (self.counts[i], -i))


def fit_tree(df: DataFrame, features: Sequence[str], label: str, max_depth: int = 3) -> tuple[list[Node], list]:
    """Nodes in order of their ids (root 1, children 2i and 2i+1) and the classes their counts stand for.

    Gini gain, thresholds halfway between neighbouring values, rows at or below go left. Of equal gains the first
    feature, then the smallest threshold wins, so the tree does not depend on the partitions. A node that holds one
    class, or whose features are constant, is a leaf. Rows with a missing feature or label are left aside.
    """
    features = list(features)
    there = F.col(label).isNotNull()
    for f in features:
        there = there & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    data = materialize(df.where(there).select(F.col(label).alias("__y"), *[F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]))
    classes = data.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).orderBy("__y").limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"{label!r} has more than {MOST_CLASSES} classes")
    if not classes:
        return [], []
    names = [r["__y"] for r in classes]
    cols = [f"n{c}" for c in range(len(names))]
    nodes = {1: Node(1, 0, [r.n for r in classes])}
    where = F.lit(1)
    for depth in range(max_depth):
        open_ = [i for i, n in nodes.items() if n.depth == depth and max(n.counts) < n.rows]
        if not open_:
            break
        each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"__x{i}").alias("v")) for i in range(len(features))]))
        long = data.select(where.alias("node"), "__y", each.alias("e")).where(F.col("node").isin(open_)).select("node", "__y", "e.f", "e.v")
        counts = long.groupBy("node", "f", "v").agg(*[F.count_if(F.col("__y") == F.lit(y)).alias(c) for y, c in zip(names, cols)])
        ran = running_totals(counts, ["node", "f"], "v", cols).where(F.col("next").isNotNull())
        left = [F.col(f"before_{c}") + F.col(c) for c in cols]
        right = [F.col(f"all_{c}") - x for c, x in zip(cols, left)]
        side = lambda xs: sum((x * x for x in xs[1:]), xs[0] * xs[0]) / sum(xs[1:], xs[0])
        # the gain grows with the sum of both sides' squared counts over their sizes
        best = ran.groupBy("node").agg(F.max(F.struct((side(left) + side(right)).alias("score"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v"),
                                                      F.col("next"), F.array(*left).alias("left"), F.array(*right).alias("right"))).alias("b"))
        tests = {}
        for r in best.collect():  # a row a node
            f, v = -r.b.f, -r.b.v
            t = (v + r.b.next) / 2
            t = v if t >= r.b.next else t
            n = nodes[r.node]
            n.feature, n.threshold = features[f], t
            for child, op, c in ((2 * n.id, "<=", r.b.left), (2 * n.id + 1, ">", r.b.right)):
                nodes[child] = Node(child, depth + 1, [int(x) for x in c], [*n.path, (features[f], op, t)])
            tests[n.id] = F.when(F.col(f"__x{f}") <= t, 2 * n.id).otherwise(2 * n.id + 1)
        if not tests:
            break
        step = where
        for i, test in tests.items():
            step = F.when(where == i, test).otherwise(step)
        where = step
    return [nodes[i] for i in sorted(nodes)], names


def condition(path) -> str:
    return " AND ".join(f"{f} {op} {t:.4f}" for f, op, t in path) or "TRUE"


def leaf_column(nodes: Sequence[Node]) -> Column:
    """The id of the leaf that a row reaches."""
    by = {n.id: n for n in nodes}

    def at(i):
        n = by[i]
        if n.feature is None:
            return F.lit(i)
        return F.when(F.col(n.feature).cast("double") <= n.threshold, at(2 * i)).otherwise(at(2 * i + 1))
    return at(1)


def tree_table(df: DataFrame, features: Sequence[str], label: str, max_depth: int = 3) -> DataFrame:
    """ML-9: the tree's nodes: ``node, depth, feature, threshold, condition, rows, gini, predicted, purity`` (feature and
    threshold are null for leaves)."""
    nodes, names = fit_tree(df, features, label, max_depth)
    kind = df.schema[label].dataType.simpleString()
    rows = [(n.id, n.depth, n.feature, n.threshold, condition(n.path), n.rows, n.gini, names[n.top], n.counts[n.top] / n.rows) for n in nodes]
    return df.sparkSession.createDataFrame(rows, f"node int, depth int, feature string, threshold double, condition string, rows long, gini double, predicted {kind}, purity double")
