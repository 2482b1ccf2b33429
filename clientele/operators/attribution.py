"""Exact attribution of tree-ensemble scores (ML-6): Shapley values of the
path-dependent game, in which a feature that is not known follows both branches
of its splits in proportion to the rows that took them.

A leaf of value ``v`` is reached with the product over the features of its path
of ``o`` (1 if the row meets the feature's conditions, else 0) for known and of
``z`` (the product of the branch shares at its splits) for unknown features. The
Shapley value of feature ``i`` in that product has a closed form,

    v (o_i - z_i) * integral over t from 0 to 1 of the product over j != i of
    (1 - t) z_j + t o_j,

a polynomial of degree (features - 1), so a Gauss-Legendre rule with half as many
nodes gives it exactly. A leaf's path has at most as many features as the tree is
deep, whatever the table's width.

The model's node table becomes a *leaf-path table* (tree, leaf, interval and share
per feature), at most trees x 2^depth rows; it travels as one array. What a row gets
depends only on its *cell*: the places of its features among the trees' thresholds.
Each different cell is multiplied by the leaves inside one stage and summed per cell
and feature by a plain aggregate, and the rows are joined to their cell's result. No
Python function sees a row, and no pairs are formed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import clean_numbers
from ..functions.partitioning import materialize, remove_folder
from ..session import ensure_checkpoint_dir
from .churn_model import FittedModel

CELLS_PER_TASK = 2000
NODES = "tree int, id int, left int, right int, feature int, threshold double, value double, cover double"


def node_table(fitted: FittedModel) -> DataFrame:
    """The fitted trees as rows ``NODES``; ``value`` is in the score's own unit (log odds for a classifier),
    ``cover`` the weight of the training rows that reached the node."""
    gbt = fitted.model.stages[-1]
    spark = SparkSession.getActiveSession()
    unit = 2.0 if isinstance(gbt, GBTClassificationModel) else 1.0  # its probability is 1 / (1 + exp(-2 margin))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clientele-models/{uuid.uuid4().hex}"
    gbt.write().overwrite().save(path)
    weights = spark.createDataFrame([(i, float(w) * unit) for i, w in enumerate(gbt.treeWeights)], "tree int, weight double")
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    nodes = nodes.join(F.broadcast(weights), "tree").select(
        "tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"), F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), (F.col("prediction") * F.col("weight")).alias("value"),
        F.get("impurityStats", F.lit(0)).alias("cover"))
    nodes = materialize(nodes)
    remove_folder(spark, path)
    return nodes


def node_paths(nodes: DataFrame) -> DataFrame:
    """Every node with the conditions on its way: ``tree, id, leaf, value, conds`` where ``conds`` has, per feature on
    the path, the interval ``low < x <= high`` and the product ``share`` of the branches' shares. One small join a level."""
    nodes = materialize(nodes.select("tree", "id", "left", "right", "feature", "threshold", F.col("value").cast("double").alias("value"),
                                     F.col("cover").cast("double").alias("cover")))
    child = nodes.select(F.col("tree").alias("t"), F.col("id").alias("c"), F.col("left").alias("l"), F.col("right").alias("r"),
                         F.col("feature").alias("f"), F.col("threshold").alias("th"), F.col("value").alias("v"), F.col("cover").alias("n"))
    inf = float("inf")
    no_conds = F.array().cast("array<struct<feature: int, low: double, high: double, share: double>>")
    level = nodes.filter("id = 0").select("tree", "id", "left", "right", "feature", "threshold", "value", "cover", no_conds.alias("conds"))
    done = [level]
    while True:
        inner = level.filter("left >= 0")
        if not inner.limit(1).count():
            break
        side = F.explode(F.array(*[F.struct(F.col(c).alias("id"), F.lit(c == "left").alias("is_left")) for c in ("left", "right")]))
        steps = inner.select("tree", F.col("feature").alias("by"), F.col("threshold").alias("at"), F.col("cover").alias("all"), "conds", side.alias("s"))
        steps = steps.join(child, (F.col("tree") == F.col("t")) & (F.col("s.id") == F.col("c")))
        cond = F.struct(F.col("by").cast("int").alias("feature"), F.when(F.col("s.is_left"), -inf).otherwise(F.col("at")).alias("low"),
                        F.when(F.col("s.is_left"), F.col("at")).otherwise(inf).alias("high"),
                        F.coalesce(F.try_divide(F.col("n"), F.col("all")), F.lit(0.0)).alias("share"))
        level = materialize(steps.select("tree", F.col("c").alias("id"), F.col("l").alias("left"), F.col("r").alias("right"), F.col("f").alias("feature"),
                                         F.col("th").alias("threshold"), F.col("v").alias("value"), F.col("n").alias("cover"),
                                         F.concat("conds", F.array(cond)).alias("conds")))
        done.append(level)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)

    def merged(f):
        own = F.filter("conds", lambda c: c["feature"] == f)
        return F.struct(f.alias("feature"), F.array_max(F.transform(own, lambda c: c["low"])).alias("low"),
                        F.array_min(F.transform(own, lambda c: c["high"])).alias("high"),
                        F.aggregate(own, F.lit(1.0), lambda a, c: a * c["share"]).alias("share"))
    conds = F.transform(F.array_distinct(F.transform("conds", lambda c: c["feature"])), merged)
    return out.select("tree", "id", (F.col("left") < 0).alias("leaf"), "value", conds.alias("conds"))


def _meets(x: Column, c: Column) -> Column:
    return (F.get(x, c["feature"]) > c["low"]) & (F.get(x, c["feature"]) <= c["high"])


def with_covers(nodes: DataFrame, rows: DataFrame, x: str) -> DataFrame:
    """The node table with ``cover`` counted on ``rows`` (a chosen population) whose features are the array ``x``."""
    paths = node_paths(nodes.withColumn("cover", F.lit(1.0)))
    every = paths.select(F.collect_list(F.struct("tree", "id", "conds")).alias("a")).scalar()
    reached = rows.select(F.col(x).alias("__x"), F.explode(every).alias("p"))
    reached = reached.where(F.forall("p.conds", lambda c: _meets(F.col("__x"), c))).groupBy(F.col("p.tree").alias("tree"), F.col("p.id").alias("id"))
    counts = reached.agg(F.count(F.lit(1)).cast("double").alias("n"))
    return nodes.drop("cover").join(counts, ["tree", "id"], "left").withColumn("cover", F.coalesce("n", F.lit(0.0))).drop("n")


def by_cells(rows: DataFrame, x: str, n_features: int, leaves: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows with their cell, the different cells, the leaves with conditions on cells)``.

    A cell says, per feature, how many of the trees' thresholds are below the row's value (-1 if it meets no condition:
    missing, not a number, minus infinity). Rows of one cell meet the same conditions of every leaf. ``x > threshold``
    holds exactly where the row's number is larger than the threshold's own."""
    inf = float("inf")
    ends = leaves.select(F.explode("conds").alias("c")).select("c.feature", F.explode(F.array("c.low", "c.high")).alias("t")).where(F.abs("t") < inf)
    cuts = ends.groupBy("feature").agg(F.array_sort(F.collect_set("t")).alias("ts")).agg(F.map_from_entries(F.collect_list(F.struct("feature", "ts"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(max(n_features, 1) - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.array().cast("array<double>")))
    cuts = materialize(cuts.select(every.alias("cuts"))).scalar()

    def place(value, k):
        return F.size(F.filter(F.get("__cuts", k), lambda t: t < value)).cast("double")
    cell = [F.when((F.get(x, F.lit(k)) > -inf) & (F.get(x, F.lit(k)) <= inf), place(F.get(x, F.lit(k)), F.lit(k))).otherwise(-1.0) for k in range(n_features)]
    placed = materialize(rows.withColumn("__cuts", cuts).select(*keep, F.array(*cell).cast("array<double>").alias("__cell")))

    def moved(c):
        low = F.when(c["low"] == -inf, -0.5).otherwise(place(c["low"], c["feature"]))
        high = F.when(c["high"] == inf, inf).otherwise(place(c["high"], c["feature"]))
        return F.struct(c["feature"].alias("feature"), low.alias("low"), high.alias("high"), c["share"].alias("share"))
    return placed, materialize(placed.select("__cell").distinct()), materialize(
        leaves.withColumn("__cuts", cuts).withColumn("conds", F.transform("conds", moved)).drop("__cuts"))


def shapley(rows: DataFrame, x: str, names: Sequence[str], nodes: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Per row and feature ``keep..., base_value, score, feature, contribution, rank``.

    ``rows`` has the features as an array of doubles ``x`` in the order of ``names``. The contributions of a row sum
    to ``score - base_value``: its own score less the score of a row of which nothing is known. ``rank`` orders a
    row's features by the size of their contribution, equal ones by name. Rows are told apart whatever their ``keep``
    columns say, so repeated ids give a result each; a missing value in ``x`` meets no condition.
    """
    placed, cells, leaves = by_cells(rows, x, len(names), materialize(node_paths(nodes).filter("leaf").select("tree", "id", "value", "conds")), keep)
    slots = max(1, leaves.agg(F.max(F.size("conds"))).first()[0] or 0)
    # a feature that every row meets and that has share 1 changes nothing: all paths get the same number of places
    idle = F.struct(F.lit(0).alias("feature"), F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(1.0).alias("share"))
    filled = F.concat("conds", F.array_repeat(idle, F.lit(slots) - F.size("conds")))
    # in the trees' order, so that sums round alike in every run
    table = leaves.select(F.sort_array(F.collect_list(F.struct("tree", "id", "value", filled.alias("c"), F.size("conds").alias("n")))).alias("a")).scalar()
    base = leaves.agg(F.sum(F.aggregate("conds", F.col("value"), lambda a, c: a * c["share"])).alias("b")).scalar()
    points, weights = np.polynomial.legendre.leggauss((slots + 1) // 2)
    points, weights = ((points + 1) / 2).tolist(), (weights / 2).tolist()

    # a cell meets all leaves: many tasks however few bytes the cells have
    each = cells.repartition(max(1, -(-cells.count() // CELLS_PER_TASK)), "__cell").withColumn("__l", F.explode(table))
    cond = [F.get("__l.c", F.lit(j)) for j in range(slots)]
    met = [(F.lit(j) >= F.col("__l.n")) | F.coalesce(_meets(F.col("__cell"), c), F.lit(False)) for j, c in enumerate(cond)]
    each = each.select("__cell", F.col("__l.value").alias("v"), *[c["feature"].alias(f"f{j}") for j, c in enumerate(cond)],
                       *[c["share"].alias(f"z{j}") for j, c in enumerate(cond)], *[m.cast("double").alias(f"o{j}") for j, m in enumerate(met)])
    mixed = [F.col(f"z{j}") * F.lit(1 - t) + F.col(f"o{j}") * F.lit(t) for t in points for j in range(slots)]
    each = each.select("*", *[m.alias(f"g{q}") for q, m in enumerate(mixed)])

    def product(cols):
        out = F.lit(1.0)
        for c in cols:
            out = out * c
        return out
    part = [F.col("v") * (F.col(f"o{j}") - F.col(f"z{j}")) * sum(
        (F.lit(w) * product(F.col(f"g{q * slots + i}") for i in range(slots) if i != j) for q, w in enumerate(weights)), F.lit(0.0)) for j in range(slots)]
    each = each.select("__cell", (F.col("v") * product(F.col(f"o{j}") for j in range(slots))).alias("s"),
                       *[F.col(f"f{j}") for j in range(slots)], *[p.alias(f"p{j}") for j, p in enumerate(part)])
    of = lambda k: sum((F.when(F.col(f"f{j}") == k, F.col(f"p{j}")).otherwise(0.0) for j in range(slots)), F.lit(0.0))
    total = each.groupBy("__cell").agg(F.sum("s").alias("score"), *[F.sum(of(k)).alias(f"c{k}") for k in range(len(names))])
    ranked = F.array_sort(F.array(*[F.struct((-F.abs(F.col(f"c{k}"))).alias("size"), F.lit(n).alias("feature"), F.col(f"c{k}").alias("contribution"))
                                    for k, n in enumerate(names)]))
    out = placed.join(total.select("__cell", "score", ranked.alias("__ranked")), "__cell").withColumn("base_value", base)
    out = out.select(*keep, "base_value", "score", F.posexplode("__ranked").alias("rank", "r"))
    return out.select(*keep, "base_value", "score", F.col("r.feature").alias("feature"), F.col("r.contribution").alias("contribution"), (F.col("rank") + 1).alias("rank"))


def explain(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """ML-6: exact contributions of a fitted model's features for every row of ``df``, in log odds (classifier) or the
    target's unit: ``id, base_value, score, feature, contribution, rank``. Absent features read as in scoring."""
    rows = fitted.encoded(clean_numbers(df))
    x = F.array(*[F.col(f"{c}__num") for c in fitted.numeric], *[F.col(f"{c}__ord") for c in fitted.categorical])
    return shapley(rows.select(F.col(fitted.id_col), x.alias("__x0")), "__x0", fitted.features, node_table(fitted), [fitted.id_col])
