"""Model-based segmentation (ML-7, ML-8, ML-9, TOP-4).

k-means runs ``restarts`` times with different seeds on a persisted feature
table and keeps the lowest training cost (Spark's KMeans has no n_init).
Over whole tables the silhouette has the squared-Euclidean form, which needs only
per-cluster sums, so it is linear in the rows; the Euclidean one is for samples.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import numeric_columns, spending_ordinal
from ..functions.partitioning import materialize, sized
from ..functions.scalars import row_values
from .rfm import monetary_quartiles, rfm
from .rules import segment_labels
from .rules_tree import condition, fit_tree


def detect_mode(df: DataFrame) -> tuple[str, DataFrame, list[str]]:
    """ML-7 mode detection -> (mode, feature table, features). Rows with a
    missing feature are dropped from the table itself (not only the features)."""
    cols = set(df.columns)
    if {"Age", "Spending_Score", "Family_Size"} <= cols:
        feats = ["Age", "Spending_Score_Num", "Family_Size"]
        t = df.withColumn("Spending_Score_Num", spending_ordinal(df))
        return "demographic", t.dropna(subset=feats), feats
    if {"Recency", "Frequency", "Monetary"} <= cols:
        feats = ["Recency", "Frequency", "Monetary"]
        return "rfm", df.dropna(subset=feats), feats
    if {"CustomerID", "InvoiceDate", "TotalAmount"} <= cols:
        return "rfm", rfm(df), ["Recency", "Frequency", "Monetary"]
    nums = numeric_columns(df)
    if len(nums) >= 2:
        feats = nums[:3]
        return "generic", df.dropna(subset=feats), feats
    raise ValueError("no segmentation features: need demographic, RFM, transaction or >= 2 numeric columns")


def scaling_pipeline(features: Sequence[str]) -> Pipeline:
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__raw", handleInvalid="error"),
        StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)])


def fit_kmeans(scaled: DataFrame, k: int, restarts: int = 10, seed: int = 42, max_iter: int = 300,
               parallelism: int | None = None):
    """Best of ``restarts`` k-means fits by training cost -> (model, cost).

    The restarts are independent, so they are submitted as concurrent Spark
    jobs (the scheduler interleaves their tasks); the lowest cost wins, the
    lower seed on ties. Up to 300 iterations, as the reference; fits stop at
    convergence (tolerance 1e-4), at sf0.1 within 14-41 iterations."""
    def fit(r):
        m = KMeans(k=k, seed=seed + r, maxIter=max_iter, featuresCol="features", predictionCol="__pred").fit(scaled)
        return r, m, m.summary.trainingCost
    parallelism = parallelism or scaled.sparkSession.sparkContext.defaultParallelism
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, restarts))) as pool:
        fits = list(pool.map(fit, range(restarts)))
    r, m, cost = min(fits, key=lambda t: (t[2], t[0]))
    return m, cost


def _renumber_by_size(pred: DataFrame) -> Column:
    """Cluster ids by size, largest first (k values: collected, bounded by k)."""
    sizes = pred.groupBy("__pred").count().orderBy(F.desc("count"), "__pred").collect()
    e = None
    for new, r in enumerate(sizes):
        e = F.when(F.col("__pred") == r["__pred"], new) if e is None else e.when(F.col("__pred") == r["__pred"], new)
    return e.cast("int") if e is not None else F.lit(None).cast("int")


def segment(df: DataFrame, k: int = 4, restarts: int = 10, seed: int = 42) -> tuple[str, DataFrame, list[str]]:
    """ML-7: detect mode, scale, cluster (best of restarts), renumber by size,
    label clusters (RUL-6). Returns (mode, table + Cluster + Cluster_Label, features)."""
    mode, table, feats = detect_mode(df)
    # computed once: the scaler, every fit and the returned plan read this table, not the source
    table = materialize(table)
    scaler = scaling_pipeline(feats).fit(table)
    scaled = scaler.transform(table).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model, _ = fit_kmeans(sized(scaled), k, restarts, seed)
        pred = model.transform(scaled)
        out = pred.withColumn("Cluster", _renumber_by_size(pred)).drop("__raw", "features", "__pred")
    finally:
        scaled.unpersist()
    if mode == "rfm":
        q = monetary_quartiles(out)
        qv = row_values(q)
        q1, q3 = qv["q1"], qv["q3"]
    else:
        q1 = q3 = None
    summary = out.groupBy("Cluster").agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats])
    labels = segment_labels(summary, mode, "Cluster", q1, q3).select("Cluster", "Cluster_Label")
    # k rows: broadcast
    return mode, out.join(F.broadcast(labels), "Cluster", "left"), feats


def squared_silhouette(df: DataFrame, features: Sequence[str], cluster: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance (as Spark's evaluator).

    For a point x and cluster C: sum_y |x-y|^2 = n_C |x|^2 - 2 x.S_C + Q_C with
    S_C the feature sums and Q_C the sum of squared norms. Own cluster divides
    by n_A - 1, other clusters by n_C; singletons score 0. The per-cluster sums
    (k rows) travel as one scalar-subquery array; no join, no pairs.
    """
    x = [F.col(f).cast("double") for f in features]
    norm = sum(c * c for c in x)
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"),
                                    *[F.sum(c).alias(f"s{i}") for i, c in enumerate(x)],
                                    F.sum(norm).alias("q"))
    arr = stats.select(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "q",
                                               *[F.col(f"s{i}") for i in range(len(x))])).alias("a")).scalar()

    def dist(s):
        dot = sum(x[i] * s[f"s{i}"] for i in range(len(x)))
        return s["n"] * norm - 2 * dot + s["q"]
    # subqueries may not sit inside lambdas: project the array first
    staged = df.withColumn("__stats", arr)
    st = F.col("__stats")
    own = F.filter(st, lambda s: s["c"] == F.col(cluster))[0]
    a = F.try_divide(dist(own), own["n"] - 1)
    others = F.transform(F.filter(st, lambda s: s["c"] != F.col(cluster)), lambda s: dist(s) / s["n"])
    b = F.array_min(others)
    # a point on top of its own and of another cluster's points scores 0
    sil = F.when(own["n"] <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return staged.select(sil.alias("__s")).agg(F.avg("__s").alias("silhouette"))


def k_sweep(df: DataFrame, ks: Sequence[int] = (2, 3, 4, 5, 6), restarts: int = 10, seed: int = 42) -> DataFrame:
    """ML-8: silhouette (squared Euclidean, on the full table) per k; best k flagged."""
    mode, table, feats = detect_mode(df)
    persisted = scaling_pipeline(feats).fit(table).transform(table).persist(StorageLevel.MEMORY_AND_DISK)
    scaled = sized(persisted)
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="__pred")

    def one(k):
        model, cost = fit_kmeans(scaled, k, restarts, seed, parallelism=2)
        return int(k), float(ev.evaluate(model.transform(scaled))), float(cost)
    try:
        # each k is independent: submit them as concurrent Spark jobs
        with ThreadPoolExecutor(max_workers=min(len(ks), 4)) as pool:
            rows = list(pool.map(one, ks))
    finally:
        persisted.unpersist()
    best = max(rows, key=lambda r: r[1])[0]
    spark = df.sparkSession
    return spark.createDataFrame([(k, s, c, k == best) for k, s, c in rows],
                                 "k int, silhouette double, training_cost double, best boolean")


def sample_rows(df: DataFrame, key: str, n: int = 1000) -> DataFrame:
    """TOP-4: a repeatable sample of ``n`` rows (smallest md5 of the key as text)."""
    return df.orderBy(F.md5(F.col(key).cast("string").cast("binary")), F.col(key)).limit(n)


# --- rules that explain clusters (ML-9) ---------------------------------------------------

def segment_rules(segmented: DataFrame, features: Sequence[str], cluster: str = "Cluster", max_depth: int = 3) -> DataFrame:
    """ML-9: an exact depth-3 tree on the unscaled features predicting the cluster (``rules_tree``); one row per leaf,
    from left to right: condition text, predicted cluster, rows reaching it, purity."""
    nodes, names = fit_tree(segmented, features, cluster, max_depth)
    leaves = sorted((n for n in nodes if n.feature is None), key=lambda n: (n.id << (max_depth - n.depth)))
    rows = [(i, condition(n.path), int(names[n.top]), n.rows, n.counts[n.top] / n.rows) for i, n in enumerate(leaves)]
    return segmented.sparkSession.createDataFrame(rows, "leaf_id int, condition string, predicted_cluster int, rows long, purity double")


# --- Euclidean silhouette on a sample (ML-8) ----------------------------------------------

def euclidean_silhouette(df: DataFrame, features: Sequence[str], cluster: str, key: str, n: int | None = 1000, blocks: int = 10) -> DataFrame:
    """ML-8: mean silhouette with Euclidean distances over a repeatable sample of ``n`` rows (TOP-4; None: all rows).

    Distances need pairs, so the sample is cut into ``blocks`` by a hash of the key: every row meets every block once
    (a join on the block's number), the block's members are summed per cluster in the same stage, and a row's sums of
    all blocks are added up. One number per row and cluster is kept, never a table of pairs. A row alone in its cluster
    scores 0, as does one with no distance at all. One row: ``silhouette, rows, clusters`` (null silhouette with fewer
    than two clusters).
    """
    rows = df if n is None else sample_rows(df, key, n)
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = materialize(rows.select(F.col(cluster).alias("c"), x.alias("x"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b")).withColumn("u", F.monotonically_increasing_id()))
    sizes = rows.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    members = rows.select("b", F.col("c").alias("oc"), F.col("x").alias("ox"))
    meets = rows.select("u", "c", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).join(members, "b")
    square = sum(((F.get("x", F.lit(i)) - F.get("ox", F.lit(i))) * (F.get("x", F.lit(i)) - F.get("ox", F.lit(i))) for i in range(len(features))), F.lit(0.0))
    per = meets.groupBy("u", "c", "oc").agg(F.sum(F.sqrt(square)).alias("d")).join(F.broadcast(sizes.withColumnRenamed("c", "oc")), "oc")  # k rows
    own = F.col("c") == F.col("oc")
    a = F.max(F.when(own, F.try_divide(F.col("d"), F.col("size") - 1)))  # its own distance is 0
    b = F.min(F.when(~own, F.col("d") / F.col("size")))
    one = per.groupBy("u").agg(a.alias("a"), b.alias("b"))
    score = F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    facts = row_values(sizes.agg(F.count(F.lit(1)).alias("clusters")))
    return one.agg(F.avg(score).alias("s"), F.count(F.lit(1)).alias("rows")).select(
        F.when(facts["clusters"] >= 2, F.col("s")).alias("silhouette"), "rows", facts["clusters"].alias("clusters"))


def k_sweep_sample(df: DataFrame, key: str, ks: Sequence[int] = (2, 3, 4, 5, 6), n: int = 1000, restarts: int = 10, seed: int = 42) -> DataFrame:
    """ML-8 as the reference does it: the sample alone is scaled and clustered for each k and judged by the Euclidean
    silhouette; the best k is flagged (the smaller one of equals)."""
    _, table, feats = detect_mode(df)
    sample = materialize(sample_rows(table, key, n))
    scaled = materialize(scaling_pipeline(feats).fit(sample).transform(sample).withColumn("__z", vector_to_array("features")))
    z = [f"__z{i}" for i in range(len(feats))]
    rows = []
    for k in ks:
        model, cost = fit_kmeans(scaled, k, restarts, seed)
        placed = model.transform(scaled).select(key, "__pred", *[F.get("__z", F.lit(i)).alias(c) for i, c in enumerate(z)])
        rows.append((int(k), euclidean_silhouette(placed, z, "__pred", key, n=None).first().silhouette, float(cost)))
    best = max(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, -r[0]))[0]
    return df.sparkSession.createDataFrame([(k, s, c, k == best) for k, s, c in rows], "k int, silhouette double, training_cost double, best boolean")
