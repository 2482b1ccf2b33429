"""Churn and customer-value models (ML-1..6, ML-12, ML-13, TOP-1, SNK-2).

A fitted model is the category dictionary (``encode``), the boosted trees with
their assembler as one ``PipelineModel``, and the feature lists; they are saved
and loaded together. Categories enter the trees as ordinal numbers, unseen ones
as -1. The train/test split is a hash of the id, so it is repeatable and needs
no shuffle. Boosting is iterative: the encoded training table is persisted
(sized to its rows) and the running prediction error is checkpointed every 10
rounds to the session's checkpoint folder. Node ids are not cached: for these
depths passing the trees is cheaper (measured).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clean import (churn_flag, clean_numbers, feature_columns, is_numeric, nan_to_null, risk_band,
                               to_number)
from ..functions.partitioning import materialize, remove_folder, sized
from ..functions.scalars import row_values
from ..session import ensure_checkpoint_dir
from .churn_stats import IMPACT_DOWN, IMPACT_KEY, IMPACT_UP
from .encode import encode, fit_dictionary

# Candidate target columns of the value model, in priority order.
VALUE_TARGETS = ["TotalCharges", "Monetary", "Spend", "Sales", "Amount", "LTV"]


@dataclass
class FittedModel:
    model: PipelineModel
    dictionary: DataFrame
    numeric: list[str]
    categorical: list[str]
    id_col: str
    target: str | None = None

    @property
    def features(self) -> list[str]:
        return self.numeric + self.categorical

    def encoded(self, df: DataFrame) -> DataFrame:
        """The input with its features as numbers (absent ones as in ``align``)."""
        return _encoded(self.dictionary, align(self, df), self.numeric, self.categorical)

    def transform(self, df: DataFrame) -> DataFrame:
        """Encoded input through the trees."""
        return self.model.transform(self.encoded(df))

    def save(self, path: str) -> None:
        """SNK-2: trees, dictionary and feature lists in one folder."""
        path = path.rstrip("/")
        self.model.write().overwrite().save(f"{path}/trees")
        self.dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
        facts = json.dumps({"numeric": self.numeric, "categorical": self.categorical, "id_col": self.id_col, "target": self.target})
        spark = self.dictionary.sparkSession
        spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedModel:
        """A saved model, ready to score (also in a new session)."""
        path = path.rstrip("/")
        facts = json.loads(spark.read.text(f"{path}/facts").first().value)
        return cls(PipelineModel.load(f"{path}/trees"), spark.read.parquet(f"{path}/dictionary"), **facts)


def _encoded(dictionary: DataFrame, df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    out = encode(dictionary, df, categorical, suffix="__code")
    return out.withColumns({**{f"{c}__num": F.coalesce(nan_to_null(df, c).cast("double"), F.lit(0.0)) for c in numeric},
                            **{f"{c}__ord": F.col(f"{c}__code").cast("double") for c in categorical}})


def _assembler(numeric: Sequence[str], categorical: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"{c}__num" for c in numeric] + [f"{c}__ord" for c in categorical],
                           outputCol="__features", handleInvalid="keep")


_STAGE_SUFFIXES = ("__num", "__code", "__ord")


def _internal(df: DataFrame) -> list[str]:
    """Columns that scoring adds (never a caller's own column)."""
    return [c for c in df.columns if c.startswith("__") or c.endswith(_STAGE_SUFFIXES)]


def split_column(id_col: str, test_pct: int = 20) -> Column:
    """True for the training rows: a stable hash split of the id."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(100)) >= test_pct


def prepare(df: DataFrame, id_col: str, drop: Sequence[str] = ()) -> tuple[DataFrame, list[str], list[str]]:
    c = clean_numbers(df)
    feats = feature_columns(c, drop)
    nums = [f for f in feats if is_numeric(c, f)]
    cats = [f for f in feats if f not in nums]
    return c, nums, cats


def train_churn(df: DataFrame, id_col: str = "customerID", label: str = "Churn", max_iter: int = 100,
                max_depth: int = 4, step: float = 0.05, seed: int = 42, test_pct: int = 20):
    """ML-1 -> (FittedModel, accuracy DataFrame). Positive rows weigh
    negatives/positives (1 without positives), as the reference's class weight."""
    if label not in df.columns:
        raise ValueError(f"target column {label!r} not found")
    c, nums, cats = prepare(df, id_col)
    y = churn_flag(c, label).cast("double")
    data = c.withColumn("__y", y)
    bal = data.select(F.struct(F.count_if(F.col("__y") == 0).alias("neg"),
                               F.count_if(F.col("__y") == 1).alias("pos"))).scalar()
    w = F.when(bal["pos"] > 0, bal["neg"] / bal["pos"]).otherwise(1.0)
    data = data.withColumn("__w", F.when(F.col("__y") == 1, w).otherwise(F.lit(1.0)))
    dictionary = fit_dictionary(data, cats)
    train = _encoded(dictionary, data.where(split_column(id_col, test_pct)), nums, cats).persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(df.sparkSession)
    fit_on = sized(train)
    gbt = GBTClassifier(featuresCol="__features", labelCol="__y", weightCol="__w", maxIter=max_iter,
                        maxDepth=max_depth, stepSize=step, seed=seed, predictionCol="__pred",
                        checkpointInterval=10, maxBins=64)
    gbt.setProbabilityCol("__prob").setRawPredictionCol("__raw")
    try:
        model = Pipeline(stages=[_assembler(nums, cats), gbt]).fit(fit_on)
    finally:
        train.unpersist()
    fitted = FittedModel(model, dictionary, nums, cats, id_col, label)
    test = data.where(~split_column(id_col, test_pct))
    acc = fitted.transform(test).agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.avg((F.col("__pred") == F.col("__y")).cast("double")).alias("accuracy"))
    return fitted, acc


def align(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """PRJ-6: absent numeric features read 0, absent categories read 'nan'."""
    add = {}
    for f in fitted.numeric:
        if f not in df.columns:
            add[f] = F.lit(0.0)
    for f in fitted.categorical:
        if f not in df.columns:
            add[f] = F.lit("nan")
    return df.withColumns(add) if add else df


def score_churn(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """ML-2 (and ML-3 with a filter first): input + Churn_Probability + Risk_Group."""
    out = fitted.transform(clean_numbers(df))
    p = vector_to_array(F.col("__prob"))[1]
    out = out.withColumn("Churn_Probability", p).withColumn("Risk_Group", risk_band("Churn_Probability"))
    return out.drop(*_internal(out))


def score_one(fitted: FittedModel, df: DataFrame, customer_id) -> DataFrame:
    """ML-3: one customer's probability and band: the batch path behind a filter
    (the filter reaches the scan, so only that customer's rows are read)."""
    return score_churn(fitted, df.where(F.col(fitted.id_col).cast("string") == str(customer_id)))


def gain_importance(fitted: FittedModel) -> DataFrame:
    """Mean split gain per feature over all trees (the saved node table is read
    back with Spark; internal nodes have a left child)."""
    gbt = fitted.model.stages[-1]
    spark = SparkSession.getActiveSession()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/clientele-models/{uuid.uuid4().hex}"
    gbt.write().overwrite().save(path)
    nodes = materialize(spark.read.parquet(f"{path}/data").select("nodeData.*").where(F.col("leftChild") >= 0))
    remove_folder(spark, path)
    names = spark.createDataFrame(list(enumerate(fitted.features)), "featureIndex int, Feature string")
    g = nodes.groupBy(F.col("split.featureIndex").alias("featureIndex")).agg(
        F.avg("gain").alias("Importance"), F.count(F.lit(1)).alias("splits"))
    return g.join(F.broadcast(names), "featureIndex").select("Feature", "Importance", "splits")


def directional_importance(fitted: FittedModel, scored: DataFrame, top: int = 5) -> DataFrame:
    """ML-4 + AGG-12 + TOP-1: the ``top`` features by mean gain, each with the
    sign of its correlation with the churn probability."""
    imp = gain_importance(fitted).orderBy(F.desc("Importance"), "Feature").limit(top)
    nums = [f for f in fitted.numeric if f in scored.columns]
    corr = row_values(scored.agg(*[F.corr(F.col(f).cast("double"), F.col("Churn_Probability")).alias(f)
                                   for f in nums])) if nums else {}
    c = None
    for f in nums:
        v = corr[f]
        c = F.when(F.col("Feature") == f, v) if c is None else c.when(F.col("Feature") == f, v)
    c = c if c is not None else F.lit(None).cast("double")
    impact = (F.when(F.col("Feature").isin(nums), F.when(~F.isnan(c) & (c > 0), IMPACT_UP).otherwise(IMPACT_DOWN))
               .otherwise(IMPACT_KEY))
    return imp.withColumns({"correlation": c, "Impact": impact})


def _scenario_array(scenarios: Sequence[Mapping], types: Mapping[str, str]) -> tuple[Column, list[str]]:
    cols = sorted({k for s in scenarios for k in s if k != "scenario_id"})
    structs = [F.struct(F.lit("base").alias("scenario_id"), *[F.lit(None).cast(types[c]).alias(c) for c in cols])]
    for s in scenarios:
        structs.append(F.struct(F.lit(s["scenario_id"]).alias("scenario_id"),
                                *[F.lit(s.get(c)).cast(types[c]).alias(c) for c in cols]))
    return F.array(*structs), cols


def expand_scenarios(df: DataFrame, scenarios: Sequence[Mapping], id_col: str) -> DataFrame:
    """ML-5 expansion: every row once per scenario (plus 'base'), with each
    scenario's set fields overriding the row's values. The scenario list is a
    parameter (a handful of structs), exploded in place: no join."""
    types = dict(df.dtypes)
    arr, cols = _scenario_array(scenarios, types)
    x = df.withColumn("__s", F.explode(arr))
    x = x.withColumns({c: F.coalesce(F.col(f"__s.{c}"), F.col(c)) for c in cols})
    return x.withColumn("scenario_id", F.col("__s.scenario_id")).drop("__s")


def score_scenarios(fitted: FittedModel, df: DataFrame, scenarios: Sequence[Mapping]) -> DataFrame:
    """ML-5: probability and band per customer and scenario, with the change
    against the customer's base row (a window over each customer's few rows).
    A table without the id column (the typical customer's one row) is one customer."""
    idc = fitted.id_col
    if idc not in df.columns:
        df = df.withColumn(idc, F.lit("typical"))
    # dealt out by customer before each row is multiplied, so the window needs no further shuffle
    s = score_churn(fitted, expand_scenarios(clean_numbers(df).repartition(idc), scenarios, idc))
    w = Window.partitionBy(idc)
    base_p = F.max(F.when(F.col("scenario_id") == "base", F.col("Churn_Probability"))).over(w)
    base_b = F.max(F.when(F.col("scenario_id") == "base", F.col("Risk_Group"))).over(w)
    out = s.select(idc, "scenario_id", "Churn_Probability", "Risk_Group",
                   base_p.alias("base_probability"), base_b.alias("base_risk_group"))
    return out.where(F.col("scenario_id") != "base").withColumns({
        "delta": F.col("Churn_Probability") - F.col("base_probability"),
        "band_changed": F.col("Risk_Group") != F.col("base_risk_group")})


def attribute(fitted: FittedModel, df: DataFrame, neutral: Mapping[str, Column]) -> DataFrame:
    """ML-6: per customer and feature, logit(p) - logit(p with that feature at
    its typical value). One copy per feature (a fixed, small multiplier), one
    scoring pass, a window over each customer's own rows to rank."""
    idc = fitted.id_col
    c = align(fitted, clean_numbers(df)).repartition(idc)
    feats = [f for f in fitted.features if f in neutral]
    x = c.withColumn("__f", F.explode(F.array(F.lit("__base"), *[F.lit(f) for f in feats])))
    x = x.withColumns({f: F.when(F.col("__f") == f, neutral[f].cast(dict(c.dtypes)[f])).otherwise(F.col(f))
                       for f in feats})
    x = x.withColumnRenamed("__f", "feature_")
    s = score_churn(fitted, x)
    p = F.least(F.greatest(F.col("Churn_Probability"), F.lit(1e-9)), F.lit(1 - 1e-9))
    s = s.withColumn("logit", F.log(p / (1 - p)))
    w = Window.partitionBy(idc)
    base = F.max(F.when(F.col("feature_") == "__base", F.col("logit"))).over(w)
    contrib = s.select(idc, F.col("feature_").alias("feature"), (base - F.col("logit")).alias("contribution"))
    contrib = contrib.where(F.col("feature") != "__base")
    r = Window.partitionBy(idc).orderBy(F.desc(F.abs("contribution")), "feature")
    return contrib.withColumn("rank", F.row_number().over(r))


# --- customer value (ML-12, ML-13) ---------------------------------------------------------

def train_value(df: DataFrame, id_col: str = "customerID", max_iter: int = 50, max_depth: int = 6,
                step: float = 0.3, seed: int = 42, test_pct: int = 20):
    """ML-12 -> (FittedModel, metrics DataFrame): squared-error boosted trees on
    the first present value column; hold-out RMSE and R^2 on a hash split."""
    target = next((t for t in VALUE_TARGETS if t in df.columns), None)
    if target is None:
        raise ValueError("no value column (one of %s)" % ", ".join(VALUE_TARGETS))
    c, nums, cats = prepare(df, id_col, drop=[target])
    data = c.withColumn("__y", to_number(F.col(target)))
    dictionary = fit_dictionary(data, cats)
    train = _encoded(dictionary, data.where(split_column(id_col, test_pct)), nums, cats).persist(StorageLevel.MEMORY_AND_DISK)
    ensure_checkpoint_dir(df.sparkSession)
    fit_on = sized(train)
    gbt = GBTRegressor(featuresCol="__features", labelCol="__y", maxIter=max_iter, maxDepth=max_depth,
                       stepSize=step, seed=seed, predictionCol="__pred",
                       checkpointInterval=10, maxBins=64)
    try:
        model = Pipeline(stages=[_assembler(nums, cats), gbt]).fit(fit_on)
    finally:
        train.unpersist()
    fitted = FittedModel(model, dictionary, nums, cats, id_col, target)
    test = fitted.transform(data.where(~split_column(id_col, test_pct)))
    err = F.col("__pred") - F.col("__y")
    m = test.agg(F.count(F.lit(1)).alias("test_rows"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 F.avg("__y").alias("__mu"), F.sum(err * err).alias("__sse"), F.var_pop("__y").alias("__var"))
    metrics = m.select(F.lit(target).alias("target"), "test_rows", "rmse",
                       (F.lit(1.0) - F.col("__sse") / (F.col("__var") * F.col("test_rows"))).alias("r2"))
    return fitted, metrics


def score_value(fitted: FittedModel, df: DataFrame) -> DataFrame:
    """ML-13: predicted value for every row (errors raise; nothing becomes 0)."""
    out = fitted.transform(clean_numbers(df)).withColumn("Predicted_Value", F.col("__pred"))
    return out.drop(*_internal(out))
