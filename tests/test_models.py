"""Model operators: invariants, not numbers (ML-1..13)."""

import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from clientele.functions.clean import clean_numbers
from clientele.operators.churn_model import (attribute, expand_scenarios, score_churn, score_scenarios, score_value,
                                             train_churn, train_value)
from clientele.operators.churn_stats import typical_customer
from clientele.operators.segment_model import fit_kmeans, scaling_pipeline, segment, squared_silhouette
from clientele.operators.topics import assign_topics, fit_topics, vocabulary
from clientele.sources import fixtures as fx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def churn(spark):
    cust = fx.churn_customers(spark, SF)
    fitted, acc = train_churn(cust, max_iter=5)
    return cust, fitted, acc


def test_churn_scores_are_probabilities(churn):
    cust, fitted, acc = churn
    s = score_churn(fitted, cust)
    bad = s.where((F.col("Churn_Probability") < 0) | (F.col("Churn_Probability") > 1)).count()
    assert bad == 0 and s.count() == cust.count()
    a = acc.first()
    assert 0 <= a.accuracy <= 1 and a.test_rows > 0
    bands = s.where(((F.col("Churn_Probability") <= 0.4) & (F.col("Risk_Group") != "Low"))
                    | ((F.col("Churn_Probability") > 0.7) & (F.col("Risk_Group") != "High"))).count()
    assert bands == 0


def test_missing_label_raises(spark):
    with pytest.raises(ValueError):
        train_churn(fx.demographics(spark, SF), id_col="CustomerID")


def test_save_load_same_scores(spark, churn, tmp_path):
    from clientele.operators.churn_model import FittedModel
    cust, fitted, _ = churn
    fitted.save(str(tmp_path / "m"))
    again = FittedModel.load(spark, str(tmp_path / "m"))
    assert (again.numeric, again.categorical, again.id_col, again.target) == (
        fitted.numeric, fitted.categorical, fitted.id_col, fitted.target)
    a = score_churn(fitted, cust).select("customerID", "Churn_Probability")
    b = score_churn(again, cust).select("customerID", F.col("Churn_Probability").alias("p2"))
    assert a.join(b, "customerID").where(F.abs(F.col("Churn_Probability") - F.col("p2")) > 1e-12).count() == 0


def test_unseen_category_and_missing_feature(spark, churn):
    cust, fitted, _ = churn
    odd = cust.limit(3).withColumn("Contract", F.lit("Lifetime")).drop("Support")
    assert score_churn(fitted, odd).count() == 3
    codes = {r[0] for r in fitted.transform(clean_numbers(odd)).select("Contract__ord").collect()}
    assert codes == {-1.0}  # below all known codes


def test_scenarios_and_attribution(spark, churn):
    cust, fitted, _ = churn
    sc = [{"scenario_id": "s1", "Contract": "Two year"}]
    grid = expand_scenarios(clean_numbers(cust), sc, "customerID")
    assert grid.count() == 2 * cust.count()
    assert grid.where("scenario_id = 's1' and Contract <> 'Two year'").count() == 0
    s = score_scenarios(fitted, cust, sc)
    assert s.count() == cust.count()
    typ = typical_customer(clean_numbers(cust))
    neutral = {f: typ.select(f).scalar() for f in fitted.features}
    att = attribute(fitted, cust.limit(20), neutral)
    assert att.count() == 20 * len(fitted.features)
    assert att.where("rank = 1").count() == 20


def test_value_model(spark):
    cust = fx.churn_customers(spark, SF)
    fitted, metrics = train_value(cust, max_iter=3)
    assert fitted.target == "TotalCharges"
    assert metrics.first().rmse >= 0
    assert score_value(fitted, cust).where(F.col("Predicted_Value").isNull()).count() == 0


def test_segments_every_row_one_cluster(spark):
    mode, out, feats = segment(fx.transactions(spark, SF), k=4, restarts=2)
    assert mode == "rfm" and feats == ["Recency", "Frequency", "Monetary"]
    n = out.count()
    assert n == out.select("CustomerID").distinct().count()
    assert out.where(F.col("Cluster").isNull() | F.col("Cluster_Label").isNull()).count() == 0
    sizes = [r["count"] for r in out.groupBy("Cluster").count().orderBy("Cluster").collect()]
    assert sizes == sorted(sizes, reverse=True)


def test_restarts_never_worse_than_one_seed(spark):
    from clientele.operators.rfm import rfm
    t = rfm(fx.transactions(spark, SF))
    feats = ["Recency", "Frequency", "Monetary"]
    scaled = scaling_pipeline(feats).fit(t).transform(t).cache()
    _, one = fit_kmeans(scaled, 4, restarts=1)
    _, best = fit_kmeans(scaled, 4, restarts=4)
    assert best <= one + 1e-9


def test_squared_silhouette_equals_spark_evaluator(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0), (0.1, 0.2, 0), (0.3, 0.1, 0), (5.0, 5.0, 1), (5.2, 4.9, 1), (9.0, 0.0, 2)],
                               "x double, y double, c int")
    mine = squared_silhouette(df, ["x", "y"], "c").first().silhouette
    v = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df).withColumn("prediction", F.col("c").cast("double"))
    theirs = ClusteringEvaluator().evaluate(v)
    assert abs(mine - theirs) < 1e-9


def test_topics(spark):
    from clientele.functions.clean import clean_text
    docs = fx.reviews(spark, "/root/testdata/sf0.001").select("ReviewID", clean_text("ReviewBody").alias("Clean_Text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, "ab"), (-2, None)], "ReviewID long, Clean_Text string"))
    model = fit_topics(docs, k=3, max_iter=3)
    # the DataFrame vocabulary equals what CountVectorizer would fit, in the same order
    from pyspark.ml import Pipeline
    from clientele.operators.topics import topic_pipeline, valid_text
    cv = Pipeline(stages=topic_pipeline("Clean_Text", k=3).getStages()[:3]).fit(docs.where(valid_text("Clean_Text")))
    assert set(cv.stages[2].vocabulary) == {r.term for r in vocabulary(docs).collect()}
    assert set(model.stages[2].vocabulary) == set(cv.stages[2].vocabulary)
    assert model.stages[3].vocabSize() == len(cv.stages[2].vocabulary)
    t = assign_topics(model, docs)
    assert t.count() == docs.count()
    ids = {r.Topic_ID for r in t.select("Topic_ID").distinct().collect()}
    assert ids <= {-1, 0, 1, 2}
    assert {r.Topic_ID for r in t.where("ReviewID < 0").collect()} == {-1}
