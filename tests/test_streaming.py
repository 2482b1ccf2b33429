"""Operators applied to the micro-batches of a stream."""

from clientele.functions.clean import risk_band
from clientele.operators.rules import persona_churn
from clientele.operators.sentiment import analyze_sentiment
from clientele.streaming import score_stream


def test_personas_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, 0.9), (2, 0.1)], "customerID long, probability double").write.parquet(str(src))
    stream = spark.readStream.schema("customerID long, probability double").parquet(str(src))
    q = score_stream(stream, lambda d: persona_churn(d).withColumn("Risk_Group", risk_band("probability")),
                     str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {r.customerID: (r.Persona, r.Risk_Group) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: ("Flight Risk (Critical)", "High"), 2: ("Loyalist", "Low")}


def test_sentiment_on_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "good!"), (2, "not good"), (3, "")], "id long, t string").write.parquet(str(src))
    lex = spark.createDataFrame([("good", 1.9)], "token string, valence double")
    stream = spark.readStream.schema("id long, t string").parquet(str(src))
    q = score_stream(stream, lambda d: analyze_sentiment(d, "t", lex, "id"), str(tmp_path / "out"),
                     str(tmp_path / "ckpt"))
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.Sentiment_Label for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "Positive", 2: "Negative", 3: "Neutral"}
