"""Documents in blocks, topics whose weights are a table, and what the driver receives."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from clientele.functions.partitioning import sized
from clientele.llm import language_mix
from clientele.operators.bags import frequencies
from clientele.operators.topic_em import fit_topic_em, infer_topics, term_counts
from clientele.operators.topics import KAPPA, TAU, _digamma, _trigamma, assign_topics, describe_topics, fit_topics
from clientele.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
WORDS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(60)]
TEXTS = [(i, " ".join(WORDS[(i * j * j + j) % 60] for j in range(5 + i % 9))) for i in range(120)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, Clean_Text string").repartition(3)


def test_counts_of_repeated_and_null_ids(spark):
    """Rows of one id are one document; rows without an id count as one document of the frequencies and are no other."""
    rows = TEXTS + TEXTS[:7] + [(None, TEXTS[3][1]), (None, "wabx wabx"), (900, None), (901, "ab")]
    counts = term_counts(frame(spark, rows), "id")
    want = Counter(t for ts in _terms(rows).values() for t in ts)
    assert {r.term: r.doc_freq for r in frequencies(counts.bags).collect()} == want and counts.bags.n_docs == 120
    model = fit_topic_em(counts, 2, 2)
    assert sorted(r.doc for r in model.theta.collect()) == list(range(120))


def _terms(rows):
    out = {}
    for i, t in rows:
        if t and len(t) > 2:
            out.setdefault(i, set()).update(t.split())
    return out


def test_counts_as_a_table_give_the_same_model(spark):
    df = frame(spark, TEXTS)
    words = df.select(F.col("id").alias("doc"), F.explode(F.split("Clean_Text", " ")).alias("term")).groupBy("doc", "term").count().withColumnRenamed("count", "n")
    kept = [r.term for r in term_counts(df, "id").kept.collect()]
    a, b = fit_topic_em(term_counts(df, "id"), 3, 3), fit_topic_em(words.where(F.col("term").isin(kept)), 3, 3)
    assert a.trace == pytest.approx(b.trace, rel=1e-10)
    p, q = ({r.term: r.p for r in m.phi.collect()} for m in (a, b))
    assert p.keys() == q.keys() and all(p[t] == pytest.approx(q[t], rel=1e-9) for t in p)
    assert infer_topics(a, term_counts(df, "id")).count() == 120


def test_gamma_derivatives():
    for x in (0.05, 0.3, 1.0, 4.2, 90.0):
        h = 1e-5 * x
        assert _digamma(x) == pytest.approx((math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h), rel=1e-4, abs=1e-4)
        assert _trigamma(x) == pytest.approx((_digamma(x + h) - _digamma(x - h)) / (2 * h), rel=1e-4)


def test_topics_are_a_table(spark):
    """A round moves the topics' weights to the learning rate's share of all counts; copies of a text get one topic each."""
    df = frame(spark, TEXTS + TEXTS[:5] + [(900, None), (901, "ab"), (902, "zzzz yyyy")])
    start, one = fit_topics(df, k=3, max_iter=0), fit_topics(df, k=3, max_iter=1)
    terms = {r.term for r in one.weights.collect()}
    n = sum(w in terms for _, t in TEXTS + TEXTS[:5] for w in t.split())
    rate = (TAU + 1) ** -KAPPA
    assert sum(one.totals) == pytest.approx((1 - rate) * sum(start.totals) + rate * (len(terms) + n), rel=1e-9)
    lam = np.array([list(r)[1:] for r in one.weights.collect()])
    assert lam.sum(axis=0) == pytest.approx(one.totals) and all(a > 0 for a in one.alpha)
    assert describe_topics(one).groupBy("topic").agg(F.count("*").alias("n"), F.max("rank").alias("r")).collect().__len__() == 3
    got = assign_topics(one, df)
    assert got.columns == [*df.columns, "Topic_ID", "Topic_Label"] and got.count() == 128
    by = {}
    for r in got.collect():
        by.setdefault(r.id, set()).add(r.Topic_ID)
    assert all(len(v) == 1 for v in by.values()) and by[900] == by[901] == {-1} and by[902] == {0}


def test_passes_do_not_get_more_tasks_than_cores_can_use(spark):
    """k-means and boosting report once a task and pass to the driver."""
    df = spark.range(0, 5000, 1, 40).persist()
    assert sized(df, rows_per_partition=10).rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_customers_are_not_broadcast(spark):
    """F8-F13: the churn table's sides grow with the customers, so neither goes through the driver."""
    df = fx.churn_customers(spark, SF)
    df.count()
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_language_learns_from_all_documents(spark, monkeypatch):
    """model and floor come from every labelled document that is not held out."""
    seen = []
    for name in ("fit", "with_floor"):
        old = getattr(language_mix, name)
        monkeypatch.setattr(language_mix, name, lambda *a, _old=old, **k: (seen.append(k.get("fit_docs", 0)), _old(*a, **k))[1])
    docs = spark.createDataFrame([(i, f"some words number {'abcdef'[i % 6] * 3}", "en", "s") for i in range(40)], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.language(spark, docs, None).count() == 40 and seen == [None, None]
    chosen, _ = language_mix._chosen(docs, None, "doc_id", "text", "lang")
    assert chosen.count() == docs.where(~language_mix.held_out(F.col("doc_id"))).count()
    assert language_mix._chosen(docs, 5, "doc_id", "text", "lang")[0].count() < chosen.count()
