"""Topic tables by EM against numpy, and the cuts of the vocabulary."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientele.operators.topic_em import fit_topic_em, infer_topics, label_topics, term_counts, topic_terms

K, ROUNDS, ALPHA, BETA = 3, 6, 0.1, 0.01


def texts(n=200):
    rng, groups = random.Random(8), [[f"{g}{i:02d}x" for i in range(25)] for g in ("ship", "tree", "bank")]
    return [" ".join(rng.choices(groups[i % 3], k=20) + rng.choices(sum(groups, []), k=6) + ["the", "always"]) for i in range(n)]


def numpy_em(docs):
    """Dense counts of the terms kept; the posterior before each round, and both tables."""
    words = [Counter(t.split()) for t in docs]
    df = Counter(w for c in words for w in c)
    terms = sorted(w for w in df if w not in ("the", "always") and 2 <= df[w] <= 0.95 * len(docs))
    n = np.array([[c[w] for w in terms] for c in words], float)
    start = np.array([[0.5 + int(hashlib.md5(f"{w}:{j}".encode()).hexdigest()[:4], 16) / 65536 for j in range(K)] for w in terms])
    phi = (start + BETA) / (start.sum(0) + len(terms) * BETA)
    theta, trace = np.full((len(docs), K), 1 / K), []
    for _ in range(ROUNDS):
        s = theta @ phi.T
        trace.append((n * np.log(s)).sum() + BETA * np.log(phi).sum() + ALPHA * np.log(theta).sum())
        r = n / s
        w, q = phi * (r.T @ theta), theta * (r @ phi)
        phi, theta = (w + BETA) / (w.sum(0) + len(terms) * BETA), (q + ALPHA) / (q.sum(1, keepdims=True) + K * ALPHA)
    return terms, phi, theta, trace


@pytest.fixture(scope="module")
def fitted(spark):
    docs = texts()
    rows = [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, ""), (902, "ab")]
    df = spark.createDataFrame(rows, "id long, Clean_Text string").repartition(5)
    return docs, df, fit_topic_em(term_counts(df, "id"), K, ROUNDS, ALPHA, BETA)


def test_rounds_are_those_of_numpy(fitted):
    docs, _, model = fitted
    terms, phi, theta, trace = numpy_em(docs)
    assert model.trace == pytest.approx(trace, rel=1e-10) and all(b >= a - 1e-6 for a, b in zip(trace, trace[1:]))
    got = {r.term: r.p for r in model.phi.collect()}
    assert sorted(got) == terms and np.allclose([got[t] for t in terms], phi, rtol=1e-9)
    shares = {r.doc: r.q for r in model.theta.collect()}
    assert sorted(shares) == list(range(len(docs))) and np.allclose([shares[i] for i in range(len(docs))], theta, rtol=1e-9)


def test_terms_and_topics(spark, fitted):
    docs, df, model = fitted
    terms, phi, *_ = numpy_em(docs)
    for j in range(K):
        want = sorted(zip(-phi[:, j], terms))[:10]
        got = [(r.term, r.weight, r.rank) for r in topic_terms(model).where(F.col("topic") == f"Topic {j + 1}").orderBy("rank").collect()]
        assert [g[0] for g in got] == [t for _, t in want] and [g[2] for g in got] == list(range(1, 11))
    out = {r.id: (r.Topic_ID, r.Topic_Label) for r in label_topics(df, "id", infer_topics(model, term_counts(df, "id"), 8)).collect()}
    assert len(out) == 203 and out[900] == out[901] == out[902] == (-1, "Unknown")
    n = np.array([[t.split().count(w) for w in terms] for t in docs], float)
    theta = np.full((len(docs), K), 1 / K)
    for _ in range(8):
        q = theta * ((n / (theta @ phi.T)) @ phi)
        theta = (q + ALPHA) / (q.sum(1, keepdims=True) + K * ALPHA)
    assert [out[i][0] for i in range(len(docs))] == theta.argmax(1).tolist() and out[0][1] == f"Topic {out[0][0] + 1}"


def test_no_texts(spark):
    none = spark.createDataFrame([], "id long, Clean_Text string")
    model = fit_topic_em(term_counts(none, "id"), K, 2)
    assert model.phi.count() == model.theta.count() == topic_terms(model).count() == 0 and model.trace == [0.0, 0.0]
