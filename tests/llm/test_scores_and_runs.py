"""Toxicity grammar, centroid clusters and periodic runs against brute force and held-out accuracy."""

import hashlib
import itertools
import math
import os
import sys
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

import cases
from clientele.llm import QUERIES, periodic_runs, ptolemaic, queries, toxic_grammar

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", params=["documents", "clashing"])
def docs(request, spark):
    return getattr(cases, request.param)(spark).repartition(3)


# ---- periodic runs

def brute_runs(words, least):
    """Every maximal stretch of every period, each with its smallest period."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def brute_row(doc_id, text, least=12):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(brute_runs(words, least), key=lambda r: (r[0], r[2]))
    gone = {i for s, n_, q in runs for i in range(s + q, s + n_)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n_},{q}\n" for s, n_, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 90), st.integers(0, 1 << 30), st.booleans()), min_size=1, max_size=4), st.sampled_from([4, 12]))
def test_runs_of_small_alphabets(kinds, least):
    texts = []
    for letters, n, seed, repeat in kinds:
        rng = np.random.default_rng(seed)
        w = rng.integers(0, letters, n)
        if repeat and n:
            a = int(rng.integers(0, n))
            p = 1 + (n - a) // int(rng.integers(2, 9))
            i = np.arange(n)
            w = w[np.where(i < a, i, a + (i - a) % p)]
        texts.append(w.astype(np.int64))
    got = sorted(zip(*(x.tolist() for x in periodic_runs.runs_of(texts, least))))
    assert got == sorted((d, *r) for d, w in enumerate(texts) for r in brute_runs(w.tolist(), least))


def test_runs_in_parts(monkeypatch):
    """Long texts whose grid is held in parts give the same runs."""
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 2, n) for n in (0, 30, 300, 700)] + [np.tile(rng.integers(0, 9, 37), 20)]
    whole = periodic_runs.runs_of(texts, 12)
    monkeypatch.setattr(periodic_runs, "SHORT", 100)
    monkeypatch.setattr(periodic_runs, "PAIRS", 500)
    assert all((a == b).all() for a, b in zip(whole, periodic_runs.runs_of(texts, 12)))
    assert sorted(zip(*(x.tolist() for x in whole))) == sorted((d, *r) for d, w in enumerate(texts) for r in brute_runs(w.tolist(), 12))


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 400), st.integers(1, 4), st.integers(1, 60), st.integers(0, 1 << 30))
def test_common_extensions(n, letters, period, seed):
    rng = np.random.default_rng(seed)
    w = np.append(np.resize(rng.integers(0, letters, period), n), 99)
    w[int(rng.integers(0, n))] = 50
    a, b = rng.integers(0, n, 60), rng.integers(0, n, 60)
    a, b = a[a != b], b[a != b]
    want = [next(k for k in itertools.count() if max(x, y) + k >= len(w) or w[x + k] != w[y + k]) for x, y in zip(a.tolist(), b.tolist())]
    assert periodic_runs.Lce(w)(a, b).tolist() == want


def test_blocks_of_equal_hashes_are_compared(monkeypatch):
    """With a hash that never tells blocks apart, the result is the same."""
    rng = np.random.default_rng(2)
    texts = [np.resize(rng.integers(0, 3, 45), 300), rng.integers(0, 2, 200)]
    want = periodic_runs.runs_of(texts, 12)
    monkeypatch.setattr(periodic_runs, "mix64", lambda x: np.zeros_like(x))
    assert all((a == b).all() for a, b in zip(want, periodic_runs.runs_of(texts, 12)))


def as_rows(out):
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


def test_periodic_query(spark, docs, monkeypatch):
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = as_rows(QUERIES["op13_periodic_runs"](spark, SF))
    short = [(i, t) for i, t, *_ in cases.rows() if t is None or len(t) < 100_000]
    want = sorted((brute_row(i, t) for i, t in short), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))
    assert [r for r in got if r[0] not in (4, 5)] == want and len(got) == len(cases.rows())
    # word0 to word996 over and over: its period is 997
    assert [r[2:6] for r in got if r[0] == 4] == [(0, 60_000, 997, 1000 * 60_000 // 997)]
    monkeypatch.setattr(queries, "table", lambda *_: cases.empty(spark))
    assert QUERIES["op13_periodic_runs"](spark, SF).count() == 0


def test_periodic_query_on_documents(spark):
    """Texts of the table that brute force can do, planted repetitions among them."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: brute_row(r.doc_id, r.text) for r in rows if len((r.text or "").split()) < 250}
    got = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(rows) and len(want) > 300 and sum(r[1] > 0 for r in want.values()) > 30
    assert {i: got[i] for i in want} == want


# ---- centroid clusters

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors(n=300, size=64, spread=0.5, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (9, size))
    rows = [(i, (centres[i % 9] + rng.normal(0, spread, size)).astype(np.float32).tolist(), 0) for i in range(n)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(60)] + [(1000, rows[0][1], 0)]  # copies and a repeated row
    rows += [(2001, None, 0), (2002, [], 0), (2003, rows[1][1][:-1], 0), (2004, rows[1][1] + [0.0], 0), (2005, [None] + rows[1][1][1:], 0),
             (2006, [math.nan] + rows[1][1][1:], 0), (2007, [math.inf] + rows[1][1][1:], 0), (2008, [1e30] + rows[1][1][1:], 0),
             (None, rows[2][1], 0), (7, rows[3][1], 0)]
    return rows


def brute_clusters(rows, k=16, rounds=3, size=64):
    kept = []
    for i, v, _ in rows:
        if v is not None and len(v) == size and all(x is not None and abs(x) < 2**20 for x in v):
            kept.append((i, tuple(math.floor(64 * float(np.float32(x))) for x in v)))
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((square(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        of = [[v for (_, v), (_, j) in zip(kept, assign()) if j == c] for c in range(len(centroids))]
        centroids = [tuple(sum(x) // len(vs) for x in zip(*vs)) if vs else c for c, vs in zip(centroids, of)]
    last = assign()
    inertia = [sum(d for d, j in last if j == c) for c in range(len(centroids))]
    return [(i, j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last)]


def sort_key(r):
    return tuple((x is not None, x or 0) for x in r[:3])


@pytest.mark.parametrize("n", [300, 5])
def test_cluster_query(spark, monkeypatch, n):
    rows = vectors(n) if n > 5 else vectors(40)[:5]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit("clash") for c in ("v", "p", "cluster", "distance", "n", "x")}).repartition(5)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = [tuple(r) for r in QUERIES["op12_centroid_clusters"](spark, SF).collect()]
    assert sorted(got, key=sort_key) == sorted(brute_clusters(rows), key=sort_key)


def test_cluster_nothing(spark):
    empty = ptolemaic.cluster(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    alike = spark.createDataFrame([(i, [0.5] * 64, 0) for i in range(40)], VECTORS)
    assert {(r.cluster, r.distance, r.inertia) for r in ptolemaic.cluster(alike).collect()} == {(0, 0, 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 30), st.sampled_from([1, 50, 1 << 25]))
def test_bounds_hold(seed, size, most):
    """No bound exceeds an exact distance, and the nearest centroid is that of brute force, ties included."""
    rng = np.random.default_rng(seed)
    v, c, p = (rng.integers(-most, most + 1, (n, size)) for n in (50, 7, 6))
    pivots = ptolemaic.choose_pivots(p)
    assert len(np.unique(pivots, axis=0)) == len(pivots)
    bounds = ptolemaic.Bounds(pivots, c)
    exact = np.array([[sum((int(x) - int(y)) ** 2 for x, y in zip(a, b)) for b in c] for a in v], dtype=object)
    least = bounds.squares(ptolemaic._squares(v, pivots))
    assert all(int(least[i, j]) <= exact[i, j] for i in range(50) for j in range(7))
    own, best, _ = ptolemaic.nearest(v, ptolemaic._squares(v, pivots), c, bounds)
    assert [(int(b), int(o)) for b, o in zip(best, own)] == [min((d, j) for j, d in enumerate(row)) for row in exact.tolist()]


def test_bounds_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 300, (16, 8)).astype(np.int64)
    v = centres[rng.integers(0, 16, 2000)] + rng.integers(-20, 21, (2000, 8))
    pivots = ptolemaic.choose_pivots(v[:64])
    _, _, measured = ptolemaic.nearest(v, ptolemaic._squares(v, pivots), centres, ptolemaic.Bounds(pivots, centres))
    assert measured < 0.25 * 16 * len(v)


# ---- toxicity

def test_toxic_held_out(spark):
    out = QUERIES["op11_toxicity"](spark, "/root/testdata/sf0.1").filter("held_out")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = out.join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = ([r.predicted for r in rows if r.toxic == x] for x in (1, 0))
    assert len(toxic) > 60 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_composition_is_the_parts_together():
    """The composed table does what its parts do side by side."""
    parts = [toxic_grammar.INSULTS, toxic_grammar.THREATS, toxic_grammar.TARGETS, toxic_grammar.NEGATIONS, toxic_grammar.REPORTED]
    table, rng = toxic_grammar.grammar(), np.random.default_rng(0)
    for _ in range(50):
        at, states = 0, [0] * len(parts)
        for c in rng.integers(0, toxic_grammar.CLASSES, 40).tolist():
            assert table.factor[at, c] == pytest.approx(math.prod(p.factor[s, c] for p, s in zip(parts, states)))
            assert table.bonus[at, c] == pytest.approx(sum(p.bonus[s, c] for p, s in zip(parts, states)))
            at, states = int(table.next[at, c]), [int(p.next[s, c]) for p, s in zip(parts, states)]


def test_clauses():
    lexicon, table = toxic_grammar.Lexicon({"idiot": 5.0, "scum": 5.0, "blöd*": 5.0}), toxic_grammar.grammar()
    of = lambda t: sum(toxic_grammar.clause_scores(t.lower(), lexicon, table))
    plain = of("an idiot came by")
    assert plain == 5.0 and of("") == of("nothing here. at all") == 0
    assert of("you idiot") > plain > of("he is not an idiot") > 0
    assert of("you idiot, you scum") > of("you idiot") + plain
    assert of('somebody said "an idiot came by" again') < plain and of("she wrote that an idiot came by") < plain
    assert of("you came by. an idiot came by") == plain  # a target counts within its clause
    assert of("i will kill you") > of("kill the process") > 0
    assert of("der blöde mann") == plain and of("not so. an idiot came by") == plain


def test_toxic_odd_cases(spark, docs):
    """Learned from labels of both kinds; odd texts get a score, words of the toxic ones decide."""
    rows = [(i, f"you are trash number w{i}" if i % 2 else f"a fine day number w{i}") for i in range(200)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (5, None), (6, 7)], "doc_id long, toxic int")
    model = toxic_grammar.fit(labelled, labels)
    assert "trash" in model["stems"] and toxic_grammar.fit(labelled.repartition(7), labels) == model
    out = toxic_grammar.score(docs, model).collect()
    assert len(out) == len(cases.rows()) and all(0 <= r.score <= 1 for r in out) and not any(r.predicted for r in out)
    assert {r.score for r in out if r.doc_id in (1, 2, 3)} == {min(r.score for r in out)}
    tried = toxic_grammar.score(spark.createDataFrame([(1, "trash, you trash"), (2, "a fine day")], "doc_id long, text string"), model).collect()
    assert [r.predicted for r in sorted(tried)] == [1, 0]
    for none in (toxic_grammar.fit(labelled, labels.filter("toxic = 1")), toxic_grammar.fit(labelled, labels.limit(0)), toxic_grammar.fit(cases.empty(spark), labels)):
        assert {(r.score, r.predicted) for r in toxic_grammar.score(docs, none).collect()} == {(0.0, 0)}
    assert toxic_grammar.score(cases.empty(spark), model).count() == 0
