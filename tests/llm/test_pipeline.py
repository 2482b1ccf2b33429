"""Each stage of the pipeline against a brute-force version on its own input, and the registered queries' shapes."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import cases
import corpus_pipeline as P
from clientele.llm import phrase_index, simple8b
from clientele.llm.queries import QUERIES, tokenizer_file
from test_free import brute_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    """Every stage's input and output, written and read again as run() does."""
    folder = tmp_path_factory.mktemp("stages")
    odd = cases.documents(spark)  # null ids, repeated ids and rows, a very long text
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(odd.withColumn("doc_id", odd.doc_id + 100_000))
    out = []
    for name, stage in P.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs.collect(), after.collect(), docs.columns, after.columns))
        docs = after
    return out


def test_stages_keep_the_columns(results):
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "benchmark_passages", "source_mixture", "token_files"]
    for _, _, before, after in results[:-1]:
        assert before == after


def test_language_rejects_texts_without_one(results):
    """Ordinary documents stay, also very short and very long ones; texts without letters go."""
    before, after, *_ = results[0]
    gone = Counter(map(tuple, before)) - Counter(map(tuple, after))
    without = [r for r in before if not any(map(str.isalpha, r.text or ""))]
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))
    assert {tuple(r) for r in without} <= set(gone)
    assert sum(gone.values()) <= len(without) + 0.01 * len(before)


def test_language_rejects_by_fit(spark):
    """A language that was not learned goes, mixtures of learned ones stay, however the shares are."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {r.lang: r.text for r in rows.filter("length(text) > 3000").orderBy("doc_id").collect()}
    rng = np.random.default_rng(1)
    foreign = [" ".join("".join(chr(int(c)) for c in rng.integers(a, z, int(rng.integers(2, 9)))) for _ in range(n))
               for a, z, n in ((0x3B1, 0x3C9, 300), (0x430, 0x450, 40), (0x61, 0x7B, 400))]
    known = [" ".join(w for pair in zip(by[x].split(), by[y].split()) for w in pair) for x, y in (("en", "de"), ("fr", "es"))] + list(by.values())
    extra = [(10**6 + i, t, None, "x", len(t)) for i, t in enumerate(foreign + known)]
    docs = rows.unionByName(spark.createDataFrame(extra, rows.schema))
    out = [tuple(r) for r in P.language(spark, docs, None).collect()]
    kept = {r[0] for r in out if r[0] >= 10**6}
    assert kept == {10**6 + len(foreign) + i for i in range(len(known))}
    assert sum(r[0] < 10**6 for r in out) >= 0.995 * rows.count()


def keepers(rows):
    """(id, text) of the rows that stay, by all pairs of sets."""
    sets = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})))
        k = min(5, len(w))
        sets.append(frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    mark = lambda r: hashlib.md5(f"{'-' if r[0] is None else r[0]}\n{r[1] or ''}".encode()).hexdigest()
    groups = defaultdict(list)
    for a, r in enumerate(rows):
        groups[find(a) if sets[a] else -a - 1].append(r)
    return Counter((x[0], x[1]) for x in (min(g, key=lambda r: (r[0] is None, r[0] or 0, mark(r))) for g in groups.values()))


def test_one_row_of_each_group_stays(results):
    before, after, *_ = results[1]
    assert Counter((r.doc_id, r.text) for r in after) == keepers([tuple(r) for r in before])
    assert any(r.doc_id is None for r in before) and len(after) < len(before)


def test_rows_with_benchmark_windows_go(spark, results):
    before, after, *_ = results[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = Counter(tuple(r) for r in before if not phrase_index.brute_force(r.text, items)[1])
    assert Counter(map(tuple, after)) == want and len(after) < len(before)


def test_rows_not_ids_are_judged(spark):
    """Repeated rows, one id with several texts, null ids: each row by its own text."""
    words = " ".join(f"w{i}" for i in range(60))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("length(text) > 200").first().text
    rows = [(1, words, "en", "a", 1), (1, words, "en", "a", 1), (1, "another text under the same id", "en", "a", 2), (None, words + " x", "en", "a", 3),
            (None, "no id and a text of its own", None, "b", 4), (None, "no id and one more text here", None, None, 5), (2, item, "en", "a", 6),
            (2, "clean text under the id of a leak", "en", "a", 7), (None, item, "en", "a", 8)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(4)
    kept = Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, SF).collect())
    assert kept == keepers(rows) and kept[1, words] == 1 and (None, words + " x") not in kept
    clean = Counter(tuple(r) for r in P.benchmark_passages(spark, docs, SF).collect())
    assert clean == Counter(r for r in rows if r[1] != item)


@pytest.mark.parametrize("make", ["empty", "clashing"])
def test_stages_on_odd_tables(spark, make):
    """No rows, and further columns named as the operators name theirs: every stage keeps the columns and its rows' values."""
    docs = getattr(cases, make)(spark)
    if make == "clashing":
        docs = docs.filter("doc_id < 60")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = {tuple(r) for r in out.collect()}
        assert rows <= {tuple(r) for r in docs.collect()} and bool(rows) == (make == "clashing"), name
    assert P.token_files(spark, docs, SF).count() == docs.count()


def test_mixture(results):
    """Whole documents, each source up to three times over; the words taken are within half a document of the target."""
    before, after, *_ = results[3]
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    have, got, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        have[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in after:
        got[r.source] += size(r)
    names = sorted((s for s in have if s is not None)) + ([None] if None in have else [])
    weight, capped = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, set()
    while True:
        rest = sum(have.values()) - sum(3 * have[s] for s in capped)
        total = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / total > 3 * have[s]}
        if not over:
            break
        capped |= over
    for s in names:
        target = 3 * have[s] if s in capped else rest * weight[s] / total
        assert abs(got[s] - target) <= largest[s] / 2 + 1
    assert all(n <= 3 * Counter(map(tuple, before))[r] for r, n in Counter(map(tuple, after)).items())


def test_token_files(results):
    before, after, *_ = results[4]
    tokens, end = simple8b.Tokens(tokenizer_file()), np.array([1], "<u4").tobytes()
    want = Counter()
    for r in before:
        b = tokens.whole(r.text or "") + end
        want[(r.doc_id, len(b) // 4, zlib.crc32(b))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want
    order = sorted(after, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order])[:-1].tolist()


def test_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_jaccard_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op8_ngram_jaccard"](spark, SF).collect())
    assert got == brute_components(docs, 4, 85)
