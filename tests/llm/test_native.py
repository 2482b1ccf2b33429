"""Curriculum, streaming dedup, line runs and secret scan against brute force on the odd cases."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import cases
from clientele.llm import QUERIES, curriculum, line_runs, secret_owners, stream_dedup, text

LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})


def written(df, tmp_path, name="t"):
    path = f"file://{tmp_path}/{name}.parquet"
    df.write.parquet(path)
    return path


@pytest.fixture(scope="module", params=["documents", "clashing"])
def docs(request, spark):
    return getattr(cases, request.param)(spark).repartition(3)


def test_curriculum_matches_brute_force(docs):
    out = curriculum.curriculum(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(int)
    for _, t, _, s, _ in cases.rows():
        by[s] += size(t)
    names = sorted((s for s in by if s is not None)) + ([None] if None in by else [])
    weight, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, sum(by.values())
    capped: set = set()
    while True:
        rest = total - sum(3 * by[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: 3.0 * by[s] for s in capped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if target[s] > 3 * by[s]}
        if not over:
            break
        capped |= over
    want = Counter((i, size(t), by[s], round(target[s], 6)) for i, t, _, s, _ in cases.rows())
    assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 6)) for r in out) == want
    taken = defaultdict(int)
    for r, in zip(out):
        assert 0 <= r.taken <= 3 * r.size
        assert all(0 <= x.position <= 1 for x in r.instances)
        taken[(r.source_size, round(r.target, 6))] += r.taken
    goal = Counter()
    for s in names:
        goal[(by[s], round(target[s], 6))] += int(target[s] + 1e-9)
    assert dict(taken) == dict(goal)
    again = curriculum.curriculum(docs.repartition(5)).collect()
    assert Counter(map(str, out)) == Counter(map(str, again))


def test_schedule_inverts_its_integral(spark):
    pieces = curriculum.segments(((0.0, 0.0), (0.25, 2.0), (1.0, 1.0)))
    df = spark.range(101).select((F.col("id") / 100).alias("share"))
    rows = df.select("share", curriculum.demand_time(F.col("share"), pieces).alias("t")).collect()
    for share, t in rows:
        done = 0.0
        for a, h, u, v, before in pieces:
            if t >= a:
                x = min(t - a, h)
                done = before + u * x + (v - u) / (2 * h) * x * x
        assert done == pytest.approx(share, abs=1e-9)
    with pytest.raises(ValueError):
        curriculum.segments(((0.0, 1.0), (0.5, 1.0)))


def test_training_order_keeps_columns_and_whole_documents(docs):
    out = curriculum.training_order(docs, cut_last=False)
    assert out.columns == docs.columns
    texts = Counter(t for _, t, *_ in cases.rows())
    got = Counter(r.text for r in out.collect())
    assert set(got) <= set(texts) and all(n <= 3 * texts[t] for t, n in got.items())


@pytest.mark.parametrize("digest", ["sha256", "two"])
def test_exact_dedup(spark, docs, tmp_path, digest):
    """Also with a digest of two values, where only the full texts tell classes apart."""
    fn = stream_dedup.sha256 if digest == "sha256" else (lambda t: F.lpad((F.length(t) % 2).cast("string"), 64, "0"))
    path = written(docs, tmp_path)
    out = stream_dedup.exact_dedup(spark, path, digest=fn).collect()
    groups = defaultdict(list)
    for i, t, *_ in cases.rows():
        groups[(t or "").translate(LOWER)].append(i)
    low = lambda g: max((i for i in g if i is not None), default=None)
    want = Counter((i, low(g), len(g)) for g in groups.values() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    assert all(r.verified for r in out)


def test_dedup_state_goes_on(spark, tmp_path):
    """A second run takes only new files and finds copies of what the state holds."""
    folder, state = f"file://{tmp_path}/docs", f"file://{tmp_path}/state"
    spark.createDataFrame([(1, "One text"), (2, "two")], "doc_id long, text string").write.parquet(folder)
    stream_dedup.ingest(spark, folder, state)
    spark.createDataFrame([(3, "one TEXT")], "doc_id long, text string").write.mode("append").parquet(folder)
    stream_dedup.ingest(spark, folder, state)
    got = {r.digest: (r.keep_id, r.group_size) for r in stream_dedup.classes(spark, state).collect()}
    assert got == {hashlib.sha256(b"one text").hexdigest(): (3, 2), hashlib.sha256(b"two").hexdigest(): (2, 1)}


@pytest.mark.parametrize("min_docs,min_chars", [(10, 1), (2, 5)])
def test_line_dedup(docs, min_docs, min_chars):
    out = line_runs.drop_repeated_lines(docs, min_docs=min_docs, min_chars=min_chars, n_batches=3, fanout=2).collect()
    strip = " \t\n\x0b\x0c\r"
    keys = [[line.strip(strip).translate(LOWER) for line in (t or "").split("\n")] for _, t, *_ in cases.rows()]
    n = Counter(k for ks in keys for k in set(ks) if len(k) >= min_chars)
    want = Counter()
    for (i, t, *_), ks in zip(cases.rows(), keys):
        kept = [line for line, k in zip((t or "").split("\n"), ks) if n[k] < min_docs]
        want[(i, len(ks), len(ks) - len(kept), "\n".join(kept))] += 1
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in out) == want


def test_line_dedup_query_meets_settled_runs(spark, monkeypatch):
    """With the query's own settings later batches hold keys of the settled runs, lose them, and runs rise over several levels."""
    add, met, lost, levels = line_runs.LineRuns.add, [], [], []

    def watched(self, batch):
        settled = self._plain(self.settled).select("h").distinct() if self.settled else None
        met.append(batch.join(settled, "h", "left_semi").count() if settled is not None else 0)
        n, write = batch.count(), self._write
        self._write = lambda df, *a: (lost.append(n - df.count()), setattr(self, "_write", write), write(df, *a))[-1]
        add(self, batch)
        levels.append(len(self.levels))

    monkeypatch.setattr(line_runs.LineRuns, "add", watched)
    QUERIES["op5_line_dedup"](spark, "/root/testdata/sf0.01")
    assert met == lost and sum(x > 0 for x in met) >= len(met) // 2 and max(levels) >= 3


def test_settled_keys_are_each_there_once(spark):
    """Also one that is settled by low levels and then again by the runs of higher ones; single runs are compacted as well."""
    for batches in ([9, 0, 9, 0, 5, 5], [9, 0, 0, 0, 9, 0, 10, 0], [12], [3]):
        store = line_runs.LineRuns(spark, text.scratch(spark, "line-runs"), 10, 2, buckets=2)
        for n in batches:
            store.add(spark.createDataFrame([("a" * 32, n)] * (n > 0), "h string, n long"))
        assert [r.h for r in store.finish().collect()] == ["a" * 32] * (sum(batches) >= 10)


def spans_of(text):
    out = []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(docs):
    out = secret_owners.scan_secrets(docs).collect()
    want = Counter((i, tuple((k, a, z) for a, _, k, z in spans_of(t or ""))) for i, t, *_ in cases.rows())
    got = Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans or [] if s.kind != "owned")) for r in out)
    assert got == want
    owned = {(r.doc_id, s.start, s.end) for r in out for s in r.spans or [] if s.kind == "owned"}
    assert owned == {(53, 5, 24)}  # the bare value of a key that document 52 assigns


def brute_secrets(rows, max_owners=2, max_repos=4):
    """Per row its spans with owners, repositories and live, by looking every value up in all texts."""
    bare, wide = r"[A-Za-z0-9_-]{16,}", r"[A-Za-z0-9+/_.=-]{15,}[A-Za-z0-9+/_=-]"
    held, found = defaultdict(set), []
    for row, (i, t, source) in enumerate(rows):
        t = t or ""
        mine = [(a, place, kind, z, t[a:z]) for a, place, kind, z in spans_of(t)]
        mine = [(a, p, k, z, re.fullmatch(r"(?is).*?[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", v)[1] if k == "assign" else v) for a, p, k, z, v in mine]
        for pattern, edge in ((bare, "[A-Za-z0-9_-]"), (wide, "[A-Za-z0-9+/_.=-]")):
            for m in re.finditer(f"(?<!{edge})" + pattern, t):
                if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and (pattern == bare or re.search("[+/.=]", m[0])):
                    mine.append((m.start(), 3, "owned", m.end(), m[0]))
        found.append([(a, p, k, z, v.rstrip(".")) for a, p, k, z, v in mine])
        for _, _, k, _, v in found[-1]:
            held[v].add((source, t, k != "owned"))
    out = []
    for (i, t, _), mine in zip(rows, found):
        spans = []
        for a, p, k, z, v in mine:
            owners, repos = len({s for s, _, _ in held[v]}), len({(s, x) for s, x, _ in held[v]})
            look = len(set(v)) >= 8 and re.search("[A-Za-z]", v) and re.search("[0-9]", v) and not re.search(secret_owners.PLACEHOLDERS, v)
            live = bool(look) and owners <= max_owners and repos <= max_repos
            if k != "owned" or (live and any(b for _, _, b in held[v]) and not any(a < y and x < z for x, _, kk, y, _ in mine if kk != "owned")):
                spans.append((a, p, k, z, owners, repos, live))
        out.append((i, tuple(sorted(spans))))
    return Counter(out)


def test_ownership_is_brute_force(spark):
    """Owners, repositories, live and owned spans; values longer than a prefix could tell, in all alphabets, copies of a document."""
    late = "A" * 300 + "b1c2d3e4f5g6"
    rows = [(1, f"token = {late}", "s1"), (2, f"see {late} here", "s2"), (3, "secret: ab+/Zz9.Qw8=Er7Ty6 end", "s1"), (4, "key ab+/Zz9.Qw8=Er7Ty6.", "s3"),
            (5, "x=Zz9Qw8Er7Ty6Ui5Po4 and Zz9Qw8Er7Ty6Ui5Po4", "s1"), (6, "password: Zz9Qw8Er7Ty6Ui5Po4.", "s1"), (7, None, "s1"), (8, "", None)]
    rows += [(20 + i, "api_key=Copied9Qw8Er7Ty6Ui5 stands here", "s4") for i in range(9)] + [(40, "bare Copied9Qw8Er7Ty6Ui5", "s4")]
    rows += [(50 + i, f"token=Wide9Qw8Er7Ty6Ui5Po{i % 2} in {i}", f"s{i}") for i in range(8)] + [(70, "Wide9Qw8Er7Ty6Ui5Po1", "s1"), (71, "a" * 40 + " token=example1A2b3C4d5E6f", None)]
    out = secret_owners.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    got = Counter((r.doc_id, tuple((s.start, s.place - 1, s.kind, s.end, s.owners, s.repos, s.live) for s in r.spans or [])) for r in out)
    assert got == brute_secrets(rows)
    by = {r.doc_id: [s.kind for s in r.spans or []] for r in out}
    assert by[2] == ["owned"] and by[4] == ["owned"] and by[5] == ["owned"] * 2 and by[40] == ["owned"] and by[70] == []


def test_widely_copied_secret_is_no_live_one(spark):
    rows = [(i, "token = Zz9Qw8Er7Ty6Ui5Po4", f"s{i}") for i in range(6)] + [(9, "see Zz9Qw8Er7Ty6Ui5Po4", "s9")]
    out = secret_owners.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    by = {r.doc_id: r.spans for r in out}
    assert by[9] is None
    assert not by[0][0].live and by[0][0].owners == 7


def test_empty_tables(spark, tmp_path):
    docs = cases.empty(spark)
    assert curriculum.curriculum(docs).count() == 0
    assert line_runs.drop_repeated_lines(docs).count() == 0
    assert secret_owners.scan_secrets(docs).count() == 0
    assert stream_dedup.exact_dedup(spark, written(docs, tmp_path)).count() == 0


def test_python_functions_get_long_texts_in_small_batches(spark):
    """40 MB of text reach a function of a written table a few megabytes at a time; the session keeps its settings."""
    import pyarrow as pa
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"b": [batch.nbytes], "n": [batch.num_rows]})
    before = spark.conf.get(key, None)
    rows = spark.range(4000, numPartitions=1).select(F.repeat(F.lit("ten chars "), 1000).alias("t"))
    got = text.written(rows.mapInArrow(sizes, "b long, n long"), "sizes").agg(F.max("b").alias("b"), F.sum("n").alias("n")).first()
    assert got.n == 4000 and got.b < 2 * text.BATCH_BYTES
    assert spark.conf.get(key, None) == before
