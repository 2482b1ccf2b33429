"""Language mixtures, page text, phrase index, Jaccard join, licenses and token files against brute force and round trips."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import cases
from clientele.llm import components, fragment_join, html_main, language_mix, license_dictionaries, phrase_index, simple8b, text
from clientele.llm.queries import tokenizer_file

LOWER = str.maketrans({c: c.lower() for c in map(chr, range(65, 91))})
DOCS = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module", params=["documents", "clashing"])
def docs(request, spark):
    return getattr(cases, request.param)(spark).repartition(3)


# ---- language mixtures

def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    model = language_mix.fit(docs)
    out = language_mix.detect(docs, model).filter(language_mix.held_out(F.col("kept.doc_id"))).select("kept.lang", "lang_pred").collect()
    assert len(out) > 200 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_mixture_shares(spark):
    """A text put together from two languages gets both, in about their proportions."""
    rows = spark.read.parquet(DOCS).filter("length(text) > 3000").select("lang", "text").collect()
    en, de = (next(r.text for r in rows if r.lang == x)[:3000] for x in ("en", "de"))
    model = language_mix.fit(spark.read.parquet(DOCS))
    out = language_mix.detect(spark.createDataFrame([(1, en + " " + de[:1000]), (2, en)], "doc_id long, text string"), model).collect()
    by = {r.kept.doc_id: r for r in out}
    assert by[1].langs == ["en", "de"] and by[1].shares[0] == pytest.approx(0.75, abs=0.08)
    assert by[2].langs == ["en"] and by[2].score == 1.0


def brute_mixture(g, c, p, penalty, prior):
    """The best language set of up to three by its penalised likelihood, each set's shares by many rounds of EM."""
    table, n = p[g], c.sum()
    first = ((np.log(table) * c[:, None]).sum(0) / language_mix.OVERLAP + prior).argmax()
    best = None
    for size in (1, 2, 3):
        for some in itertools.combinations(range(p.shape[1]), size):
            pi = np.full(size, 1 / size)
            for _ in range(400):
                w = table[:, some] * pi
                pi = (w / w.sum(1, keepdims=True) * c[:, None]).sum(0) / n
            value = (np.log((table[:, some] * pi).sum(1)) * c).sum() / language_mix.OVERLAP - penalty * np.log(n + 1) * (size - 1)
            if (size > 1 or some[0] == first) and (best is None or value > best[0]):
                best = (value, some, dict(zip(some, pi)))
    return best


def test_mixture_is_that_of_brute_force():
    """Growing the set under the gradient bound gives the set of brute force, and its shares, on nine texts of ten with up to three
    languages; a set that differs (a language added early is not taken back) is never worse by more than one language's penalty."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet(np.full(300, 0.2), 5).T + 1e-6
    p /= p.sum(0)
    prior, penalty, same = np.log(np.full(5, 0.2)), 4.0, 0
    texts = []
    for _ in range(80):
        some = rng.choice(5, int(rng.integers(1, 4)), replace=False)
        mix = p[:, some] @ rng.dirichlet(np.full(len(some), 3.0))
        texts.append(np.unique(rng.choice(300, int(rng.integers(1, 600)), p=mix / mix.sum()), return_counts=True))
    d = np.concatenate([np.full(len(g), i) for i, (g, _) in enumerate(texts)])
    g, c = (np.concatenate(x) for x in zip(*texts))
    fits = np.zeros((len(texts) + 1, 2))
    got = language_mix.shares(d, g, c, len(texts) + 1, p, penalty, prior, fits=fits)
    assert not got[-1].any() and fits[-1].tolist() == [0, 0]
    for i, (tg, tc) in enumerate(texts):
        value, some, pi = brute_mixture(tg, tc, p, penalty, prior)
        chosen = np.flatnonzero(got[i])
        own = (np.log(p[tg] @ got[i]) * tc).sum()
        assert fits[i] == pytest.approx([own / tc.sum(), tc.sum()]) and got[i].sum() == pytest.approx(1)
        assert own / language_mix.OVERLAP - penalty * np.log(tc.sum() + 1) * (len(chosen) - 1) >= value - penalty * np.log(tc.sum() + 1)
        if tuple(chosen) == some:
            same += 1
            assert [got[i][k] for k in some] == pytest.approx([pi[k] for k in some], abs=0.05)
    assert same >= 72


def test_long_texts_in_pieces_have_the_same_trigrams(monkeypatch):
    """Also without any blank, and over line ends: a text in pieces has the trigrams of the whole one."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcé -\n1"), 500)), "x" * 300 + "yz" * 100, "ab"]
    want = [language_mix.trigrams([t]) for t in texts]
    monkeypatch.setattr(language_mix, "CHUNK", 37)
    for t, (_, g, c) in zip(texts[:2], want):
        _, got, counts = language_mix._grams([t])
        assert got.tolist() == g.tolist() and counts.tolist() == c.tolist()


def test_language_odd_cases(spark, docs):
    model = language_mix.fit(spark.read.parquet(DOCS))
    out = language_mix.detect(docs, model).collect()
    assert len(out) == len(cases.rows())
    for r in out:
        if not any(map(str.isalpha, r.kept.text or "")):
            assert (r.lang_pred, r.score, r.langs) == ("und", 0.0, [])
        else:
            assert r.lang_pred in model["langs"] and 0 < r.score <= 1
    nothing = language_mix.fit(cases.empty(spark))
    assert {r.lang_pred for r in language_mix.detect(docs, nothing).collect()} == {"und"}
    assert language_mix.detect(cases.empty(spark), model).count() == 0


def test_long_text_in_slices_counts_alike(monkeypatch):
    words = " ".join(f"Wörter{i} und" for i in range(2000))
    d, g, c = language_mix._grams([words])
    monkeypatch.setattr(language_mix, "CHUNK", 1000)
    d2, g2, c2 = language_mix._grams([words])
    assert (g == g2).all() and (c == c2).all()


# ---- main text

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header class="site-header"><a href=/>Site</a><h2>Name</h2></header><nav>menu</nav>
<div id="cookie-notice">We use cookies, and this is a long sentence about it.</div><main><article><header><h1>Title &amp; more</h1><p>By X</p></header>
<p>First   para&nbsp;with <a href=x>link</a> &eacute; and many words.</p><div class="ad">Buy now</div><ul><li>one<li>two</ul><form><label>Name</label></form>
<p>Second<br>break.</p><aside>side</aside><script>var x="<p>no</p>"</script></article><section id="comments"><article class="comment"><p>I am a
reader comment, long enough to be mistaken for text.</p></article></section></main><div class=sidebar><p>sidebar</p></div><footer>foot</footer></body></html>"""


def test_article_text():
    assert html_main.main_text(PAGE) == "Title & more\n\nFirst para with link é and many words.\n\none\n\ntwo\n\nSecond break."
    assert html_main.main_text(None) == html_main.main_text("") == html_main.main_text("<nav>only</nav>") == ""


def test_region_without_article():
    page = ("<div id=page><div class=x><a href=a>Home</a> <a href=b>About</a></div><h1>Head</h1><div><p>This is a long paragraph with a good number of "
            "words in it.<p>Short.<p>Another long paragraph with many words in it that counts.</div><ul><li><a href=1>x1</a><li><a href=2>x2</a></ul></div>")
    assert html_main.main_text(page) == ("Head\n\nThis is a long paragraph with a good number of words in it.\n\nShort.\n\n"
                                         "Another long paragraph with many words in it that counts.")


LONG = [f"Paragraph {i} of the text has a good number of words in it, as many as a reader would expect of one." for i in range(6)]
TEASER = "<article><h3><a href=/t>Read this too</a></h3><p>A short summary of another story.</p></article>"


@pytest.mark.parametrize("at", [0, 3, 6])
@pytest.mark.parametrize("teaser", [TEASER, TEASER.replace("A short summary of another story.", "<a href=/t>more</a>"), TEASER * 8])
def test_teaser_articles_beside_text_in_divs(at, teaser):
    """Before, within and behind the text; with content of their own, with links only, many of them."""
    parts = [f"<div>{x}</div>" for x in LONG]
    page = "<div><a href=/>Home</a> <a href=/a>About</a></div><h1>Head</h1>" + "".join(parts[:at]) + teaser + "".join(parts[at:]) + "<p><a href=/n>Next</a></p>"
    assert html_main.main_text(page) == "\n\n".join(["Head", *LONG])


def test_text_within_and_outside_articles():
    """Posts stay, however short; a part of the text outside of them stays if it is no less than half of theirs, a blurb does not."""
    parts = [f"<p>{x}</p>" for x in LONG]
    posts = f"<article>{''.join(parts[:3])}</article><article>{parts[3]}</article>"
    assert html_main.main_text(posts) == "\n\n".join(LONG[:4])
    assert html_main.main_text(posts + parts[4]) == "\n\n".join(LONG[:4])
    assert html_main.main_text(f"<article>{''.join(parts[:3])}</article>" + "".join(parts[3:5])) == "\n\n".join(LONG[:5])
    assert html_main.main_text("".join(parts[:3]) + f"<article>{''.join(parts[3:5])}</article>" + parts[5]) == "\n\n".join(LONG)
    assert html_main.main_text("<article><a href=/>only</a></article><p><a href=/>links</a></p>") == "only"


def test_pages_of_the_table(spark):
    """The generated pages hold their article in an ``article`` element: its blocks by pattern."""
    import html as H
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_main.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = [" ".join(H.unescape(re.sub(r"<br[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n\n".join(x for x in (re.sub(r"<[^>]+>", "", b).strip() for b in blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_page_pieces(monkeypatch):
    whole = html_main.main_text(PAGE)
    monkeypatch.setattr(html_main, "PIECE", 7)
    assert html_main.main_text(PAGE) == whole


def test_pages_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, "x"), (1, "u", "", "x"), (1, "u", "<p>a", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_main.extract(df).collect()) == [(0, "", 0), (1, "", 0), (1, "a", 1)]
    assert html_main.extract(df.limit(0)).count() == 0


# ---- decontamination

ITEMS = [(1, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (2, "Élan VITAL"), (3, None), (4, "!!"), (4, "own line 3"),
         (None, "w3 w4"), (6, "the same line stands in every one of these documents the same")]


@pytest.mark.parametrize("block", [500_000, 10])
def test_decontamination(spark, docs, block):
    """Also with the test set in blocks."""
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = phrase_index.decontaminate(docs, bench, length=10, slop=1, block_windows=block).select(
        "doc_id", "n_words", "n_hit", F.size("items").alias("k"), phrase_index.items_sha256(F.col("items")).alias("s")).collect()
    want = Counter((i, *phrase_index.brute_force(t, ITEMS)) for i, t, *_ in cases.rows())
    assert Counter(tuple(r) for r in out) == want


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta noise gamma"), (2, "alpha beta gamma"), (3, "alpha x x x beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_near) for r in phrase_index.decontaminate(docs, bench, length=3, slop=1).collect()}
    assert got == {1: (0, 1), 2: (3, 0), 3: (0, 0)}


@pytest.mark.parametrize("slop", [1, 2])
def test_proximity_within_one_document(spark, slop):
    """No match runs over the end of a text, and one that would start before its text counts for this text."""
    docs = spark.createDataFrame([(1, "x alpha"), (2, "beta gamma"), (3, "x"), (4, "alpha gamma beta")], "doc_id long, text string").coalesce(1)
    for text, want in (("alpha beta gamma", {4} if slop > 1 else {4}), ("alpha delta", set()), ("beta gamma alpha", set())):
        bench = spark.createDataFrame([(1, text)], "item_id long, text string")
        got = {r.doc_id for r in phrase_index.decontaminate(docs, bench, length=3, slop=slop).collect() if r.n_near}
        assert got == want, (text, got)


def test_decontamination_empty(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in phrase_index.decontaminate(docs, bench).collect()} == {0}
    assert phrase_index.decontaminate(cases.empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# ---- Jaccard join

def sets_of(rows, k):
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append((i, frozenset(tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()))
    return out


def brute_components(rows, k, percent):
    sets = sets_of(rows, k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        o = len(sets[a][1] & sets[b][1])
        if o and 100 * o >= percent * (len(sets[a][1]) + len(sets[b][1]) - o):
            root[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    return Counter((i, len(s), low.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k,percent", [(4, 85), (1, 60), (5, 80)])
def test_jaccard_components(docs, k, percent):
    out = fragment_join.jaccard_components(docs, k, percent).collect()
    assert Counter(tuple(r) for r in out) == brute_components(cases.rows(), k, percent)


def test_jaccard_chains_and_heavy_ngrams(spark):
    """Near copies of one text with ever more changes, and a passage in all: links by chains only, heavy n-grams last in order."""
    rng = np.random.default_rng(3)
    passage = [f"p{i}" for i in range(30)]
    rows, words = [], [f"v{i}" for i in range(120)]
    for i in range(40):
        words = list(words)
        words[int(rng.integers(0, 120))] = f"n{i}"
        rows.append((i, " ".join(passage + words)))
    rows += [(100 + i, " ".join(passage + [f"z{i}-{j}" for j in range(40)])) for i in range(30)]
    out = fragment_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 80).collect()
    assert Counter(tuple(r) for r in out) == brute_components(rows, 3, 80)


def test_jaccard_order(spark):
    """Classes follow the counters; fragments cut the order of class and hash into equal parts."""
    texts = ["a b c d e f"] * 50 + [f"x{i} y{i} z{i}" for i in range(3000)]
    order = fragment_join.order_table(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 1)
    assert len(order["classes"]) == fragment_join.SLOTS and order["before"][-1] == pytest.approx(1)
    common, rare = (np.unique(text.shingle_hashes(np.concatenate(text.doc_words(t)), 1)) for t in (texts[:1], texts[50:]))
    assert fragment_join._classes(common, order).min() >= 50 and np.median(fragment_join._classes(rare, order)) == 1
    cuts = np.concatenate([fragment_join._cuts(x, order) for x in [rare] + [common] * 50])
    assert set(np.bincount(cuts, minlength=8) > 800) == {True}


def test_jaccard_empty(spark):
    assert fragment_join.jaccard_components(cases.empty(spark)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\nCé", max_size=30), max_size=5))
def test_word_hashes_follow_words(texts):
    ids = {}
    for t, h in zip(texts, text.doc_words(texts)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOWER))
        assert len(w) == len(h)
        for a, b in zip(w, h.tolist()):
            assert ids.setdefault(a, b) == b
    assert len(set(ids.values())) == len(ids)


def test_word_hashes_in_slices(monkeypatch):
    data = ("some words " * 50 + "x" * 300 + "\n" + "y z " * 40).encode()
    want, at, size = text.word_hashes(data)
    monkeypatch.setattr(text, "SLICE", 64)
    got, at2, size2 = text.word_hashes(data)
    assert (want == got).all() and (at == at2).all() and (size == size2).all()
    assert [data[a:a + n] for a, n in zip(at.tolist(), size.tolist())] == data.split()


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{100 + i: 100 for i in range(20)}, 200: 200, 201: 200}


# ---- licenses

def test_licenses_of_the_table(spark):
    known = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    docs = spark.read.parquet(DOCS)
    got = {r.doc_id: [(x.start, x.end, x.license) for x in r.found] for r in license_dictionaries.scan(docs).collect()}
    hits = 0
    for r in docs.select("doc_id", "text").collect():
        want = sorted((m.start(), m.end() - 1, v) for k, v in known.items() for m in re.finditer(re.escape(k), r.text))
        hits += len(want)
        assert got[r.doc_id] == want
    assert hits > 10


@pytest.mark.parametrize("words,want", [
    ("LICENSED under the GNU Lesser General Public License,\n version 3", ["LGPL-3.0"]), ("Licensed under the Apache License, Version 1.1.", []),
    ("licensed under CC BY-SA 4.0 and Released under the MIT license", ["CC-BY-SA-4.0", "MIT"]), ("your driving license, version 2.0", []), ("license " * 9000, [])])
def test_license_wordings(spark, words, want):
    df = spark.createDataFrame([(1, words), (2, None), (3, "İ " + words)], "doc_id long, text string")
    got = {r.doc_id: [x.license for x in r.found] for r in license_dictionaries.scan(df).collect()}
    assert got == {1: want, 2: [], 3: want}


def pseudo_prose(n, seed):
    rng = np.random.default_rng(seed)
    return [f"{'bcdfghklmnprstvz'[i % 16]}{'aeiou'[i % 5]}w{'qxyjkz'[i % 6]}{i}q" for i in np.minimum(rng.zipf(1.3, n), 5000).tolist()]


@pytest.mark.parametrize("every", [2000, 150])
def test_verbatim_notices_in_long_blocks(every):
    """Each notice is found in a block of the largest size, where its dictionary makes the compressed block no smaller."""
    templates = license_dictionaries.Templates(license_dictionaries.NOTICES)
    negative = 0
    for k, (name, words, *_) in enumerate(templates.items):
        block = pseudo_prose(license_dictionaries.MOST_WORDS, k)
        at = range(100, len(block) - len(words), every)
        for i in at:
            block[i:i + len(words)] = words
        got = templates.judge(tuple(block))
        assert [(n, a, z, d) for n, a, z, _, d in got] == [(name, i, i + len(words), 0) for i in at]
        negative += any(x[3] <= 0 for x in got)
    assert negative > 10


@pytest.mark.parametrize("gap", [0, 5])
def test_altered_copies_beside_an_intact_one(gap):
    """A copy with a word left out or changed is found before and behind an intact copy, and alone."""
    templates = license_dictionaries.Templates(license_dictionaries.NOTICES)
    prose, n = pseudo_prose(100, 1), 0
    for name, words, telling, _ in templates.items:
        allowed, size = int(0.1 * len(words)), len(words)
        for k in (k for k in range(size) if words[k] not in telling and allowed > 1):
            left_out = words[:k] + words[k + 1:], 0, size - 1, 1
            cut = (k == 0), size - (k == size - 1), 1 if k in (0, size - 1) else 2
            for altered, first, end, differ in [left_out, (words[:k] + ["changedword"] + words[k + 1:], *cut)]:
                for copies in ([words, altered], [altered, words], [altered], [altered, words, altered]):
                    block, want = prose[:50], []
                    for c in copies:
                        a, z, d = (0, size, 0) if c is words else (first, end, differ)
                        want.append((name, len(block) + a, len(block) + z, d))
                        block = block + c + prose[50:50 + gap]
                    got = templates._judge(tuple(block + prose[50:]))
                    assert [(m, a, z, d) for m, a, z, _, d in got] == want, (name, k, copies)
                    n += 1
    assert n > 1000


def test_differences_are_counted_over_all_words():
    """As many words of a notice may be changed as its differences allow, also if other words stand in it twice."""
    templates = license_dictionaries.Templates(license_dictionaries.NOTICES)
    name, words, *_ = next(x for x in templates.items if x[0] == "MIT" and len(x[1]) > 60)
    once = [k for k, w in enumerate(words) if words.count(w) == 1 and 0 < k < len(words) - 1][::5][:int(0.1 * len(words))]
    block = pseudo_prose(50, 1) + [w for k, w in enumerate(words) if k not in once] + pseudo_prose(50, 2)
    assert [(n, a, z, d) for n, a, z, _, d in templates.judge(tuple(block))] == [(name, 50, 50 + len(words) - len(once), len(once))]


def test_notice_at_the_edge_of_blocks(spark):
    """A notice that one block has cut and the next has whole is one span."""
    notice = next(t for n, t in license_dictionaries.NOTICES if n == "MIT" and len(t) > 200)
    words = license_dictionaries.WORD.findall(notice.lower())
    for cut in (1, 4):
        before = pseudo_prose(license_dictionaries.MOST_WORDS - len(words) + cut, cut)
        before[::100] = ["license"] * len(before[::100])
        text = " ".join(before) + " " + notice + " license" * 200
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        [row] = license_dictionaries.scan(df).collect()
        assert row.n_blocks > 1 and [(x.license, x.start, x.end, x.differences) for x in row.found] == [("MIT", text.index(notice), text.index(notice) + len(notice), 0)]


def test_licenses_odd_cases(spark, docs):
    assert license_dictionaries.scan(docs).count() == len(cases.rows())
    assert license_dictionaries.scan(cases.empty(spark)).count() == 0


# ---- token files

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70_000), st.just(0), st.integers(0, 2 ** 64 - 1)), max_size=3000))
def test_pack_round_trip(ids):
    a = np.array(ids, np.uint64)
    words, first, escapes = simple8b.pack(a)
    assert (simple8b.unpack(words, first, len(a), escapes) == a).all()


def test_blocks_are_independent_and_small():
    a = np.random.default_rng(0).integers(0, 49408, 10_000).astype(np.uint64)
    words, first, _ = simple8b.pack(a)
    assert len(first) == 10 and len(words) * 64 < 21 * len(a)
    assert (simple8b.unpack(words[int(first[3]):int(first[4])], np.zeros(1, np.uint64), 1024, 0) == a[3 * 1024:4 * 1024]).all()


ODD = ["it's don't 'tis ,'s we'LL A̱ H̱x Å é'a a'é “q”,x —, <|endoftext|>yes x<|startoftext|>", "ﬁ ½ 1½ ５ a5b 55 a\x01b !\x01! \x1f a\x85b c",
       "ΑΣ ΣΑΣ. İstanbul K", "é, é. ,́ ≠ a≠ ;̸x", "it's!'s 'S'T a'S' ÉÈ!! d'été l'eau×2÷ ñ5é", "'''a''' 'a' (a') a-'b x'y'z", "", "   "]


def test_tokens_equal_the_library(spark):
    texts = ODD + [r.text for r in spark.read.parquet(DOCS).select("text").limit(150).collect()]
    tokens = simple8b.Tokens(tokenizer_file())
    assert tokens.encode(texts) == [tokens.whole(t) for t in texts]
    tokens.MOST = 10  # a full memory changes nothing
    tokens.known.clear()
    assert tokens.encode(texts) == [tokens.whole(t) for t in texts] and len(tokens.known) <= 10


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aA'é.,;<|>5 \t\ń̸ñ×÷_-"), st.characters(codec="utf-8")), max_size=25))
def test_tokens_of_any_text(value):
    if not hasattr(test_tokens_of_any_text, "t"):
        test_tokens_of_any_text.t = simple8b.Tokens(tokenizer_file())
    t = test_tokens_of_any_text.t
    assert t.encode([value])[0] == t.whole(value)


def test_token_files(spark, docs, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/ids"
    simple8b.write_ids(docs, folder, tokenizer_file())
    tokens = simple8b.Tokens(tokenizer_file())
    end = np.array([1], "<u4").tobytes()
    want = [(i, tokens.whole(t or "") + end) for i, t, *_ in cases.rows()]
    out = simple8b.read_index(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((i, len(b) // 4, zlib.crc32(b)) for i, b in want)
    order = sorted(out, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0] + [r.n_tokens for r in order[:-1]]).tolist()
    assert [-1 if r.doc_id is None else r.doc_id for r in order] == sorted(-1 if i is None else i for i, _ in want)
    ids = Counter((r.doc_id, np.array(r.ids, "<u4").tobytes()) for r in simple8b.read_ids(spark, folder).collect())
    assert ids == Counter(want)


def test_token_files_of_nothing(spark, tmp_path):
    simple8b.write_ids(cases.empty(spark), f"file://{tmp_path}/ids", tokenizer_file())
    assert simple8b.read_index(spark, f"file://{tmp_path}/ids").count() == 0


def test_frames_hold_whole_documents(spark, tmp_path, monkeypatch):
    docs = [(d, np.arange(d * 7 % 300).astype(np.uint64)) for d in range(50)]
    content = b"".join(simple8b.frame(0, k, [d], [len(a)], a) + b"\n" for k, (d, a) in enumerate(docs))
    got = [(ids[0], out) for _, _, ids, _, out in simple8b.frames(content)]
    assert all(d == e and (a == b).all() for (d, a), (e, b) in zip(docs, got)) and len(got) == 50
    with pytest.raises(ValueError):
        list(simple8b.frames(content[1:]))
    assert hashlib.sha256(content).hexdigest() == hashlib.sha256(content).hexdigest()
