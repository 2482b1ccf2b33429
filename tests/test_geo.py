"""Location clean-up and the resolution cascade (PRJ-10, JOIN-1..6)."""

import difflib
import random
from collections import Counter

from pyspark.sql import functions as F

from clientele.operators.geo import (analyze_locations, clean_location, common_subsequence, distinct_locations,
                                     exact_tier, fuzzy_tier, fuzzy_tier_ratio, substring_tier)
from clientele.operators.similarity import candidate_pairs, contained_keys, matching_ratio
from clientele.sources.dimensions import gazetteer, gazetteer_rows, iata


def cleaned(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, loc string")
    return [r.clean_loc for r in clean_location(df, "loc", iata(spark)).orderBy("id").collect()]


def test_clean_location_rules(spark):
    got = cleaned(spark, ["London to Paris", "Rome-Milan", "St Lucia via Barbados", "lhr", "Fort Lauderdale",
                          "Mexico City", "Leeds (LBA)", "Orlando, Florida", " Zürich ", "nan", "", None,
                          "Manchester Airport", "İstanbul"])
    assert got == ["london", "rome", "st lucia", "london", "lauderdale", "mexico", "leeds", "orlando", "zurich",
                   None, None, None, "manchester", "istanbul"]


def test_cascade_tiers_and_row_count(spark):
    vals = ["Paris", "Greater Dublin Area", "Mnchester", "Limassol", "Xyzzy", None, "LHR"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, loc string")
    out = analyze_locations(df, "loc", gazetteer(spark), iata(spark)).orderBy("id").collect()
    assert len(out) == len(vals)
    assert [r.match_tier for r in out] == ["exact", "substring", "fuzzy", "substring", "none", None, "exact"]
    # the substring tier keeps the reference's false hit (a key inside a longer name)
    assert out[3].lat is not None
    assert [r.Mapped_Location for r in out][:3] == ["Paris", "Greater Dublin Area", "Mnchester"]


def test_fuzzy_tie_goes_to_larger_key(spark):
    gaz = spark.createDataFrame([(0, "abcd", 0.0, 0.0, "X"), (1, "abce", 1.0, 1.0, "Y")],
                                "ord int, key string, lat double, lon double, iso3 string")
    cities = spark.createDataFrame([("abcf",)], "city string")
    r = fuzzy_tier(cities, gaz).first()
    assert r.key == "abce" and abs(r.score - 0.75) < 1e-12


def test_distinct_locations_skip_empty(spark):
    df = spark.createDataFrame([("a",), ("",), (None,), ("a",)], "clean_loc string")
    assert distinct_locations(df).count() == 1


def test_all_tiers_are_equi_joins(spark):
    df = spark.createDataFrame([(1, "Mnchester")], "id int, loc string")
    cities, gaz = distinct_locations(clean_location(df, "loc", iata(spark))), gazetteer(spark)
    for tier in (exact_tier, substring_tier, fuzzy_tier, fuzzy_tier_ratio):
        plan = tier(cities, gaz)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_shortened_names_resolve(spark):
    """What the reference's measure accepts is accepted by default."""
    vals = ["manches", "edinbu", "copenha", "Xyzzy"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, loc string")
    out = analyze_locations(df, "loc", gazetteer(spark), iata(spark)).orderBy("id").collect()
    assert [r.match_tier for r in out] == ["fuzzy", "fuzzy", "fuzzy", "none"]


def test_candidates_lose_no_pair(spark):
    """Every pair that reaches the cutoff by either measure is among the joined candidates."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(150)})
    cities = spark.createDataFrame([(w,) for w in words[::2]], "city string")
    gaz = spark.createDataFrame([(i, w, 0.0, 0.0, "X") for i, w in enumerate(words[1::2])],
                                "ord int, key string, lat double, lon double, iso3 string")
    for cutoff in (0.6, 0.75, 0.9):
        got = [tuple(r) for r in candidate_pairs(cities, gaz, cutoff).collect()]
        overlap = lambda a, b: sum((Counter(a) & Counter(b)).values())
        want = {(a, b) for a in words[::2] for b in words[1::2] if 2 * overlap(a, b) >= cutoff * (len(a) + len(b)) - 1e-12}
        assert len(got) == len(set(got)) and set(got) == want
        assert all((a, b) in want for a in words[::2] for b in words[1::2] if 2 * lcs(a, b) >= cutoff * (len(a) + len(b)) - 1e-12)


def test_ratio_is_the_standard_matcher(spark):
    """Every pair of the place names, random texts of few letters, and long texts with frequent characters."""
    rng = random.Random(11)
    names = [r[1] for r in gazetteer_rows()]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(150)] + [(a, a) for a in names[:5]]
    pairs += [("".join(rng.choices("abé ", k=rng.randint(0, 14))), "".join(rng.choices("abé ", k=rng.randint(0, 14)))) for _ in range(250)]
    for n in (199, 200, 230):
        text = "".join(rng.choices("ab", k=n))
        rare = list(text)
        for i in rng.sample(range(n), 12):
            rare[i] = rng.choice("xyzuvw")
        pairs += [("".join(rare[20:190]), "".join(rare)), (text[:150], text), ("".join(rare), text)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(4)
    for r in rows.select("a", "b", matching_ratio(F.col("a"), F.col("b")).alias("r")).collect():
        want = difflib.SequenceMatcher(None, r.a, r.b).ratio() if r.a or r.b else None
        assert (r.r if want is not None else None) == want, (r.a, r.b)


def test_ratio_tier_is_get_close_matches(spark):
    """What is accepted, and which key, is what the standard library gives on all pairs of misspelt names and keys."""
    rng = random.Random(4)
    keys = [r[1] for r in gazetteer_rows()]
    cities = set()
    for k in keys:
        for _ in range(4):
            w = list(k)
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice("aeinrst ")) if rng.random() < 0.5 else w and w.pop(rng.randrange(len(w)))
            cities.add("".join(w))
    cities.discard("")
    got = {r.city: r.key for r in fuzzy_tier_ratio(spark.createDataFrame([(c,) for c in cities], "city string"), gazetteer(spark)).collect()}
    want = {c: m[0] for c in cities if (m := difflib.get_close_matches(c, keys, n=1, cutoff=0.75))}
    assert got == want and len(want) > 250


def test_contained_keys(spark):
    rng = random.Random(2)
    texts = sorted({"".join(rng.choices("abc", k=rng.randint(0, 12))) for _ in range(200)})
    keys = sorted({"".join(rng.choices("abc", k=rng.randint(0, 5))) for _ in range(60)})
    got = contained_keys(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(k, k) for k in keys], "part string, key string"))
    got = {(r.text, r.key) for r in got.collect()}
    assert got == {(t, k) for t in texts for k in keys if k and k in t}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choices("abcé ", k=rng.randint(0, n))), "".join(rng.choices("abcé ", k=rng.randint(0, n))))
             for n in (3, 10, 59, 80) for _ in range(25)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", common_subsequence(F.col("a"), F.col("b")).alias("n")).collect():
        assert r.n == lcs(r.a, r.b)
