"""Bad records set apart, the store of resolved locations, mergeable profiles."""

import pytest
from pyspark.sql import functions as F

from clientele.operators import location_store, profile_store
from clientele.operators.geo import resolve_locations
from clientele.operators.profile import groupable_columns
from clientele.sources.dimensions import gazetteer
from clientele.sources.quarantine import load_checked


def files(tmp_path, name, parts):
    folder = tmp_path / name
    folder.mkdir()
    for i, text in enumerate(parts):
        (folder / f"part-{i}").write_text(text, encoding="utf-8")
    return f"file://{folder}"


def test_csv_lines_are_good_or_quarantined(spark, tmp_path):
    parts = ["id,name,amount\n1,a,2.5\n2,b,x\n\n3,\"c, d\",4\n4,only two\n5,a,b,1\n", "id,name,amount\n6,é,\nseven,g,1\n   \n8,,8.25\n"]
    good, bad = load_checked(spark, files(tmp_path, "c", parts), "id int, name string, amount double")
    assert sorted(map(tuple, good.collect())) == [(1, "a", 2.5), (3, "c, d", 4.0), (6, "é", None), (8, None, 8.25)]
    lines = {r.line: (r.place, r.file[-6:]) for r in bad.collect()}
    assert lines == {"2,b,x": (2, "part-0"), "4,only two": (5, "part-0"), "5,a,b,1": (6, "part-0"), "seven,g,1": (2, "part-1")}
    assert good.count() + bad.count() == sum(bool(x.strip()) for p in parts for x in p.splitlines()) - len(parts)


def test_json_lines_and_required_fields(spark, tmp_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("tags", T.ArrayType(T.StringType()))])
    text = '{"id": 1, "tags": ["a"]}\n{"id": 2}\n{"tags": []}\n{"id": "x"}\nnot json\n{"id": 3, "tags": ["b"]\n'
    good, bad = load_checked(spark, files(tmp_path, "j", [text]), schema, fmt="json")
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert {(r.line, r.reason) for r in bad.collect()} == {('{"tags": []}', "a required field is missing"), ('{"id": "x"}', "does not fit the schema"),
                                                          ("not json", "does not fit the schema"), ('{"id": 3, "tags": ["b"]', "does not fit the schema")}
    none_good, none_bad = load_checked(spark, files(tmp_path, "e", [""]), schema, fmt="json")
    assert none_good.count() == none_bad.count() == 0
    with pytest.raises(ValueError):
        load_checked(spark, "x", schema, fmt="parquet")


def test_a_second_run_resolves_new_places_only(spark, tmp_path, monkeypatch):
    store, gaz = f"file://{tmp_path}/places", gazetteer(spark)
    seen = []
    monkeypatch.setattr(location_store, "resolve_locations", lambda c, *a, **k: (seen.append({r.city for r in c.collect()}), resolve_locations(c, *a, **k))[1])
    first = ["paris", "greater dublin area", "mnchester", "xyzzy", ""]
    later = [*first, "lndon", "nowhere at all"]
    rows = lambda cs: spark.createDataFrame([(c,) for c in [*cs, None]], "city string")
    same = lambda cs, got: sorted(map(tuple, got.select("city", "key", "match_tier", "lat", "lon", "iso3").collect())) == sorted(
        map(tuple, resolve_locations(rows(cs).where("city <> ''"), gaz).select("city", "key", "match_tier", "lat", "lon", "iso3").collect()))
    assert same(first, location_store.resolve_with_store(rows(first), gaz, store))
    assert same(later, location_store.resolve_with_store(rows(later), gaz, store))
    assert same(first, location_store.resolve_with_store(rows(first), gaz, store))
    assert seen == [set(first) - {""}, {"lndon", "nowhere at all"}]
    mark = location_store.fingerprint(gaz)
    assert location_store.latest(spark, store, mark)[0] == 2 and len(location_store.latest(spark, store, mark)[1]) == 2
    fewer = gaz.where("key <> 'paris'")
    assert "paris" not in {r.city for r in location_store.resolve_with_store(rows(first), fewer, store).collect()}
    assert seen[2] == set(first) - {""} and location_store.latest(spark, store, mark)[1] != location_store.latest(spark, store, location_store.fingerprint(fewer))[1]


def test_an_unpublished_part_is_not_seen(spark, tmp_path, monkeypatch):
    """A run that dies before its version is written leaves the store as it was."""
    store, gaz = f"file://{tmp_path}/places", gazetteer(spark)
    cities = spark.createDataFrame([("paris",)], "city string")
    location_store.resolve_with_store(cities, gaz, store)
    before = location_store.latest(spark, store, location_store.fingerprint(gaz))
    spark.createDataFrame([("rome", None, None, None, None, None)], location_store.PART).write.parquet(f"{store}/parts/dead")
    assert location_store.latest(spark, store, location_store.fingerprint(gaz)) == before
    assert [r.city for r in location_store.resolve_with_store(spark.createDataFrame([("rome",)], "city string"), gaz, store).collect()] == ["rome"]


def test_merged_profile_is_the_one_pass_profile(spark):
    rows = [(i % 7, f"t{i % 60}", None if i % 5 else float(i), "x") for i in range(3000)] + [(None, None, float("nan"), "x")]
    df = spark.createDataFrame(rows, "a int, b string, c double, d string").repartition(6)
    parts = None
    for k in range(4):
        p = profile_store.profile(df.where(F.coalesce(F.col("a") % 4, F.lit(0)) == k))
        parts = p if parts is None else parts.unionByName(p)
    show = lambda p: sorted(map(tuple, p.select("column_name", "kind", "row_count", "nulls", "least", "most", "least_text", "most_text",
                                                F.hll_sketch_estimate("sketch").alias("d")).collect()))
    whole, merged = show(profile_store.profile(df)), show(profile_store.merge(parts))
    assert [r[:8] for r in merged] == [r[:8] for r in whole]  # all but the sketches' estimates, which err by some 2 % each
    assert [r[8] for r in merged] == pytest.approx([r[8] for r in whole], rel=0.04)
    by = {r[0]: r for r in whole}
    assert by["a"][2:6] == (3001, 1, 0.0, 6.0) and by["b"][6:8] == ("t0", "t9") and by["c"][3] == 2401
    got = {r.column_name: (r.distinct_values, r.exact) for r in profile_store.groupable(profile_store.merge(parts), df, 60).collect()}
    assert got == {"a": (7, False), "d": (1, False)}  # b has 60 and was counted
    assert {r.column_name: r.distinct_values for r in groupable_columns(df, "t", limit=60).collect()} == {"a": 7, "d": 1}
    assert profile_store.groupable(profile_store.merge(parts), df, 61).where("column_name = 'b'").first().exact
