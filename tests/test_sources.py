"""Sources and sinks (SRC-1..3, SNK-1)."""

import json

import pytest

from clientele.sources.io import TABLES, load_table, save_table, standardise_columns


def test_formats(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text("id,Total Spend\n1,2.5\n2,3\n")
    df = load_table(spark, str(csv))
    assert df.count() == 2 and dict(df.dtypes)["Total Spend"] == "double"
    js = tmp_path / "b.json"
    js.write_text(json.dumps([{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]))
    assert load_table(spark, str(js)).count() == 2
    out = save_table(df, str(tmp_path / "out.parquet"))
    assert load_table(spark, out, fmt="parquet").count() == 2
    m = load_table(spark, str(csv), mapping={"Spend": "Total Spend"})
    assert "Spend" in m.columns


def test_unknown_extension_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        load_table(spark, str(tmp_path / "x.xlsx"))


def test_standardise_ignores_absent(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert standardise_columns(df, {"A": "a", "Z": "zz"}).columns == ["A", "b"]


def test_all_driver_tables_load(spark, sf_small):
    for t in TABLES:
        assert load_table(spark, f"{sf_small}/{t}.parquet").count() >= 0
