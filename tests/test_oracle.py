"""Every query with a SQL twin equals DuckDB on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from oracle_util import duck, rows

SF = "/root/testdata/sf0.001"
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    duck_types = {r[0]: r[1] for r in con.execute(f"describe ({ORACLE[name]})").fetchall()}
    assert {n: SPARK_TO_DUCK.get(t, t) for n, t in sdf.dtypes} == duck_types
    sp = sdf.toPandas()
    dk = con.execute(ORACLE[name]).df()
    c1, r1 = rows(sp)
    c2, r2 = rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_every_query_runs_rows_only(spark):
    """The queries without a SQL twin (models) run and return rows."""
    for name, fn in E.queries().items():
        if name in ORACLE:
            continue
        assert fn(spark, SF).count() > 0, name


def test_entry_schema(spark):
    df = E.entry(spark)
    assert df.columns == ["Persona", "customers", "avg_monetary", "monetary_q1", "monetary_q3"]
    assert df.count() > 0
