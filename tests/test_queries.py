"""Every registered query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canonical(df):
    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return "null"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert set(got.columns) == set(want.columns)
    if any(k.kind == "f" for k in got.dtypes) or any(k.kind == "f" for k in want.dtypes):
        for c in got.columns:
            if got[c].dtype.kind in "if" and want[c].dtype.kind in "if":
                got[c], want[c] = got[c].astype(float), want[c].astype(float)
    assert canonical(got) == canonical(want)


def test_without_sql(spark):
    for name in sorted(set(registry.queries()) - set(ORACLES)):
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "rank", "score", "product_name", "clause_type", "parent_md5"]
