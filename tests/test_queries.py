"""Every registered query of the library against its SQL twin."""

import duckdb
import pytest

from tallygrove import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6) + 0.0
        df[c] = df[c].astype(str)
    return list(df.columns), sorted(map(tuple, df.values.tolist()))


@pytest.mark.parametrize("name", plans.QUERIES)
def test_same_as_sql(spark, con, name):
    assert rows(plans.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(plans.ORACLE_SQL[name]).df())


def test_entry_imports_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
