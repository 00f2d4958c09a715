"""Every registered query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from changefold import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def by_sql(sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con.execute(sql).df()


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def test_all_have_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    ours, theirs = tidy(queries.QUERIES[name](spark, SF).toPandas()), tidy(by_sql(queries.ORACLE[name]))
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
