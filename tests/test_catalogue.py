"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pandas as pd
import pytest

from rastertables import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if not pd.api.types.is_bool_dtype(df[c]) and pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype(float).round(6) + 0.0
    return df.astype(object).where(df.notna(), None).sort_values(list(df.columns), key=lambda s: s.astype(str), ignore_index=True)


@pytest.mark.parametrize("name", list(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    ours = plain(catalogue.queries()[name](spark, DATA).toPandas())
    theirs = plain(duck.execute(catalogue.oracle_sql()[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    # As strict as a comparison of hashes of values with six digits.
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, atol=1e-9, rtol=0)
