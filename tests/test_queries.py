"""Every registered query of the audit engine against its SQL, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from vetframe import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        floats = pd.api.types.is_float_dtype(df[c])
        df[c] = ["-" if v is None or v is pd.NA or v != v else f"{v:.9g}" if floats else str(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, duck, name):
    mine = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.SQL:
        assert len(mine)
        return
    pd.testing.assert_frame_equal(canonical(mine), canonical(duck.sql(queries.SQL[name]).df()), check_dtype=False)
