"""Queries with SQL, held against it by DuckDB over the given tables and awkward rows."""

import duckdb
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vetframe.llm import queries

AWKWARD = [(i, t) for i, t in enumerate(["", None, "a", "a", "é ß 語 \U0001f600", "x\x00y", "long " * 20_000, " \t\n", "a "])]
FEW = [(9, "one"), (3, "one"), (5, "one")]


@pytest.fixture(params=["sf0.001", "sf0.01", "awkward", "few", "none"])
def folder(request, tmp_path):
    if request.param.startswith("sf"):
        return f"/root/testdata/{request.param}"
    rows = {"awkward": AWKWARD, "few": FEW, "none": []}[request.param]
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    pq.write_table(table, tmp_path / "documents.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (df[columns].astype(object).where(df[columns].notna(), None).sort_values("doc_id").reset_index(drop=True) for df in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)
