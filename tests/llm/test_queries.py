"""The registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

from tidemark.llm import oracle, queries

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.queries()[name](spark, SF), con.sql(oracle.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_names():
    assert [n.split("_")[0] for n in sorted(queries.queries(), key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
