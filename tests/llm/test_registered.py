"""Registered llm queries against their DuckDB SQL over a whole table set."""

import duckdb
import pytest

from threadlens.llm import queries as Q
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_names():
    got = Q.queries()
    assert {int(k[2:].split("_")[0]) for k in got} == set(range(1, 14)) and set(Q.oracle_sql()) <= set(got)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = Q.queries()[name](spark, SF)
    res = con.execute(Q.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(cols)
    assert rows_of(sdf.columns, sdf.collect()) == rows_of(cols, res.fetchall())
