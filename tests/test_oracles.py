"""Every registered query of the engine against its DuckDB SQL, by rows, names and types."""

import duckdb
import pytest

from brightwell.queries import ALL, TABLES

SF = "/root/testdata/sf0.001"
KINDS = {"int": "INTEGER", "bigint": "BIGINT", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("key", ALL)
def test_query(spark, duck, key):
    frame = ALL[key](spark, SF)
    columns = sorted(frame.columns)
    kinds = {d[0]: d[1] for d in duck.execute("describe " + ALL[key].oracle).fetchall()}
    rows = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ALL[key].oracle})").fetchall()
    got = [tuple(r) for r in frame.select(*[f"`{c}`" for c in columns]).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))
    assert {c: KINDS[t] for c, t in frame.dtypes} == kinds


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 100
    assert set(ALL) <= set(__spark_entry__.queries()) and set(ALL) <= set(__spark_entry__.oracle_sql())
