"""Every query that SQL can express gives DuckDB's rows."""

import duckdb
import pytest

from meterflow.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(v) for v in r) for r in found)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, small, con):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    want = con.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + f" FROM ({SQL[name]})").fetchall()
    assert rows(df.select(*cols).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_give_rows(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0
