"""Every registered query of the library's own against its SQL, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tessera.plans.registry import cases

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def text(v):
        if not getattr(v, "ndim", 0) and not isinstance(v, (list, dict)) and pd.isna(v):
            return "NULL"
        if isinstance(v, float) and v == int(v) and abs(v) < 1e15:  # a column of integers with nulls
            return str(int(v))
        return f"{v:.6f}" if isinstance(v, float) else str(list(v) if getattr(v, "ndim", 0) else v)

    df = df[sorted(df.columns)]
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(cases()))
def test_query_as_sql(spark, con, name):
    query, sql = cases()[name]
    got = query(spark, SF).toPandas()
    if sql:
        want = con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)


def test_entry_lists_every_query(spark):
    import __spark_entry__ as entry

    assert set(cases()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
