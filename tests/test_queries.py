"""Every query of the engine with an oracle gives the oracle's rows."""

import duckdb
import pytest

from mnemospark.plans import compiling, etl, search, stores, streams  # noqa: F401  (they register their queries)
from mnemospark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df.reindex(sorted(df.columns), axis=1)
    cell = lambda c, x: f"{x:.6f}" if isinstance(x, float) else str(x)[:10] if c == "day" else str(x)
    return sorted(tuple(cell(c, x) for c, x in zip(df.columns, row, strict=True)) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
