"""Every query with SQL against it, on the smallest tables."""

import duckdb
import pytest

from tarnwork.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    """Rows as (what must be equal, numbers that are compared to six places)."""
    exact = lambda r: tuple(repr(v) for v in r if not isinstance(v, float))
    return sorted((exact(r), tuple(v for v in r if isinstance(v, float))) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*cols).collect()]
    if name not in registry.ORACLES:
        assert rows
        return
    c = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    at = [names.index(x) for x in cols]
    want = ordered(tuple(r[i] for i in at) for r in c.fetchall())
    got = ordered(rows)
    assert [x[0] for x in got] == [x[0] for x in want]
    for (_, x), (_, y) in zip(got, want):
        assert x == pytest.approx(y, abs=2e-6)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
