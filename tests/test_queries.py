"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import duckdb
import pytest

from almucantar.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str(tuple(None if x != x or x is None else round(float(x), 6) if isinstance(x, float) else x for x in r)) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    expected = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    number = lambda x: float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    assert rows(got.map(number)) == rows(expected.map(number))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_areas_on_outlines(spark):
    """Places that lie on an area's outline, which the smallest tables do not have."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    sql = registry.oracle_sql()["areas_containing"]
    got = registry.queries()["areas_containing"](spark, sf).toPandas()
    assert rows(got) == rows(con.execute(sql).df())
