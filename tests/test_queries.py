"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from strataq.plans import registry, trees  # noqa: F401  (trees adds its queries to the registry)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def clean(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if hasattr(value, "item"):
        value = value.item()
    return int(value) if isinstance(value, float) and value.is_integer() else value


def rows(frame, columns):
    return sorted(repr([clean(v) for v in r]) for r in frame[columns].astype(object).values.tolist())


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_matches_sql(spark, sql, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = sql.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry_has_a_row(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
