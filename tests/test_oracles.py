"""Every query that has SQL against DuckDB on the same small tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return c


def table(df: pd.DataFrame):
    def text(v):
        if v is None or v is pd.NA or v != v:
            return "null"
        return f"{float(v):.5f}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(text, r)) for r in df[columns].astype(object).itertuples(index=False))


def same(a, b) -> bool:
    """Equal texts, numbers up to the last printed digit (the engines round exact halves apart)."""
    try:
        return all(x == y or abs(float(x) - float(y)) < 2.1e-5 for x, y in zip(a, b, strict=True))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(name, spark, small, duck):
    columns, got = table(entry.queries()[name](spark, small).toPandas())
    wanted, want = table(duck.sql(entry.oracle_sql()[name]).df())
    assert columns == wanted and len(got) == len(want)
    assert all(same(a, b) for a, b in zip(got, want))


def test_entry(spark):
    assert entry.entry(spark).count() == 101
    assert set(entry.oracle_sql()) <= set(entry.queries())
