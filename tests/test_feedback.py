"""Feedback on samples (M14, M15) whose rows repeat, lack values or tie."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.operators import statistics as st


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """A lineitem of repeated and null keys, equal rows and null values."""
    rng = np.random.default_rng(5)
    rows = [(None if k % 50 == 0 else int(rng.integers(0, 120)), int(rng.integers(1, 4)), *(None if rng.random() < 0.4 else float(x) for x in (rng.integers(1, 51), rng.integers(1, 9999) / 100, rng.integers(0, 11) / 100, rng.integers(0, 9) / 100))) for k in range(600)]
    folder = str(tmp_path_factory.mktemp("odd"))
    d = spark.createDataFrame(rows + rows[:40], "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    d.coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def equals_sql(spark, folder, name):
    got = entry.queries()[name](spark, folder)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    got = sorted(map(tuple, got.collect()), key=key)
    return len(got) == len(want) and all(a == b for a, b in zip(got, sorted(want, key=key), strict=True))


def test_limiting_factors_of_odd_rows_equal_sql(spark, odd):
    assert equals_sql(spark, odd, "m14_limiting_factors")


def before_shuffle(df) -> str:
    """The plan's text below the shuffle by row."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("hashpartitioning(row_idx") :]


def test_limiting_factors_shuffle_a_row_once(spark, small):
    below = before_shuffle(entry.queries()["m14_limiting_factors"](spark, small))
    assert not any(step in below for step in ("Expand", "MapInArrow", "Window", "Generate"))


def test_limiting_factors_order_ties_by_name_and_value(spark):
    """Of importance 0 all urgencies tie, so values decide; ``d`` has no percentiles, ``e`` no importance."""
    table = spark.createDataFrame([(f, [float(k) for k in range(101)]) for f in "abce"], "feature string, pct array<double>")
    importance = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.5), ("d", 0.9)], "feature string, importance double")
    rows = [(1, 7.0, 1.0, 100.0, 0.0, 0.0), (1, 3.0, 2.0, None, 0.0, 0.0), (2, None, None, None, 1.0, 1.0), (3, -1.0, 5.0, 40.0, 0.0, 0.0)]
    sample = spark.createDataFrame(rows, "row_idx int, a double, b double, c double, d double, e double")
    got = [tuple(r) for r in st.limiting_factors(sample, list("abcde"), table, importance, 3).orderBy("row_idx", "place").collect()]
    assert got == [
        (1, 1, "a", 3.0, 4, 0.0, 0.0), (1, 2, "a", 7.0, 8, 0.0, 0.0), (1, 3, "b", 1.0, 2, 0.0, 0.0),
        (3, 1, "c", 40.0, 41, 0.5, 0.295), (3, 2, "a", -1.0, 0, 0.0, 0.0), (3, 3, "b", 5.0, 6, 0.0, 0.0),
    ]
    assert st.limiting_factors(sample.where("false"), list("abcde"), table.where("false"), importance, 3).count() == 0


def test_category_scores_of_odd_rows_equal_sql(spark, odd):
    assert equals_sql(spark, odd, "m15_category_scores")


def test_category_scores_shuffle_sums_of_whole_rows(spark, small):
    below = before_shuffle(entry.queries()["m15_category_scores"](spark, small))
    assert not any(step in below for step in ("Expand", "MapInArrow", "Generate"))


def test_category_scores_round_halves_to_even(spark):
    table = spark.createDataFrame([(f, [float(k) for k in range(101)]) for f in "ab"], "feature string, pct array<double>")
    categories = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "feature string, category string")
    sample = spark.createDataFrame([(1, 0.0, 1.0, 9.0), (2, 1.0, 2.0, 9.0), (3, None, 500.0, 9.0), (3, 0.0, None, 9.0), (4, None, None, 9.0)], "row_idx int, a double, b double, c double")
    got = {r.row_idx: r.score for r in st.category_scores(sample, list("abc"), table, categories).where(F.col("category") == "x").collect()}
    assert got == {1: 2, 2: 2, 3: 50}
    assert st.category_scores(sample, list("abc"), table, categories).count() == 3
