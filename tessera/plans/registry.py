"""Named queries with the SQL that any engine can check them by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, folder) -> DataFrame`` under its name, with its SQL where there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded after the last arithmetic step, negative zero as zero, so that engines agree."""
    from pyspark.sql import functions as F

    return df.select(*[(F.round(F.col(f"`{c}`"), places) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
