"""Named queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, views: str = SQL) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` is what follows the views in one WITH list, or None if SQL has no form."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = f"WITH {views}{sql}" if views else sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison between engines that add in another order."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rounded_items(items: Column, digits: int = 6) -> Column:
    """An array's doubles rounded as in SQL, where what is negative and rounds to zero is -0.0. Spark's round() drops that sign."""
    return F.transform(items, lambda v: F.round(F.abs(v), digits) * F.signum(v))
