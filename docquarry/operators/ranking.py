"""What all rankings share: sums that do not depend on order, first rows of each query, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.functions import text as X

DIGITS = 1e12
TERM_BYTES = 40


def exact_sum(x) -> Column:
    """A sum that does not depend on the order of rows: whole numbers of 1e-12 (up to nine million in all)."""
    return F.sum(F.floor(X.col(x) * DIGITS + 0.5)) / F.lit(DIGITS)


def strict_or_loose(rows: DataFrame) -> DataFrame:
    """Of each query's complete and other rows the complete ones, the others where there are none.

    rows: few for each query (counts by mode, first rows by mode), never all matches.
    """
    some = F.max("complete").over(Window.partitionBy("query_id"))
    return rows.withColumn("some", some).filter("complete OR NOT some").drop("some")


def top_k(rows: DataFrame, k: int | Column, order: list[Column], by: str | list[str] = "query_id", rank: str = "rank") -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)
