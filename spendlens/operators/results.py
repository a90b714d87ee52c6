"""Result-level operators: checks and figures over a query result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import exact_sum


def _total_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(("total_", "sum"))]


def zero_like_row(totals: list[Column]) -> Column:
    """Whether all these totals of a row are 0, NULL or non-numeric."""
    return reduce(lambda a, b: a & b, [F.coalesce(t.cast("string").try_cast("double"), F.lit(0.0)) == 0 for t in totals])


def result_zero_like(result: DataFrame) -> DataFrame:
    """One row, ``zero_like``: True if the result is empty, or every total_* / sum*
    value is 0, NULL or non-numeric; False if there is no such column."""
    cols = _total_columns(result)
    if not cols:
        return result.agg((F.count(F.lit(1)) == 0).alias("zero_like"))
    return result.agg(F.coalesce(F.bool_and(zero_like_row([F.col(f"`{c}`") for c in cols])), F.lit(True)).alias("zero_like"))


def result_rollup(result: DataFrame, order_by: list[str], key: str) -> DataFrame:
    """row count, sum of total_spent (NULL as 0), first row's key and total.

    "First row" is the row that sorts first under ``order_by`` (each entry a
    column name, '-' prefix for descending), found with one aggregate pass.
    """
    first_key = F.struct(*[(-F.col(c[1:]) if c.startswith("-") else F.col(c)) for c in order_by])
    return result.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(exact_sum("total_spent"), F.lit(0.0)).alias("sum_total_spent"),
        F.min_by(F.col(key), first_key).alias("first_key"),
        F.min_by(F.col("total_spent"), first_key).alias("first_total_spent"),
    )


def result_top3(result: DataFrame) -> DataFrame:
    """First 3 rows of a ranked result."""
    return result.limit(3)
