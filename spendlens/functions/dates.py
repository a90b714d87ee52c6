"""Date grouping keys.

Monthly and yearly groups are keyed on the truncated date (arithmetic per row)
and turned into their text labels after the aggregate, once per group, rather
than formatting every row's date as text before grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_start(c: str = "date") -> Column:
    return F.trunc(F.col(c), "MM")


def year_start(c: str = "date") -> Column:
    return F.trunc(F.col(c), "YYYY")


def label_month(df: DataFrame, key: str = "_m", name: str = "month") -> DataFrame:
    """Replace the month-start key by its 'YYYY-MM' label."""
    return df.withColumn(name, F.date_format(F.col(key), "yyyy-MM")).drop(key) if key != name else df


def label_year(df: DataFrame, key: str = "_y", name: str = "year") -> DataFrame:
    return df.withColumn(name, F.date_format(F.col(key), "yyyy")).drop(key)
