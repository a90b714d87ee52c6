"""Exact money arithmetic.

Amounts are stored as DOUBLE (the reference's REAL). Sums run on decimals with
14 places, so they are exact and independent of summation order across
partitions; nothing is rounded before it is summed. Where a group holds an
amount of 1e16 or more (or NaN), or its exact sum leaves the type, the plain
sum of the doubles takes over. Averages are rounded half-up on the exact mean
(see ``half_up_mean``).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(32, 14)
LARGEST = 1e16


def col_of(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money_sum(c: str | Column) -> Column:
    """Aggregate: exact sum as a decimal; NULL for no value and where the type can't hold it."""
    v = col_of(c)
    return F.when(F.max(F.abs(v)) < F.lit(LARGEST), F.try_sum(v.try_cast(MONEY)))


def float_sum(c: str | Column) -> Column:
    return F.sum(col_of(c).cast("double"))


def exact_sum(c: str | Column) -> Column:
    """Aggregate: exact sum of a money column, as DOUBLE."""
    return F.coalesce(money_sum(c).cast("double"), float_sum(c))


def round_sum_2(c: str | Column) -> Column:
    """Aggregate: ROUND(SUM(c), 2) computed exactly, as DOUBLE."""
    return F.coalesce(F.round(money_sum(c), 2).cast("double"), F.round(float_sum(c), 2))


def total_spent() -> Column:
    """Aggregate: ROUND(SUM(ABS(amount)), 2)."""
    return round_sum_2(F.abs(F.col("amount")))


def half_up_mean(total: Column, floats: Column, n: Column) -> Column:
    """total / n rounded half-up to cents: (200 * total + n) div (2 * n), exact for n up to 1e12 rows.

    ``floats`` is the sum in doubles, for where ``total`` is NULL. NULL when there are no rows.
    """
    n = F.nullif(n, F.lit(0).cast("long"))
    cents = F.call_function("div", total.try_cast("decimal(30,8)") * F.lit(200) + n, n * F.lit(2))
    return F.coalesce((cents.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast("double"), F.round(floats / n, 2))


def avg_abs_2(c: str = "amount") -> Column:
    """Aggregate: ROUND(AVG(ABS(c)), 2), half-up on the exact mean."""
    return half_up_mean(money_sum(F.abs(c)), float_sum(F.abs(c)), count_rows())


def count_rows() -> Column:
    return F.count(F.lit(1))
