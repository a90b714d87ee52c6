"""Group rescale.

Per (profile, year): scale expense amounts so that their sum of |amount|
equals a target; a zero sum counts as 1; amounts are rounded to cents and
kept negative. Group sums come from a grouped aggregate (partial aggregation
before the shuffle) joined back on the group key - not a window, which would
hold a whole group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import exact_sum, money_sum

#: Groups that a broadcast may have; with more, the factors are joined by a shuffle.
MOST_GROUPS = 200_000


def _units(c):
    """Money in exact 1e-4 units as an integer decimal."""
    return (c.cast("decimal(38,4)") * 10000).cast("decimal(38,0)")


def _whole(c, below: float):
    """True where ``c`` has at most four decimals and fits the integer arithmetic."""
    return (F.abs(c) < below) & (F.round(c, 4) == c)


def rescale_to_target(expenses: DataFrame, targets: DataFrame, keys=("profile", "year")) -> DataFrame:
    """expenses: rows with ``amount`` and the key columns; targets: keys + ``target``.

    new amount = -round_half_up(|amount| * target / current, 2), computed on exact
    integers: cents = (2 * a * T + 100 * C) div (200 * C) with a, T, C in 1e-4 units.
    Amounts with more decimals or out of range are scaled as doubles.
    """
    keys = list(keys)
    size = F.abs(F.col("amount"))
    # Groups without a target keep their amounts.
    sums = expenses.groupBy(*keys).agg(money_sum(size).alias("current"), exact_sum(size).alias("c_f"))
    joined = sums.join(targets, keys)
    target, zero = F.col("target"), F.col("c_f") == 0
    exact = F.coalesce(_whole(F.col("current"), 1e13) & _whole(target, 1e13), F.lit(False))
    factors = joined.select(
        *keys,
        F.when(exact, _units(target)).alias("t_u"),
        F.when(exact, _units(F.when(zero, F.lit(1)).otherwise(F.col("current")))).alias("c_u"),
        target.cast("double").alias("t_f"),
        F.when(zero, F.lit(1.0)).otherwise(F.col("c_f")).alias("c_f"),
    )
    if factors.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        factors = F.broadcast(factors)
    out = expenses.join(factors, keys, "left")
    a_u = F.when(_whole(size, 1e9), _units(size))
    cents = F.expr("(a_u * t_u * 2 + c_u * 100) div (c_u * 200)")
    scaled = F.coalesce(cents.cast("double") / F.lit(100.0), F.round(size * F.col("t_f") / F.col("c_f"), 2))
    return (
        out.withColumn("a_u", a_u)
        .withColumn("amount", F.when(F.col("t_f").isNull(), F.col("amount")).otherwise(-scaled))
        .drop("a_u", "t_u", "c_u", "t_f", "c_f")
    )
