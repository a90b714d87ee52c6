"""``describe_all``: per-column statistics of the table.

Numeric columns: count, mean, std (sample), min, 25 % / 50 % / 75 % (exact,
linear interpolation), max. Text columns: count, unique, top, freq (ties in
``top`` go to the smallest value).

Exact quantiles without holding a column in one place: the column is reduced
to (value, count) pairs, which a range sort puts in order over many tasks.
The counts of the ranges (one row each) tell in which range a rank lies and how
many rows come before it; inside those few ranges a running count picks the
values. Nothing but the statistics comes to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendlens.functions.sizes import small
from spendlens.sources.table import dropped, written

QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("unique", T.LongType()),
        T.StructField("top", T.StringType()),
        T.StructField("freq", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("std", T.DoubleType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("q25", T.DoubleType()),
        T.StructField("q50", T.DoubleType()),
        T.StructField("q75", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
    ]
)


def sorted_counts(df: DataFrame, col: str, ranges: int | None = None) -> DataFrame:
    """(v, c, part): the different values with their counts, stored in sorted order; ``part`` numbers the ranges."""
    pairs = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    pairs = pairs.repartitionByRange(ranges, "v") if ranges else pairs.repartitionByRange("v")
    return written(pairs.select("v", "c", F.spark_partition_id().alias("part")), "values")


def exact_quantiles(pairs: DataFrame, probs: list[float]) -> DataFrame:
    """(p, value) over the multiset of ``sorted_counts``: none for an empty one."""
    sums = pairs.groupBy("part").agg(F.sum("c").alias("s"))
    order = Window.orderBy("part")  # one row per range
    sums = sums.select("part", "s", (F.sum("s").over(order) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy()).alias("n"))

    def rank(p: float, side: str) -> Column:
        h = (F.col("n") - 1) * F.lit(float(p))
        at = F.floor(h) if side == "lo" else F.ceil(h)
        return F.struct(F.lit(float(p)).alias("p"), F.lit(side).alias("side"), at.cast("long").alias("rank"), (h - F.floor(h)).alias("rest"))

    ranks = F.array(*[rank(p, side) for p in probs for side in ("lo", "hi")])
    here = F.filter(ranks, lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("s")))
    wanted = sums.select("part", "before", F.explode(here).alias("r")).select("part", "before", "r.*")  # two rows per probability
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    run = pairs.join(small(wanted.select("part").distinct()), "part", "left_semi").withColumn("upto", F.sum("c").over(inside))
    place = F.col("rank") - F.col("before")
    found = run.join(small(wanted), "part").where((place < F.col("upto")) & (place >= F.col("upto") - F.col("c")))
    low, high = (F.max(F.when(F.col("side") == side, F.col("v"))) for side in ("lo", "hi"))
    return found.groupBy("p", "rest").agg(low.alias("low"), high.alias("high")).select("p", (F.col("low") + F.col("rest") * (F.col("high") - F.col("low"))).alias("value"))


def _row(df: DataFrame, column: Column, given: dict[str, Column]) -> DataFrame:
    columns = [given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMA.fields if f.name != "column"]
    return df.select(column.alias("column"), *columns)


def _numeric(df: DataFrame, c: str) -> DataFrame:
    stats = df.agg(F.count(c).alias("count"), *[F.round(f(F.col(c).cast("double")), 6).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))])
    rows = _row(stats, F.lit(c), {k: F.col(k) for k in ("count", "mean", "std", "min", "max")})
    pairs = sorted_counts(df, c)
    quartiles = exact_quantiles(pairs, list(QUARTILES.values()))
    quartiles = quartiles.agg(*[F.max(F.when(F.col("p") == p, F.round("value", 6))).alias(q) for q, p in QUARTILES.items()])
    rows = rows.unionByName(_row(quartiles, F.lit(c), {q: F.col(q) for q in QUARTILES}))
    one = written(rows.groupBy("column").agg(*[F.max(f.name).alias(f.name) for f in SCHEMA.fields if f.name != "column"]), "described")
    dropped(pairs)
    return one


def _text(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """All text columns in one pass: (column, value) pairs, counted per pair (partial aggregation before the shuffle),
    then one summary row per column. The top value is the most frequent, ties to the smallest."""
    pairs = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("p")
    ).select("p.*")
    counts = pairs.groupBy("column", "value").agg(F.count("value").alias("k"))
    there = F.col("value").isNotNull()
    summary = counts.groupBy("column").agg(
        F.sum("k").alias("count"), F.count_if(there).alias("unique"), F.max(F.when(there, F.col("k"))).alias("freq"),
        F.min_by("value", F.when(there, F.struct((-F.col("k")).alias("less"), F.col("value")))).alias("top"),
    )
    return _row(summary, F.col("column"), {k: F.col(k) for k in ("count", "unique", "top", "freq")})


def describe_all(df: DataFrame, numeric=("amount",), text=("merchant", "description", "category", "profile", "bank", "currency")) -> DataFrame:
    parts = [_numeric(df, c) for c in numeric] + ([_text(df, tuple(text))] if text else [])
    return reduce(DataFrame.unionByName, parts).select(*SCHEMA.names)
