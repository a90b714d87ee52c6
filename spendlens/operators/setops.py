"""Sorts, limits and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.schema import CATEGORY_TAXONOMY, PROFILES


# Order among equal keys is unspecified in the reference; the remaining columns are
# appended as tie-breakers so that the range partitioner can split a hot key (one
# date holding a large share of rows) across tasks instead of one partition.
_TIE = ["merchant", "description", "amount", "category", "profile", "bank", "currency"]


def sort_recent(df: DataFrame) -> DataFrame:
    """Whole table, newest first (range-partitioned distributed sort)."""
    return df.orderBy(F.desc("date"), *[c for c in _TIE if c in df.columns])


def sort_canonical(df: DataFrame) -> DataFrame:
    keys = ["profile", "bank", "date", "merchant"]
    return df.orderBy(*keys, *[c for c in _TIE if c in df.columns and c not in keys])


def topk(df: DataFrame, order: Sequence, k: int) -> DataFrame:
    """ORDER BY ... LIMIT k; planned as TakeOrderedAndProject (per-partition top-k, then merge)."""
    return df.orderBy(*order).limit(k)


def _values(spark: SparkSession, values: Sequence[str], name: str) -> DataFrame:
    # A small fixed list (the taxonomy / expected profiles): a literal table.
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def taxonomy_unexpected(df: DataFrame, taxonomy: Sequence[str] = CATEGORY_TAXONOMY) -> DataFrame:
    """Observed categories not in the taxonomy, sorted."""
    tax = _values(df.sparkSession, taxonomy, "category")
    observed = df.select("category").distinct()
    return observed.join(F.broadcast(tax), "category", "left_anti").orderBy("category")


def taxonomy_missing(df: DataFrame, taxonomy: Sequence[str] = CATEGORY_TAXONOMY) -> DataFrame:
    """Taxonomy categories never observed, sorted."""
    tax = _values(df.sparkSession, taxonomy, "category")
    observed = df.select("category").distinct()
    return tax.join(observed, "category", "left_anti").orderBy("category")


def profile_coverage(df: DataFrame, expected: Sequence[str] = PROFILES) -> DataFrame:
    """One row: are all expected profiles present, and how many are missing."""
    exp = _values(df.sparkSession, expected, "profile")
    missing = exp.join(df.select("profile").distinct(), "profile", "left_anti")
    return missing.agg(
        (F.count(F.lit(1)) == 0).alias("all_present"), F.count(F.lit(1)).alias("missing_profiles")
    )


def union_append(df: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Bag append of new rows (duplicates kept)."""
    return df.unionByName(new_rows)
