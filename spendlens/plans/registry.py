"""All registered queries, gathered from the catalogue modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spendlens.operators import intents
from spendlens.operators.filters import Slots


def all_entries():
    from spendlens.plans import catalog  # noqa: F401  (registers the core keys)
    from spendlens.plans import catalog_text  # noqa: F401  (tagging, sqllog, guards, batch answers)
    from spendlens.plans import catalog_ml  # noqa: F401  (relational ML parts, model pipeline, rescale)

    return dict(catalog.REGISTRY)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spendlens.plans.catalog import txn

    return intents.top_merchants(txn(spark, sf_dir), Slots())
