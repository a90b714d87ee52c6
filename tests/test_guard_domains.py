"""The value domains of the guards: rows are never sorted for them."""

from __future__ import annotations

from spendlens.operators import guards


def test_domains_of_values_are_hashed_before_they_are_compared(spark):
    rows = [("Family", "TD", "Coffee"), ("family", "td", None), ("FAMILY", None, "coffee"), ("family", "td", None)]
    got = guards.value_domains(spark.createDataFrame(rows, "profile string, bank string, category string"))
    assert sorted(map(tuple, got.collect())) == [("bank", "td", "td"), ("category", "coffee", "coffee"), ("profile", "family", "family")]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate(" in line]
    assert "HashAggregate(" in aggregates[-1], plan  # the first over the rows
