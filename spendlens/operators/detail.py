"""Drill-down tables behind an answer.

Filters differ from the intents on purpose: only the selected profile (not
the question's), no bank filter, and category / merchant are ignored for
income questions. Nothing is returned unless a category, a merchant or income
is asked about.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.dates import label_month, month_start
from spendlens.functions.money import count_rows, exact_sum, round_sum_2
from spendlens.operators.filters import (
    ALL,
    Slots,
    apply,
    flt_compose,
    flt_eq,
    flt_merchant_like,
    flt_month,
    flt_sign,
    flt_year,
)


@dataclass(frozen=True)
class DetailSpec:
    """What the drill-down needs from a question's tags."""

    slots: Slots
    income: bool  # the narrower income word list (income, receive, received)
    listing: bool  # "show" and "transaction"
    selected_profile: str = ALL

    def active(self) -> bool:
        return bool(self.slots.category or self.slots.merchant or self.income)

    def label(self) -> str:
        if self.income:
            return "Income"
        parts = []
        if self.slots.category and self.slots.category != "Income":
            parts.append(self.slots.category)
        if self.slots.merchant:
            parts.append(self.slots.merchant.title())
        return " / ".join(parts) if parts else "Expense"


def _where(df: DataFrame, spec: DetailSpec) -> DataFrame:
    s = spec.slots
    conds = [flt_sign(spec.income)]
    if spec.selected_profile and spec.selected_profile != ALL:
        conds.append(flt_eq("profile", spec.selected_profile))
    if s.category and s.category != "Income" and not spec.income:
        conds.append(flt_eq("category", s.category))
    if s.merchant and not spec.income:
        conds.append(flt_merchant_like(s.merchant))
    if s.year is not None:
        conds.append(flt_year(s.year))
    if s.month is not None:
        conds.append(flt_month(s.month, s.years))
    return apply(df, flt_compose(conds))


def detail_rows(df: DataFrame, spec: DetailSpec) -> DataFrame:
    """date, merchant, category, amount, bank, profile; newest first; no limit."""
    cols = ["date", "merchant", "category", "amount", "bank", "profile"]
    out = _where(df, spec).select(*cols).orderBy(F.desc("date"), "merchant", "category", "amount", "bank", "profile")
    return out if spec.active() else out.limit(0)


def detail_monthly(df: DataFrame, spec: DetailSpec) -> DataFrame:
    """month, total_income | total_amount | total_spent, transaction_count."""
    if spec.income:
        value = round_sum_2("amount").alias("total_income")
    elif spec.listing:
        value = round_sum_2(F.abs("amount")).alias("total_amount")
    else:
        value = round_sum_2(F.abs("amount")).alias("total_spent")
    grouped = _where(df, spec).groupBy(month_start().alias("_m")).agg(value, count_rows().alias("transaction_count"))
    out = label_month(grouped).select("month", *[c for c in grouped.columns if c != "_m"]).orderBy("month")
    return out if spec.active() else out.limit(0)


def detail_totals(df: DataFrame, spec: DetailSpec) -> DataFrame:
    """Sum of |amount| and count of the drill-down rows, with the label."""
    rows = _where(df, spec)
    out = rows.agg(
        F.coalesce(exact_sum(F.abs("amount")), F.lit(0.0)).alias("total"),
        count_rows().alias("transaction_count"),
    ).withColumn("label", F.lit(spec.label()))
    return out if spec.active() else out.limit(0)
