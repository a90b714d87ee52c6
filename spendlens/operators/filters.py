"""Filters and predicates.

Every filter is a Column built from parameters (no SQL text is spliced), so
Catalyst pushes the comparisons into the parquet scan. Year filters are
written as a date range on ``date`` so they push down; a function of the
column (``year(date) = y``) would not.
"""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the "no filter" choice of the profile / bank / category selectors.
ALL = "All"


@dataclass(frozen=True)
class Slots:
    """Filter slots of one question (each optional) plus flags."""

    category: str | None = None
    bank: str | None = None
    profile: str | None = None
    year: int | None = None
    month: int | None = None
    merchant: str | None = None
    income: bool = False
    top3: bool = False
    # (first, last) year of the table, when known: month filters then also read as
    # date ranges, which reach the parquet scan.
    years: tuple[int, int] | None = None

    def any_slot(self) -> bool:
        return any(v is not None for v in (self.category, self.bank, self.profile, self.year, self.month, self.merchant))

    def with_(self, **kw) -> "Slots":
        return replace(self, **kw)


def flt_sign(income: bool) -> Column:
    """income: amount > 0; otherwise expense: amount < 0 (zero is neither)."""
    return F.col("amount") > 0 if income else F.col("amount") < 0


def flt_eq(column: str, value: str) -> Column:
    return F.col(column) == F.lit(value)


def flt_year(year: int) -> Column:
    y = int(year)
    return (F.col("date") >= F.lit(dt.date(y, 1, 1))) & (F.col("date") < F.lit(dt.date(y + 1, 1, 1)))


def _month_ranges(months: Iterable[int], years: tuple[int, int]) -> Column:
    """OR of [first day, first day of next month) for each month of each year in the span, and of all days outside
    the span: the span only helps the scan, and rows added beyond it are left to the exact month test."""
    conds = [F.col("date") < F.lit(dt.date(int(years[0]), 1, 1)), F.col("date") >= F.lit(dt.date(int(years[1]) + 1, 1, 1))]
    for y in range(int(years[0]), int(years[1]) + 1):
        for m in months:
            start = dt.date(y, int(m), 1)
            end = dt.date(y + (m == 12), 1 if m == 12 else int(m) + 1, 1)
            conds.append((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))
    return functools.reduce(lambda a, b: a | b, conds)


def flt_month(month: int, years: tuple[int, int] | None = None) -> Column:
    """Month of year, any year. With the table's year span the same rows are also
    described as date ranges, which Parquet can push down (the exact month test stays)."""
    exact = F.month("date") == F.lit(int(month))
    return exact if not years else exact & _month_ranges([int(month)], years)


def flt_months_in(months: Iterable[int], years: tuple[int, int] | None = None) -> Column:
    months = [int(m) for m in months]
    exact = F.month("date").isin(months)
    return exact if not years else exact & _month_ranges(months, years)


def flt_merchant_like(term: str) -> Column:
    """Case-insensitive substring match on merchant."""
    return F.lower(F.col("merchant")).contains(F.lit(term.lower()))


def month_bounds(as_of: dt.date, keyword: str = "last month") -> tuple[dt.date, dt.date]:
    """Half-open [first day, first day of next month) of last or this month."""
    first = as_of.replace(day=1)
    if keyword == "last month":
        first = (first - dt.timedelta(days=1)).replace(day=1)
    nxt = (first.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    return first, nxt


def flt_date_range(start: dt.date, end: dt.date) -> Column:
    return (F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end))


def flt_last_month(as_of: dt.date) -> Column:
    return flt_date_range(*month_bounds(as_of, "last month"))


def flt_this_month(as_of: dt.date) -> Column:
    return flt_date_range(*month_bounds(as_of, "this month"))


def flt_positive_expense() -> Column:
    """expense_amount > 0, written on the stored column (amount < 0, the same rows on cleaned
    data) so that it reaches the parquet scan instead of filtering a derived column."""
    return F.col("amount") < 0


def flt_compose(filters: Iterable[Column | None]) -> Column | None:
    """AND of the present filters; None when there is none (no WHERE)."""
    present = [f for f in filters if f is not None]
    return functools.reduce(lambda a, b: a & b, present) if present else None


def apply(df: DataFrame, cond: Column | None) -> DataFrame:
    return df if cond is None else df.where(cond)


def slot_filters(slots: Slots, sign: bool = True) -> list[Column]:
    """The WHERE list of the slot intents, in the reference's order."""
    out = [flt_sign(slots.income)] if sign else []
    if slots.category and slots.category != "Income":
        out.append(flt_eq("category", slots.category))
    if slots.bank:
        out.append(flt_eq("bank", slots.bank))
    if slots.profile:
        out.append(flt_eq("profile", slots.profile))
    if slots.year is not None:
        out.append(flt_year(slots.year))
    if slots.month is not None:
        out.append(flt_month(slots.month, slots.years))
    if slots.merchant:
        out.append(flt_merchant_like(slots.merchant))
    return out


def flt_scope_profile(selected_profile: str | None, already_filtered: bool = False) -> Column | None:
    """Selected profile unless 'All'/None or the query already filters on profile."""
    if not selected_profile or selected_profile == ALL or already_filtered:
        return None
    return flt_eq("profile", selected_profile)


def flt_sidebar(df: DataFrame, profile: str = ALL, bank: str = ALL, category: str = ALL) -> DataFrame:
    """Equality filters AND-ed; 'All' means no filter."""
    conds = [flt_eq(c, v) for c, v in (("profile", profile), ("bank", bank), ("category", category)) if v and v != ALL]
    return apply(df, flt_compose(conds))
