"""The 19 question intents as DataFrame functions.

Each takes the transaction table, the question's ``Slots`` and the selected
profile, and returns the result the rule-based SQL would return. "slots"
intents filter on every mentioned slot; "fixed" intents keep only
``amount < 0`` (plus their own predicate) and ignore mentioned slots. The
selected profile is added unless the query already filters on profile.

Plans: filter (pushed to the scan) -> partial aggregate -> shuffle on the
group key -> final aggregate -> TakeOrderedAndProject for the LIMIT
intents. Ties at a LIMIT are broken by the group keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.dates import label_month, label_year, month_start, year_start
from spendlens.functions.money import avg_abs_2, count_rows, round_sum_2, total_spent
from spendlens.operators.filters import (
    Slots,
    apply,
    flt_compose,
    flt_eq,
    flt_last_month,
    flt_months_in,
    flt_scope_profile,
    flt_sign,
    slot_filters,
)


def _slots_where(df: DataFrame, slots: Slots, selected_profile: str | None, sign: bool = True) -> DataFrame:
    conds = slot_filters(slots, sign=sign)
    conds.append(flt_scope_profile(selected_profile, already_filtered=bool(slots.profile)))
    return apply(df, flt_compose(conds))


def _fixed_where(df: DataFrame, selected_profile: str | None, *extra) -> DataFrame:
    conds = [flt_sign(False), *extra, flt_scope_profile(selected_profile)]
    return apply(df, flt_compose(conds))


def recurring(df, slots=Slots(), selected_profile=None, as_of=None, min_count: int = 6, limit: int = 20):
    """#1 merchants with >= 6 expense rows: average amount and count."""
    return (
        _fixed_where(df, selected_profile)
        .groupBy("merchant", "category")
        .agg(avg_abs_2("amount").alias("average_amount"), count_rows().alias("transaction_count"))
        .where(F.col("transaction_count") >= min_count)
        .orderBy(F.desc("transaction_count"), F.desc("average_amount"), "merchant", "category")
        .limit(limit)
    )


def frequent_subscriptions(df, slots=Slots(), selected_profile=None, as_of=None):
    """#2 most frequent merchants under the slot filters; 3 rows for 'top 3'."""
    return (
        _slots_where(df, slots, selected_profile)
        .groupBy("merchant", "category")
        .agg(count_rows().alias("transaction_count"), total_spent().alias("total_spent"))
        .orderBy(F.desc("transaction_count"), F.desc("total_spent"), "merchant", "category")
        .limit(3 if slots.top3 else 1)
    )


def merchant_transactions(df, slots=Slots(), selected_profile=None, as_of=None, limit: int = 50):
    """#3 latest 50 rows matching the slots (a merchant is mentioned)."""
    cols = ["date", "merchant", "description", "amount", "category", "profile", "bank"]
    return (
        _slots_where(df, slots, selected_profile)
        .select(*cols)
        .orderBy(F.desc("date"), *cols[1:])
        .limit(limit)
    )


def compare_jan_feb(df, slots=Slots(), selected_profile=None, as_of=None):
    """#4 January and February spending per month and category."""
    grouped = (
        _fixed_where(df, selected_profile, flt_months_in([1, 2], slots.years))
        .groupBy(month_start().alias("_m"), "category")
        .agg(total_spent().alias("total_spent"))
    )
    return label_month(grouped).select("month", "category", "total_spent").orderBy("month", F.desc("total_spent"), "category")


def largest_category(df, slots=Slots(), selected_profile=None, as_of=None):
    """#5 the category with the largest spending."""
    return (
        _fixed_where(df, selected_profile)
        .groupBy("category")
        .agg(total_spent().alias("total_spent"))
        .orderBy(F.desc("total_spent"), "category")
        .limit(1)
    )


def _by_key(df, key, selected_profile, limit=None):
    out = (
        _fixed_where(df, selected_profile)
        .groupBy(key)
        .agg(total_spent().alias("total_spent"), count_rows().alias("transaction_count"))
        .orderBy(F.desc("total_spent"), key)
    )
    return out.limit(limit) if limit else out


def top_profile(df, slots=Slots(), selected_profile=None, as_of=None):
    """#6 the profile that spent the most."""
    return _by_key(df, "profile", selected_profile, 1)


def compare_profiles(df, slots=Slots(), selected_profile=None, as_of=None):
    """#7 spending of every profile."""
    return _by_key(df, "profile", selected_profile)


def top_merchants(df, slots=Slots(), selected_profile=None, as_of=None, limit: int = 10):
    """#8 top 10 merchants by spending under the slot filters."""
    return (
        _slots_where(df, slots, selected_profile)
        .groupBy("merchant", "category")
        .agg(total_spent().alias("total_spent"), count_rows().alias("transaction_count"))
        .orderBy(F.desc("total_spent"), "merchant", "category")
        .limit(limit)
    )


def top_categories(df, slots=Slots(), selected_profile=None, as_of=None, limit: int = 10):
    """#9 top 10 categories by spending under the slot filters."""
    return (
        _slots_where(df, slots, selected_profile)
        .groupBy("category")
        .agg(total_spent().alias("total_spent"), count_rows().alias("transaction_count"))
        .orderBy(F.desc("total_spent"), "category")
        .limit(limit)
    )


def average_amount(df, slots=Slots(), selected_profile=None, as_of=None):
    """#10 average |amount| (half-up to cents) and count."""
    return _slots_where(df, slots, selected_profile).agg(
        avg_abs_2("amount").alias("average_transaction_amount"), count_rows().alias("transaction_count")
    )


def count_transactions(df, slots=Slots(), selected_profile=None, as_of=None):
    """#11 row count under the slots without the sign filter (selected profile applied, SURVEY Q1)."""
    return _slots_where(df, slots, selected_profile, sign=False).agg(count_rows().alias("transaction_count"))


def income_total(df, slots=Slots(), selected_profile=None, as_of=None):
    """#12 income total and count (slots with amount > 0)."""
    return _slots_where(df, slots.with_(income=True), selected_profile).agg(
        round_sum_2("amount").alias("total_income"), count_rows().alias("income_transactions")
    )


def by_bank(df, slots=Slots(), selected_profile=None, as_of=None):
    """#13 spending per bank."""
    return _by_key(df, "bank", selected_profile)


def by_profile(df, slots=Slots(), selected_profile=None, as_of=None):
    """#14 spending per profile."""
    return _by_key(df, "profile", selected_profile)


def by_month(df, slots=Slots(), selected_profile=None, as_of=None):
    """#15 spending per 'YYYY-MM' month under the slot filters."""
    grouped = (
        _slots_where(df, slots, selected_profile)
        .groupBy(month_start().alias("_m"))
        .agg(total_spent().alias("total_spent"), count_rows().alias("transaction_count"))
    )
    return label_month(grouped).select("month", "total_spent", "transaction_count").orderBy("month")


def by_year(df, slots=Slots(), selected_profile=None, as_of=None):
    """#16 spending per year (as text 'YYYY') under the slot filters."""
    grouped = (
        _slots_where(df, slots, selected_profile)
        .groupBy(year_start().alias("_y"))
        .agg(total_spent().alias("total_spent"), count_rows().alias("transaction_count"))
    )
    return label_year(grouped).select("year", "total_spent", "transaction_count").orderBy("year")


def category_last_month(df, slots=Slots(), selected_profile=None, as_of: dt.date | None = None):
    """#17 spending in a category during the month before ``as_of``."""
    as_of = as_of or dt.date.today()
    return _fixed_where(df, selected_profile, flt_eq("category", slots.category), flt_last_month(as_of)).agg(
        total_spent().alias("total_spent"), count_rows().alias("transaction_count")
    )


def slot_total(df, slots=Slots(), selected_profile=None, as_of=None):
    """#18 spending total and count under the slot filters."""
    return _slots_where(df, slots, selected_profile).agg(
        total_spent().alias("total_spent"), count_rows().alias("transaction_count")
    )


def default_top_categories(df, slots=Slots(), selected_profile=None, as_of=None):
    """#19 top 10 expense categories, slots ignored."""
    return top_categories(df, Slots(), selected_profile)


# Intent number -> (name, function); the order is the routing precedence.
INTENTS: dict[int, tuple[str, Callable[..., DataFrame]]] = {
    1: ("recurring", recurring),
    2: ("frequent_subscriptions", frequent_subscriptions),
    3: ("merchant_transactions", merchant_transactions),
    4: ("compare_jan_feb", compare_jan_feb),
    5: ("largest_category", largest_category),
    6: ("top_profile", top_profile),
    7: ("compare_profiles", compare_profiles),
    8: ("top_merchants", top_merchants),
    9: ("top_categories", top_categories),
    10: ("average_amount", average_amount),
    11: ("count_transactions", count_transactions),
    12: ("income_total", income_total),
    13: ("by_bank", by_bank),
    14: ("by_profile", by_profile),
    15: ("by_month", by_month),
    16: ("by_year", by_year),
    17: ("category_last_month", category_last_month),
    18: ("slot_total", slot_total),
    19: ("default_top_categories", default_top_categories),
}
INTENT_NAMES = {name: num for num, (name, _) in INTENTS.items()}


def run_intent(df: DataFrame, intent: int | str, slots: Slots = Slots(), selected_profile: str | None = None,
               as_of: dt.date | None = None) -> DataFrame:
    num = INTENT_NAMES[intent] if isinstance(intent, str) else int(intent)
    return INTENTS[num][1](df, slots, selected_profile, as_of=as_of)
