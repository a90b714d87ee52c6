"""Dashboard, demo-summary, database-page and notebook aggregations.

All are single ``groupBy``/global aggregates: Spark runs a partial aggregate
before the shuffle, so only one row per group and partition crosses the
network. Group keys here are low-cardinality domains (category, profile,
bank, month, year). Money sums are exact decimals cast to DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendlens.functions.dates import label_month, month_start
from spendlens.functions.money import count_rows, exact_sum, money_sum, round_sum_2
from spendlens.operators.clean import date_parts, expense_only
from spendlens.operators.filters import flt_positive_expense


def _zero_if_null(c):
    return F.coalesce(c, F.lit(0.0))


def kpi_dashboard(view: DataFrame) -> DataFrame:
    """total spent, total income, net cash flow, count; empty input gives 0."""
    return view.agg(
        _zero_if_null(exact_sum("expense_amount")).alias("total_spent"),
        _zero_if_null(exact_sum("income_amount")).alias("total_income"),
        _zero_if_null(exact_sum("amount")).alias("net_cashflow"),
        count_rows().alias("transaction_count"),
    )


def kpi_demo(view: DataFrame) -> DataFrame:
    """count, income, spending, net = income - spending, over-120 % flag."""
    agg = view.agg(
        count_rows().alias("transactions"),
        money_sum("income_amount").alias("inc"),
        money_sum("expense_amount").alias("spd"),
        _zero_if_null(exact_sum("income_amount")).alias("total_income"),
        _zero_if_null(exact_sum("expense_amount")).alias("total_spending"),
    )
    # Exact where both sums are, else on the doubles.
    inc, spd, income, spending = (F.col(c) for c in ("inc", "spd", "total_income", "total_spending"))
    over = F.coalesce(spd * 10 > inc * 12, spending * 10 > income * 12)
    return agg.select(
        "transactions",
        "total_income",
        "total_spending",
        F.coalesce((inc - spd).cast("double"), income - spending).alias("net_cash_flow"),
        ((income > 0) & over).alias("spending_over_120pct"),
    )


def _joined_distinct(expr, name: str):
    # collect_set keeps one entry per value in each partial aggregate, so the final
    # merge holds the value domain (profiles, banks, years), not the rows.
    return F.array_join(F.array_sort(F.collect_set(expr.cast("string"))), ", ").alias(name)


def kpi_domains(view: DataFrame) -> DataFrame:
    """Sorted distinct profiles, banks, years, each as one string."""
    return view.agg(
        _joined_distinct(F.col("profile"), "profiles"),
        _joined_distinct(F.col("bank"), "banks"),
        _joined_distinct(F.year("date"), "years"),
    )


def _spend_by(view: DataFrame, key: str) -> DataFrame:
    return (
        view.where(flt_positive_expense())
        .groupBy(key)
        .agg(exact_sum("expense_amount").alias("expense_amount"))
        .orderBy(F.desc("expense_amount"), key)
    )


def spend_by_category(view: DataFrame) -> DataFrame:
    return _spend_by(view, "category")


def spend_by_profile(view: DataFrame) -> DataFrame:
    return _spend_by(view, "profile")


def spend_by_bank(view: DataFrame) -> DataFrame:
    return _spend_by(view, "bank")


def cashflow_by_month(view: DataFrame) -> DataFrame:
    """month, spending, income; months with income only are kept. Grouped on the
    month start (the view's text month is the same key) and labelled per group."""
    grouped = view.groupBy(month_start().alias("_m")).agg(
        exact_sum("expense_amount").alias("spending"), exact_sum("income_amount").alias("income")
    )
    return label_month(grouped).select("month", "spending", "income").orderBy("month")


def spend_by_month(df: DataFrame) -> DataFrame:
    """Expense rows only, so months without an expense are absent."""
    grouped = expense_only(df).groupBy(month_start().alias("_m")).agg(exact_sum("expense_amount").alias("expense_amount"))
    return label_month(grouped).select("month", "expense_amount").orderBy("month")


def cashflow_long(view: DataFrame) -> DataFrame:
    """Wide -> long: month, type in (income, expenses), amount."""
    wide = view.groupBy(month_start().alias("_m")).agg(
        exact_sum("income_amount").alias("income"), exact_sum("expense_amount").alias("expenses")
    )
    wide = label_month(wide).select("month", "income", "expenses")
    return wide.unpivot("month", ["income", "expenses"], "type", "amount").orderBy("month", "type")


def _count_by(df: DataFrame, key: str, name: str = "transactions") -> DataFrame:
    return df.groupBy(key).agg(count_rows().alias(name)).orderBy(F.desc(name), key)


def count_by_category(df: DataFrame) -> DataFrame:
    return _count_by(df, "category")


def count_by_profile(df: DataFrame) -> DataFrame:
    return _count_by(df, "profile")


def count_by_profile_bank(df: DataFrame) -> DataFrame:
    return df.groupBy("profile", "bank").agg(count_rows().alias("records")).orderBy("profile", "bank")


def count_by_year(df: DataFrame) -> DataFrame:
    return date_parts(df).groupBy("year").agg(count_rows().alias("records")).orderBy("year")


def category_totals(df: DataFrame) -> DataFrame:
    """records and signed total_amount per category."""
    return df.groupBy("category").agg(count_rows().alias("records"), exact_sum("amount").alias("total_amount")).orderBy("category")


def profile_bank_summary(df: DataFrame) -> DataFrame:
    """records, spending, income (CASE sums, rounded) per profile and bank."""
    amount = F.col("amount")
    return (
        df.groupBy("profile", "bank")
        .agg(
            count_rows().alias("records"),
            round_sum_2(F.when(amount < 0, F.abs(amount)).otherwise(F.lit(0.0))).alias("spending"),
            round_sum_2(F.when(amount > 0, amount).otherwise(F.lit(0.0))).alias("income"),
        )
        .orderBy("profile", "bank")
    )


def table_stats(df: DataFrame) -> DataFrame:
    """row count, date range, distinct profiles and banks."""
    return df.agg(
        count_rows().alias("total_records"),
        F.min("date").alias("min_date"),
        F.max("date").alias("max_date"),
        F.countDistinct("profile").alias("profiles"),
        F.countDistinct("bank").alias("banks"),
    )


DISTINCT_COLUMNS = ("profile", "bank", "category")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted non-null distinct values of one whitelisted column."""
    if column not in DISTINCT_COLUMNS:
        raise ValueError(f"distinct values are available for {', '.join(DISTINCT_COLUMNS)} only")
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def null_counts(df: DataFrame) -> DataFrame:
    """Per column: non-null count and type (DataFrame.info)."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in df.columns])
    stack = F.expr(
        "stack({n}, {pairs}) as (column, non_null)".format(
            n=len(df.columns), pairs=", ".join(f"'{c}', `{c}`" for c in df.columns)
        )
    )
    type_map = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return counts.select(stack).withColumn("dtype", type_map[F.col("column")])


def rows_after_write(df: DataFrame) -> DataFrame:
    return df.agg(count_rows().alias("rows"))
