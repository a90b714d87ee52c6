"""Query catalogue: key -> Spark query over the driver tables, and its DuckDB oracle.

Every query reads the stored transaction table bound from the driver tables
(or another driver table), so its work grows with the data. Parameters are
fixed values from the bound domains (FIXTURES.md section 3).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.operators import clean, describe, detail, filters, intents, results, setops, summaries
from spendlens.functions.text import sql_str
from spendlens.operators.detail import DetailSpec
from spendlens.operators.filters import Slots
from spendlens.sources import table as tbl
from spendlens.sources.binding import with_transactions

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None  # None -> rows-only check


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: str | None, raw_sql: bool = False):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[key] = Entry(fn, None if sql is None else (sql if raw_sql else with_transactions(sql)))
        return fn

    return deco


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tbl.stored_transactions(spark, sf_dir)


# --- shared SQL fragments (DuckDB) ------------------------------------------------------

COLS = "date, merchant, description, amount, category, profile, bank, currency"
TOTAL_SPENT = "CAST(ROUND(SUM(CAST(ABS(amount) AS DECIMAL(18,4))), 2) AS DOUBLE)"
AVG_ABS = (
    "CAST((CAST(SUM(CAST(ABS(amount) AS DECIMAL(18,4))) * 10000 AS HUGEINT) * 2 + COUNT(*) * 100)"
    " // (NULLIF(COUNT(*), 0) * 200) AS DOUBLE) / 100"
)


def xsum(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"


def rsum(expr: str) -> str:
    return f"CAST(ROUND(SUM(CAST({expr} AS DECIMAL(18,4))), 2) AS DOUBLE)"


EXPENSE_VIEW = (
    "SELECT *, strftime(date, '%Y-%m') AS month,"
    " CASE WHEN amount < 0 THEN -amount ELSE CAST(0 AS DOUBLE) END AS expense_amount,"
    " CASE WHEN amount > 0 THEN amount ELSE CAST(0 AS DOUBLE) END AS income_amount FROM transactions"
)


def year_range(y: int) -> str:
    return f"date >= DATE '{y}-01-01' AND date < DATE '{y + 1}-01-01'"


# Fixed parameters over the bound domains.
SLOTS = Slots(category="PROMO", bank="EUROPE", year=1997)
MERCHANT_TERM = "supplier#00000001"
AS_OF = dt.date(1998, 4, 15)
RAW_HEADERS = {"date": " Date ", "merchant": "Merchant", "description": "DESCRIPTION", "amount": "Amount "}


# --- 2.1 sources and sinks ------------------------------------------------------------------


@register("src_table", f"SELECT {COLS} FROM transactions")
def q_src_table(spark, sf_dir):
    return txn(spark, sf_dir)


@register("src_sql", "SELECT bank, COUNT(*) AS n FROM transactions WHERE amount > 0 GROUP BY bank")
def q_src_sql(spark, sf_dir):
    return tbl.src_sql(spark, txn(spark, sf_dir), "SELECT bank, COUNT(*) AS n FROM transactions WHERE amount > 0 GROUP BY bank;")


@register("src_csv", f"SELECT {COLS} FROM transactions")
def q_src_csv(spark, sf_dir):
    return tbl.src_csv(spark, tbl.csv_roundtrip_path(spark, sf_dir))


def _scratch_table(spark: SparkSession, name: str, sf_dir: str) -> str:
    """A fixed table root per query and input. Each run begins without a table; files of the one before go."""
    fp = tbl.fingerprint(spark, [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "orders")])
    root = f"{tbl.tables_root(spark)}/{name}-{fp}"
    tbl.delete(spark, root)
    return root


@register("sink_replace", "SELECT COUNT(*) AS rows_written, COUNT(*) AS rows_read FROM transactions")
def q_sink_replace(spark, sf_dir):
    root = _scratch_table(spark, "replace", sf_dir)
    src = txn(spark, sf_dir)
    tbl.sink_replace(spark, src.where(F.col("amount") > 0), root)  # first content, replaced below
    written = tbl.sink_replace(spark, src, root)
    return tbl.src_table(spark, root).agg(F.lit(written).cast("bigint").alias("rows_written"), F.count(F.lit(1)).alias("rows_read"))


@register("sink_append", f"SELECT {COLS} FROM transactions UNION ALL SELECT {COLS} FROM transactions WHERE amount < 0")
def q_sink_append(spark, sf_dir):
    root = _scratch_table(spark, "append", sf_dir)
    src = txn(spark, sf_dir)
    tbl.sink_replace(spark, src, root)
    tbl.sink_append(spark, src.where(F.col("amount") < 0), root)
    return tbl.src_table(spark, root)


@register("sink_csv_export", f"SELECT {COLS} FROM transactions")
def q_sink_csv_export(spark, sf_dir):
    path = _scratch_table(spark, "export", sf_dir)
    tbl.sink_csv_export(txn(spark, sf_dir).withColumn("id", F.monotonically_increasing_id()), path)
    return tbl.src_csv(spark, path)


@register("src_preview", None)
def q_src_preview(spark, sf_dir):
    return tbl.src_preview(txn(spark, sf_dir))


# --- 2.2 cleaning ---------------------------------------------------------------------------


#: Raw text rows as a CSV holds them, with what goes wrong there; which row gets what follows from its amount. One text
#: for both engines.
DIRTY_SQL = (
    "SELECT CASE k % 13 WHEN 0 THEN 'garbage' WHEN 1 THEN d || 'T10:00:00' WHEN 2 THEN '  ' || d || ' 08:30 ' WHEN 3 THEN d || 'T23:59:59+05:00'"
    " WHEN 4 THEN '2024-02-30' WHEN 5 THEN NULL WHEN 6 THEN '  ' WHEN 7 THEN d || 'T01:02:03.5Z' WHEN 8 THEN d || ' 9' ELSE d END AS date,"
    " CASE k % 7 WHEN 0 THEN NULL WHEN 1 THEN '   ' WHEN 2 THEN '  ' || merchant || chr(9) WHEN 3 THEN chr(10) || merchant ELSE merchant END AS merchant, description,"
    " CASE k % 11 WHEN 0 THEN '1,000' WHEN 1 THEN '$5' WHEN 2 THEN NULL WHEN 3 THEN '1d' WHEN 4 THEN 'nan' WHEN 5 THEN ' ' || a || ' ' WHEN 6 THEN '-inf'"
    " WHEN 7 THEN '+1.5e2' WHEN 8 THEN '' ELSE a END AS amount,"
    " CASE k % 5 WHEN 0 THEN NULL ELSE category END AS category, CASE k % 3 WHEN 0 THEN ' ' || profile ELSE profile END AS profile, bank,"
    " CASE k % 17 WHEN 0 THEN NULL ELSE currency END AS currency, 'x' AS spare_column"
    " FROM (SELECT *, CAST(round(abs(amount) * 100) AS BIGINT) AS k, CAST(date AS STRING) AS d, CAST(amount AS STRING) AS a FROM {transactions}) t"
)
_DIRTY = f"r AS ({DIRTY_SQL.format(transactions='transactions')})"
_DATE = f"TRY_CAST(NULLIF(regexp_extract(date, {sql_str(clean.ISO_DATE)}, 1), '') AS DATE)"
_AMOUNT = f"CASE WHEN regexp_matches(amount, {sql_str(clean.NUMBER)}) THEN TRY_CAST(trim(amount) AS DOUBLE) END"
_TEXT = {c: f"trim(COALESCE({c}, 'Unknown'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))" for c in ("merchant", "description", "category", "profile", "bank", "currency")}
_PARSED = (
    f"p AS (SELECT {_DATE} AS date, {_TEXT['merchant']} AS merchant, {_TEXT['description']} AS description, {_AMOUNT} AS amount, "
    + ", ".join(f"{_TEXT[c]} AS {c}" for c in ("category", "profile", "bank", "currency"))
    + ", date IS NULL OR trim(date) = '' AS no_date, amount IS NULL OR trim(amount) = '' AS no_amount FROM r)"
)
_REASON = (
    "CASE WHEN date IS NULL AND no_date THEN 'no date' WHEN date IS NULL THEN 'bad date' WHEN amount IS NULL AND no_amount THEN 'no amount'"
    " WHEN amount IS NULL THEN 'bad amount' END"
)
_CLEAN = f"WITH {_DIRTY}, {_PARSED}"


def raw_view(spark, sf_dir) -> DataFrame:
    """The dirty rows under raw headers."""
    raw = spark.sql(DIRTY_SQL, transactions=txn(spark, sf_dir))
    return raw.withColumnsRenamed(RAW_HEADERS | {"spare_column": "Spare Column"})


@register("norm_headers", f"WITH {_DIRTY} SELECT date, merchant, description, {_AMOUNT} AS amount, category, profile, bank, currency, spare_column FROM r")
def q_norm_headers(spark, sf_dir):
    out = clean.norm_headers(raw_view(spark, sf_dir))
    return out.withColumn("amount", clean.amount_expr(out, "amount"))


@register("norm_required", f"WITH {_DIRTY} SELECT date, merchant, description, {_AMOUNT} AS amount, category, profile, bank, currency FROM r")
def q_norm_required(spark, sf_dir):
    out = clean.norm_required(clean.norm_headers(raw_view(spark, sf_dir)))
    return out.withColumn("amount", clean.amount_expr(out, "amount"))


@register("norm_date", f"{_CLEAN} SELECT date FROM p")
def q_norm_date(spark, sf_dir):
    raw = clean.norm_headers(raw_view(spark, sf_dir))
    return raw.select(clean.date_expr(raw, "date").alias("date"))


@register("norm_amount", f"{_CLEAN} SELECT amount FROM p")
def q_norm_amount(spark, sf_dir):
    raw = clean.norm_headers(raw_view(spark, sf_dir))
    return raw.select(clean.amount_expr(raw, "amount").alias("amount"))


@register("norm_text", f"{_CLEAN} SELECT merchant, description, category, profile, bank, currency FROM p")
def q_norm_text(spark, sf_dir):
    raw = clean.norm_headers(raw_view(spark, sf_dir))
    return raw.select(*[clean.text_expr(c).alias(c) for c in ("merchant", "description", "category", "profile", "bank", "currency")])


_KEPT = f"{_CLEAN} SELECT {COLS} FROM p WHERE date IS NOT NULL AND amount IS NOT NULL"


@register("norm_dropna", _KEPT)
def q_norm_dropna(spark, sf_dir):
    return clean.normalize_with_rejects(raw_view(spark, sf_dir)).kept


@register("norm_rejects", f"{_CLEAN} SELECT {COLS}, {_REASON} AS reason FROM p WHERE date IS NULL OR amount IS NULL")
def q_norm_rejects(spark, sf_dir):
    return clean.normalize_with_rejects(raw_view(spark, sf_dir)).rejected


@register("norm_counts", f"{_CLEAN} SELECT COALESCE({_REASON}, 'kept') AS result, COUNT(*) AS rows, true AS observed FROM p GROUP BY 1")
def q_norm_counts(spark, sf_dir):
    """The rows of either output by result; ``observed`` where the parse has counted as many."""
    got = clean.normalize_with_rejects(raw_view(spark, sf_dir))
    rows = got.rejected.groupBy(F.col("reason").alias("result")).agg(F.count(F.lit(1)).alias("rows"))
    rows = rows.unionByName(got.kept.groupBy(F.lit("kept").alias("result")).agg(F.count(F.lit(1)).alias("rows")))
    counted = F.create_map(*[x for k, n in got.counts.items() for x in (F.lit(k), F.lit(n))])
    return rows.withColumn("observed", F.coalesce(F.try_element_at(counted, F.col("result")) == F.col("rows"), F.lit(False)))


@register("norm_iso_date", f"{_CLEAN} SELECT strftime(date, '%Y-%m-%d') AS date FROM p WHERE date IS NOT NULL AND amount IS NOT NULL")
def q_norm_iso_date(spark, sf_dir):
    return clean.normalize(raw_view(spark, sf_dir)).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


@register("normalize", _KEPT)
def q_normalize(spark, sf_dir):
    return clean.normalize(raw_view(spark, sf_dir))


@register("expense_view", EXPENSE_VIEW)
def q_expense_view(spark, sf_dir):
    return clean.expense_view(txn(spark, sf_dir))


@register("expense_only", f"SELECT {COLS}, ABS(amount) AS expense_amount FROM transactions WHERE amount < 0")
def q_expense_only(spark, sf_dir):
    return clean.expense_only(txn(spark, sf_dir))


@register(
    "feature_view",
    f"SELECT {COLS}, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,"
    " CAST(amount > 0 AS INTEGER) AS is_income, ABS(amount) AS abs_amount,"
    " merchant || ' ' || description || ' ' || profile || ' ' || bank AS text FROM transactions",
)
def q_feature_view(spark, sf_dir):
    return clean.feature_view(txn(spark, sf_dir))


@register("date_parts", f"SELECT {COLS}, CAST(year(date) AS INTEGER) AS year, strftime(date, '%Y-%m') AS month FROM transactions")
def q_date_parts(spark, sf_dir):
    return clean.date_parts(txn(spark, sf_dir))


@register("drop_id", f"SELECT {COLS} FROM transactions")
def q_drop_id(spark, sf_dir):
    return clean.drop_id(txn(spark, sf_dir).withColumn("id", F.monotonically_increasing_id()))


# --- 2.3 filters ------------------------------------------------------------------------------


def _filtered(key: str, where: str, cond_fn):
    @register(key, f"SELECT {COLS} FROM transactions WHERE {where}")
    def q(spark, sf_dir):
        return filters.apply(txn(spark, sf_dir), cond_fn())

    return q


_filtered("flt_sign", "amount > 0", lambda: filters.flt_sign(True))
_filtered("flt_category", "category = 'PROMO'", lambda: filters.flt_eq("category", "PROMO"))
_filtered("flt_bank", "bank = 'MIDDLE EAST'", lambda: filters.flt_eq("bank", "MIDDLE EAST"))
_filtered("flt_profile", "profile = 'HOUSEHOLD'", lambda: filters.flt_eq("profile", "HOUSEHOLD"))
_filtered("flt_year", year_range(1996), lambda: filters.flt_year(1996))
@register("flt_month", f"SELECT {COLS} FROM transactions WHERE month(date) = 7")
def q_flt_month(spark, sf_dir):
    return filters.apply(txn(spark, sf_dir), filters.flt_month(7, tbl.stored_year_span(spark, sf_dir)))


@register("flt_months_in", f"SELECT {COLS} FROM transactions WHERE month(date) IN (1, 2)")
def q_flt_months_in(spark, sf_dir):
    return filters.apply(txn(spark, sf_dir), filters.flt_months_in([1, 2], tbl.stored_year_span(spark, sf_dir)))
_filtered("flt_merchant_like", f"contains(lower(merchant), '{MERCHANT_TERM}')", lambda: filters.flt_merchant_like(MERCHANT_TERM.upper()))
_filtered(
    "flt_last_month",
    "amount < 0 AND category = 'PROMO' AND date >= DATE '1998-03-01' AND date < DATE '1998-04-01'",
    lambda: filters.flt_compose([filters.flt_sign(False), filters.flt_eq("category", "PROMO"), filters.flt_last_month(AS_OF)]),
)
_filtered("flt_this_month", "date >= DATE '1998-04-01' AND date < DATE '1998-05-01'", lambda: filters.flt_this_month(AS_OF))
_filtered(
    "flt_compose",
    f"amount < 0 AND category = 'PROMO' AND bank = 'EUROPE' AND {year_range(1997)}",
    lambda: filters.flt_compose(filters.slot_filters(SLOTS)),
)
_filtered(
    "flt_scope_profile",
    f"amount < 0 AND bank = 'ASIA' AND profile = 'BUILDING'",
    lambda: filters.flt_compose(filters.slot_filters(Slots(bank="ASIA")) + [filters.flt_scope_profile("BUILDING")]),
)


@register("flt_sidebar", f"SELECT {COLS} FROM transactions WHERE profile = 'FURNITURE' AND category = 'SMALL'")
def q_flt_sidebar(spark, sf_dir):
    return filters.flt_sidebar(txn(spark, sf_dir), profile="FURNITURE", bank="All", category="SMALL")


@register("flt_positive_expense", f"SELECT * FROM ({EXPENSE_VIEW}) WHERE expense_amount > 0")
def q_flt_positive_expense(spark, sf_dir):
    return clean.expense_view(txn(spark, sf_dir)).where(filters.flt_positive_expense())


# --- 2.4 aggregations -------------------------------------------------------------------------

EV = f"WITH ev AS ({EXPENSE_VIEW}) "


def _view(spark, sf_dir):
    return clean.expense_view(txn(spark, sf_dir))


@register(
    "kpi_dashboard",
    EV + "SELECT COALESCE(" + xsum("expense_amount") + ", 0) AS total_spent, COALESCE(" + xsum("income_amount")
    + ", 0) AS total_income, COALESCE(" + xsum("amount") + ", 0) AS net_cashflow, COUNT(*) AS transaction_count FROM ev",
)
def q_kpi_dashboard(spark, sf_dir):
    return summaries.kpi_dashboard(_view(spark, sf_dir))


@register(
    "kpi_demo",
    EV + "SELECT COUNT(*) AS transactions, CAST(COALESCE(SUM(CAST(income_amount AS DECIMAL(18,4))), 0) AS DOUBLE) AS total_income,"
    " CAST(COALESCE(SUM(CAST(expense_amount AS DECIMAL(18,4))), 0) AS DOUBLE) AS total_spending,"
    " CAST(COALESCE(SUM(CAST(income_amount AS DECIMAL(18,4))), 0) - COALESCE(SUM(CAST(expense_amount AS DECIMAL(18,4))), 0) AS DOUBLE) AS net_cash_flow,"
    " COALESCE(SUM(CAST(income_amount AS DECIMAL(18,4))), 0) > 0 AND COALESCE(SUM(CAST(expense_amount AS DECIMAL(18,4))), 0) * 10"
    " > COALESCE(SUM(CAST(income_amount AS DECIMAL(18,4))), 0) * 12 AS spending_over_120pct FROM ev",
)
def q_kpi_demo(spark, sf_dir):
    return summaries.kpi_demo(_view(spark, sf_dir))


@register(
    "kpi_domains",
    "SELECT array_to_string(list_sort(list_distinct(list(profile))), ', ') AS profiles,"
    " array_to_string(list_sort(list_distinct(list(bank))), ', ') AS banks,"
    " array_to_string(list_sort(list_distinct(list(CAST(year(date) AS VARCHAR)))), ', ') AS years FROM transactions",
)
def q_kpi_domains(spark, sf_dir):
    return summaries.kpi_domains(_view(spark, sf_dir))


for _key, _col in (("spend_by_category", "category"), ("spend_by_profile", "profile"), ("spend_by_bank", "bank")):

    def _mk(col):
        def q(spark, sf_dir):
            return getattr(summaries, f"spend_by_{col}")(_view(spark, sf_dir))

        return q

    register(_key, EV + f"SELECT {_col}, {xsum('expense_amount')} AS expense_amount FROM ev WHERE expense_amount > 0 GROUP BY {_col}")(_mk(_col))


@register("cashflow_by_month", EV + f"SELECT month, {xsum('expense_amount')} AS spending, {xsum('income_amount')} AS income FROM ev GROUP BY month")
def q_cashflow_by_month(spark, sf_dir):
    return summaries.cashflow_by_month(_view(spark, sf_dir))


@register("spend_by_month", f"SELECT strftime(date, '%Y-%m') AS month, {xsum('ABS(amount)')} AS expense_amount FROM transactions WHERE amount < 0 GROUP BY 1")
def q_spend_by_month(spark, sf_dir):
    return summaries.spend_by_month(txn(spark, sf_dir))


@register(
    "cashflow_long",
    EV + f", w AS (SELECT month, {xsum('income_amount')} AS income, {xsum('expense_amount')} AS expenses FROM ev GROUP BY month)"
    " SELECT month, 'income' AS type, income AS amount FROM w UNION ALL SELECT month, 'expenses' AS type, expenses AS amount FROM w",
)
def q_cashflow_long(spark, sf_dir):
    return summaries.cashflow_long(_view(spark, sf_dir))


@register("count_by_category", "SELECT category, COUNT(*) AS transactions FROM transactions GROUP BY category")
def q_count_by_category(spark, sf_dir):
    return summaries.count_by_category(txn(spark, sf_dir))


@register("count_by_profile", "SELECT profile, COUNT(*) AS transactions FROM transactions GROUP BY profile")
def q_count_by_profile(spark, sf_dir):
    return summaries.count_by_profile(txn(spark, sf_dir))


@register("count_by_profile_bank", "SELECT profile, bank, COUNT(*) AS records FROM transactions GROUP BY profile, bank")
def q_count_by_profile_bank(spark, sf_dir):
    return summaries.count_by_profile_bank(txn(spark, sf_dir))


@register("count_by_year", "SELECT CAST(year(date) AS INTEGER) AS year, COUNT(*) AS records FROM transactions GROUP BY 1")
def q_count_by_year(spark, sf_dir):
    return summaries.count_by_year(txn(spark, sf_dir))


@register("category_totals", f"SELECT category, COUNT(*) AS records, {xsum('amount')} AS total_amount FROM transactions GROUP BY category")
def q_category_totals(spark, sf_dir):
    return summaries.category_totals(txn(spark, sf_dir))


@register(
    "profile_bank_summary",
    "SELECT profile, bank, COUNT(*) AS records,"
    f" {rsum('CASE WHEN amount < 0 THEN ABS(amount) ELSE 0 END')} AS spending,"
    f" {rsum('CASE WHEN amount > 0 THEN amount ELSE 0 END')} AS income"
    " FROM transactions GROUP BY profile, bank",
)
def q_profile_bank_summary(spark, sf_dir):
    return summaries.profile_bank_summary(txn(spark, sf_dir))


@register(
    "table_stats",
    "SELECT COUNT(*) AS total_records, MIN(date) AS min_date, MAX(date) AS max_date,"
    " COUNT(DISTINCT profile) AS profiles, COUNT(DISTINCT bank) AS banks FROM transactions",
)
def q_table_stats(spark, sf_dir):
    return summaries.table_stats(txn(spark, sf_dir))


for _c in summaries.DISTINCT_COLUMNS:

    def _mkd(col):
        def q(spark, sf_dir):
            return summaries.distinct_values(txn(spark, sf_dir), col)

        return q

    register(f"distinct_{_c}s" if not _c.endswith("y") else f"distinct_{_c[:-1]}ies",
             f"SELECT DISTINCT {_c} FROM transactions WHERE {_c} IS NOT NULL")(_mkd(_c))


@register(
    "null_counts",
    "SELECT * FROM (VALUES ('date', 'date'), ('merchant', 'string'), ('description', 'string'), ('amount', 'double'),"
    " ('category', 'string'), ('profile', 'string'), ('bank', 'string'), ('currency', 'string')) t(\"column\", dtype)"
    " JOIN (UNPIVOT (SELECT COUNT(date) AS date, COUNT(merchant) AS merchant, COUNT(description) AS description,"
    " COUNT(amount) AS amount, COUNT(category) AS category, COUNT(profile) AS profile, COUNT(bank) AS bank,"
    " COUNT(currency) AS currency FROM transactions) ON COLUMNS(*) INTO NAME \"column\" VALUE non_null) u USING (\"column\")",
)
def q_null_counts(spark, sf_dir):
    return summaries.null_counts(txn(spark, sf_dir))


_TEXT_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS column, (SELECT COUNT({c}) FROM transactions) AS count, (SELECT COUNT(DISTINCT {c}) FROM transactions) AS unique,"
    f" (SELECT {c} FROM transactions WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS top,"
    f" (SELECT COUNT(*) FROM transactions WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC LIMIT 1) AS freq,"
    " NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50,"
    " NULL::DOUBLE AS q75, NULL::DOUBLE AS max"
    for c in ("merchant", "description", "category", "profile", "bank", "currency")
)


@register(
    "describe_all",
    "SELECT 'amount' AS column, COUNT(amount) AS count, NULL::BIGINT AS unique, NULL::VARCHAR AS top, NULL::BIGINT AS freq,"
    " round(avg(amount), 6) AS mean, round(stddev_samp(amount), 6) AS std, round(min(amount), 6) AS min,"
    " round(quantile_cont(amount, 0.25), 6) AS q25, round(quantile_cont(amount, 0.5), 6) AS q50,"
    " round(quantile_cont(amount, 0.75), 6) AS q75, round(max(amount), 6) AS max FROM transactions UNION ALL " + _TEXT_DESCRIBE,
)
def q_describe_all(spark, sf_dir):
    return describe.describe_all(txn(spark, sf_dir))


@register("rows_after_write", "SELECT COUNT(*) AS rows FROM transactions")
def q_rows_after_write(spark, sf_dir):
    root = _scratch_table(spark, "loaded", sf_dir)
    tbl.sink_replace(spark, txn(spark, sf_dir), root)
    return summaries.rows_after_write(tbl.src_table(spark, root))


# --- 2.5 intents --------------------------------------------------------------------------------

TOP_BY = "SELECT {k}, " + TOTAL_SPENT + " AS total_spent, COUNT(*) AS transaction_count FROM transactions WHERE {w} GROUP BY {k} ORDER BY total_spent DESC, {k}"


def _intent(key: str, sql: str, slots: Slots = Slots(), selected: str | None = None, as_of: dt.date | None = None):
    def q(spark, sf_dir):
        span = tbl.stored_year_span(spark, sf_dir)  # lets month filters reach the scan
        return intents.run_intent(txn(spark, sf_dir), key, slots.with_(years=span), selected, as_of)

    register(key, sql)(q)


_intent(
    "recurring",
    f"SELECT merchant, category, {AVG_ABS} AS average_amount, COUNT(*) AS transaction_count FROM transactions"
    " WHERE amount < 0 GROUP BY merchant, category HAVING COUNT(*) >= 6"
    " ORDER BY transaction_count DESC, average_amount DESC, merchant, category LIMIT 20",
)
_intent(
    "frequent_subscriptions",
    f"SELECT merchant, category, COUNT(*) AS transaction_count, {TOTAL_SPENT} AS total_spent FROM transactions"
    " WHERE amount < 0 AND bank = 'ASIA' GROUP BY merchant, category"
    " ORDER BY transaction_count DESC, total_spent DESC, merchant, category LIMIT 3",
    Slots(bank="ASIA", top3=True),
)
_intent(
    "merchant_transactions",
    "SELECT date, merchant, description, amount, category, profile, bank FROM transactions"
    f" WHERE amount < 0 AND {year_range(1996)} AND contains(lower(merchant), '{MERCHANT_TERM}')"
    " ORDER BY date DESC, merchant, description, amount, category, profile, bank LIMIT 50",
    Slots(year=1996, merchant=MERCHANT_TERM),
)
_intent(
    "compare_jan_feb",
    f"SELECT strftime(date, '%Y-%m') AS month, category, {TOTAL_SPENT} AS total_spent FROM transactions"
    " WHERE amount < 0 AND month(date) IN (1, 2) AND profile = 'BUILDING' GROUP BY 1, 2",
    selected="BUILDING",
)
_intent(
    "largest_category",
    f"SELECT category, {TOTAL_SPENT} AS total_spent FROM transactions WHERE amount < 0 GROUP BY category"
    " ORDER BY total_spent DESC, category LIMIT 1",
)
_intent("top_profile", TOP_BY.format(k="profile", w="amount < 0") + " LIMIT 1")
_intent("compare_profiles", TOP_BY.format(k="profile", w="amount < 0 AND profile = 'MACHINERY'"), selected="MACHINERY")
_intent(
    "top_merchants",
    f"SELECT merchant, category, {TOTAL_SPENT} AS total_spent, COUNT(*) AS transaction_count FROM transactions"
    f" WHERE amount < 0 AND {year_range(1998)} GROUP BY merchant, category ORDER BY total_spent DESC, merchant, category LIMIT 10",
    Slots(year=1998),
)
_intent("top_categories", TOP_BY.format(k="category", w="amount < 0 AND bank = 'AMERICA'") + " LIMIT 10", Slots(bank="AMERICA"))
_intent(
    "average_amount",
    f"SELECT {AVG_ABS} AS average_transaction_amount, COUNT(*) AS transaction_count FROM transactions WHERE amount < 0 AND category = 'SMALL'",
    Slots(category="SMALL"),
)
_intent(
    "count_transactions",
    "SELECT COUNT(*) AS transaction_count FROM transactions WHERE profile = 'MACHINERY' AND month(date) = 3",
    Slots(profile="MACHINERY", month=3),
    selected="BUILDING",
)
_intent(
    "income_total",
    f"SELECT {rsum('amount')} AS total_income, COUNT(*) AS income_transactions FROM transactions"
    f" WHERE amount > 0 AND {year_range(1999)} AND profile = 'FURNITURE'",
    Slots(year=1999, category="Income"),
    selected="FURNITURE",
)
_intent("by_bank", TOP_BY.format(k="bank", w="amount < 0"))
_intent("by_profile", TOP_BY.format(k="profile", w="amount < 0"))
_intent(
    "by_month",
    f"SELECT strftime(date, '%Y-%m') AS month, {TOTAL_SPENT} AS total_spent, COUNT(*) AS transaction_count FROM transactions"
    " WHERE amount < 0 AND category = 'LARGE' GROUP BY 1",
    Slots(category="LARGE"),
)
_intent(
    "by_year",
    f"SELECT strftime(date, '%Y') AS year, {TOTAL_SPENT} AS total_spent, COUNT(*) AS transaction_count FROM transactions"
    " WHERE amount < 0 AND bank = 'AFRICA' GROUP BY 1",
    Slots(bank="AFRICA"),
)
_intent(
    "category_last_month",
    f"SELECT {TOTAL_SPENT} AS total_spent, COUNT(*) AS transaction_count FROM transactions"
    " WHERE amount < 0 AND category = 'PROMO' AND date >= DATE '1998-03-01' AND date < DATE '1998-04-01'",
    Slots(category="PROMO"),
    as_of=AS_OF,
)
_intent(
    "slot_total",
    f"SELECT {TOTAL_SPENT} AS total_spent, COUNT(*) AS transaction_count FROM transactions"
    f" WHERE amount < 0 AND category = 'PROMO' AND bank = 'EUROPE' AND {year_range(1997)}",
    SLOTS,
)
_intent("default_top_categories", TOP_BY.format(k="category", w="amount < 0 AND profile = 'HOUSEHOLD'") + " LIMIT 10", selected="HOUSEHOLD")


# --- 2.5 drill-down -------------------------------------------------------------------------------

SPEND_SPEC = DetailSpec(Slots(category="MEDIUM", year=1998), income=False, listing=False, selected_profile="AUTOMOBILE")
INCOME_SPEC = DetailSpec(Slots(category="PROMO", year=1996), income=True, listing=False)
LISTING_SPEC = DetailSpec(Slots(merchant="supplier#00000002"), income=False, listing=True, selected_profile="HOUSEHOLD")
SPEND_WHERE = f"amount < 0 AND profile = 'AUTOMOBILE' AND category = 'MEDIUM' AND {year_range(1998)}"
INCOME_WHERE = f"amount > 0 AND {year_range(1996)}"
LISTING_WHERE = "amount < 0 AND profile = 'HOUSEHOLD' AND contains(lower(merchant), 'supplier#00000002')"


@register("detail_rows", f"SELECT date, merchant, category, amount, bank, profile FROM transactions WHERE {SPEND_WHERE}")
def q_detail_rows(spark, sf_dir):
    return detail.detail_rows(txn(spark, sf_dir), SPEND_SPEC)


def _monthly(key, value, where, spec):
    @register(key, f"SELECT strftime(date, '%Y-%m') AS month, {value}, COUNT(*) AS transaction_count FROM transactions WHERE {where} GROUP BY 1")
    def q(spark, sf_dir):
        return detail.detail_monthly(txn(spark, sf_dir), spec)


_monthly("detail_monthly_income", f"{rsum('amount')} AS total_income", INCOME_WHERE, INCOME_SPEC)
_monthly("detail_monthly_amount", f"{rsum('ABS(amount)')} AS total_amount", LISTING_WHERE, LISTING_SPEC)
_monthly("detail_monthly_spent", f"{rsum('ABS(amount)')} AS total_spent", SPEND_WHERE, SPEND_SPEC)


@register(
    "detail_totals",
    f"SELECT CAST(COALESCE(SUM(CAST(ABS(amount) AS DECIMAL(18,4))), 0) AS DOUBLE) AS total, COUNT(*) AS transaction_count,"
    f" 'MEDIUM' AS label FROM transactions WHERE {SPEND_WHERE}",
)
def q_detail_totals(spark, sf_dir):
    return detail.detail_totals(txn(spark, sf_dir), SPEND_SPEC)


# --- 2.6 result-level ------------------------------------------------------------------------------

@register(
    "result_zero_like",
    "WITH r AS (" + TOP_BY.format(k="category", w="amount < 0 AND category = 'NO SUCH'") + ")"
    " SELECT COALESCE(bool_and(COALESCE(TRY_CAST(CAST(total_spent AS VARCHAR) AS DOUBLE), 0) = 0), true) AS zero_like FROM r",
)
def q_result_zero_like(spark, sf_dir):
    res = intents.top_categories(txn(spark, sf_dir), Slots(category="NO SUCH"))
    return results.result_zero_like(res)


@register(
    "result_rollup",
    "WITH r AS (" + TOP_BY.format(k="category", w="amount < 0 AND bank = 'AMERICA'") + " LIMIT 10)"
    " SELECT COUNT(*) AS rows, CAST(COALESCE(SUM(CAST(total_spent AS DECIMAL(18,4))), 0) AS DOUBLE) AS sum_total_spent,"
    " arg_min(category, (-total_spent, category)) AS first_key, arg_min(total_spent, (-total_spent, category)) AS first_total_spent FROM r",
)
def q_result_rollup(spark, sf_dir):
    res = intents.top_categories(txn(spark, sf_dir), Slots(bank="AMERICA"))
    return results.result_rollup(res, ["-total_spent", "category"], "category")


@register("result_top3", TOP_BY.format(k="category", w="amount < 0 AND bank = 'AMERICA'") + " LIMIT 3")
def q_result_top3(spark, sf_dir):
    return results.result_top3(intents.top_categories(txn(spark, sf_dir), Slots(bank="AMERICA")))


# --- 2.7 sorts, limits, set operations -----------------------------------------------------------------


@register("sort_recent", f"SELECT {COLS} FROM transactions ORDER BY date DESC, merchant, description, amount, category, profile, bank, currency")
def q_sort_recent(spark, sf_dir):
    return setops.sort_recent(txn(spark, sf_dir))


@register("sort_canonical", f"SELECT {COLS} FROM transactions ORDER BY profile, bank, date, merchant, description, amount, category, currency")
def q_sort_canonical(spark, sf_dir):
    return setops.sort_canonical(txn(spark, sf_dir))


@register("topk", f"SELECT {COLS} FROM transactions ORDER BY amount DESC, date, merchant, description, category, profile, bank LIMIT 20")
def q_topk(spark, sf_dir):
    order = [F.desc("amount"), "date", "merchant", "description", "category", "profile", "bank"]
    return setops.topk(txn(spark, sf_dir), order, 20)


TAXONOMY_VALUES = "(VALUES " + ", ".join(f"('{c}')" for c in setops.CATEGORY_TAXONOMY) + ") t(category)"


@register("taxonomy_unexpected", f"SELECT DISTINCT category FROM transactions WHERE category NOT IN (SELECT category FROM {TAXONOMY_VALUES})")
def q_taxonomy_unexpected(spark, sf_dir):
    return setops.taxonomy_unexpected(txn(spark, sf_dir))


@register("taxonomy_missing", f"SELECT category FROM {TAXONOMY_VALUES} WHERE category NOT IN (SELECT category FROM transactions)")
def q_taxonomy_missing(spark, sf_dir):
    return setops.taxonomy_missing(txn(spark, sf_dir))


EXPECTED_PROFILES = ["AUTOMOBILE", "BUILDING", "Student"]


@register(
    "profile_coverage",
    "WITH m AS (SELECT p FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('Student')) t(p) WHERE p NOT IN (SELECT profile FROM transactions))"
    " SELECT COUNT(*) = 0 AS all_present, COUNT(*) AS missing_profiles FROM m",
)
def q_profile_coverage(spark, sf_dir):
    return setops.profile_coverage(txn(spark, sf_dir), EXPECTED_PROFILES)


@register("distinct", "SELECT DISTINCT profile, bank FROM transactions")
def q_distinct(spark, sf_dir):
    return txn(spark, sf_dir).select("profile", "bank").distinct()


@register("union_append", f"SELECT {COLS} FROM transactions UNION ALL SELECT {COLS} FROM transactions WHERE amount > 0")
def q_union_append(spark, sf_dir):
    t = txn(spark, sf_dir)
    return setops.union_append(t, t.where(F.col("amount") > 0))


# --- incremental upload (Structured Streaming) ------------------------------------------------------


@register("stream_ingest", f"SELECT {COLS} FROM transactions")
def q_stream_ingest(spark, sf_dir):
    from spendlens.streaming import ingest

    root = _scratch_table(spark, "stream", sf_dir)
    query = ingest.ingest(spark, tbl.csv_roundtrip_path(spark, sf_dir), root)
    query.awaitTermination()
    return ingest.read_ingested(spark, root)


@register("src_seed_fallback", f"SELECT {COLS} FROM transactions")
def q_src_seed_fallback(spark, sf_dir):
    from spendlens.sources.binding import bind_transactions

    root = _scratch_table(spark, "seeded", sf_dir)
    return tbl.src_seed_fallback(spark, root, lambda: bind_transactions(spark, sf_dir))
