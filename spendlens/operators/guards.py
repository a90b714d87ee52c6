"""Guards over proposed query filters, on structured filter rows.

The reference edits SQL text with regexes; here the proposed filters are rows
``(query_id, field, value)`` and the guard is a join plus ``when`` chains:

* ``guard_filters``: keep / replace (canonical case, or the selected profile)
  / remove each proposed profile, bank or category filter.
* ``guard_required``: rows to add (sign filter, profile, bank, category).
* ``guard_adjusted``: one flag per query.

The value domains (distinct profile / bank / category values of the table)
are small per column; the lookup is a plain equi-join, which AQE turns into a
broadcast join at run time when the measured domain side is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.text import NON_WORD, SPACE
from spendlens.operators.filters import ALL

GUARDED = ["profile", "bank", "category"]
# Groups: the column, what it is compared with.
VALUE_FILTER = rf"(?i)(?:^|{NON_WORD})(profile|bank|category){SPACE}*={SPACE}*'([^']*)'"
SIGN_FILTER = rf"(?i)(?:^|{NON_WORD})(amount){SPACE}*([<>]=?{SPACE}*0)"


def value_domains(transactions: DataFrame) -> DataFrame:
    """(column, lookup, canonical): distinct values of the guarded columns."""
    # One scan for all columns; equal values meet in the partial aggregate, before the shuffle.
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("canonical")) for c in GUARDED]))
    out = transactions.select(each.alias("v")).select("v.*").where(F.col("canonical").isNotNull())
    # The spellings are counted first, by hashing: a maximum of texts sorts the rows that it is taken of. The count is asked
    # for so that Catalyst doesn't merge the two steps.
    out = out.groupBy("field", "canonical").agg(F.count(F.lit(1)).alias("n"))
    # One canonical spelling per lower-case value: the last in sorted order wins.
    out = out.groupBy("field", F.lower("canonical").alias("lookup")).agg(F.max("canonical").alias("canonical"), F.sum("n").alias("n"))
    return out.where("n > 0").drop("n")


def guard_filters(proposed: DataFrame, tags: DataFrame, domains: DataFrame, selected_profile: str | None = None) -> DataFrame:
    """Action per proposed filter.

    proposed: query_id, field, value. tags: query_id, profile, bank, category
    (mentioned in the question, or NULL), is_income, is_spending. An amount
    filter goes when the question asks for income or spending, as the sign
    that it needs is then added.
    """
    sel = selected_profile if selected_profile and selected_profile != ALL else None
    p = proposed.where(F.col("field").isin([*GUARDED, "amount"]))
    joined = (
        p.join(tags, "query_id", "left")
        .join(domains, (p["field"] == domains["field"]) & (F.lower(p["value"]) == domains["lookup"]), "left")
        .select(p["query_id"], p["field"], p["value"], domains["canonical"], "profile", "bank", "category", "is_income", "is_spending")
    )
    col = F.col("field")
    mentioned = F.when(col == "profile", F.col("profile")).when(col == "bank", F.col("bank")).otherwise(F.col("category"))
    allow = mentioned.isNotNull()
    valid = F.col("canonical")
    if sel is not None:
        allow = allow | (col == "profile")
        valid = F.when(col == "profile", F.lit(sel)).otherwise(valid)
    income_block = col.isin("bank", "category") & F.coalesce(F.col("is_income"), F.lit(False)) & mentioned.isNull()
    allow = allow & ~income_block
    signed = F.coalesce(F.col("is_income"), F.lit(False)) | F.coalesce(F.col("is_spending"), F.lit(False))
    action = (
        F.when((col == "amount") & signed, F.lit("remove"))
        .when(col == "amount", F.lit("keep"))
        .when(~allow, F.lit("remove"))
        .when(valid.isNull(), F.lit("remove"))
        .when(F.col("value") != valid, F.lit("replace"))
        .otherwise(F.lit("keep"))
    )
    return joined.select(
        "query_id", "field", "value", action.alias("action"), F.when(action == "replace", valid).alias("new_value")
    )


def guard_required(tags: DataFrame, kept: DataFrame, selected_profile: str | None = None) -> DataFrame:
    """Filters to add per query: (query_id, field, op, value).

    kept: the filters left after ``guard_filters`` - used to skip bank /
    category / profile filters that are already present. Without a selected
    profile, only a filter on the mentioned profile itself makes that one
    needless.
    tags: query_id, profile, bank, category, is_income, is_spending.
    """
    sel = selected_profile if selected_profile and selected_profile != ALL else None
    income = F.coalesce(F.col("is_income"), F.lit(False))
    spending = F.coalesce(F.col("is_spending"), F.lit(False))
    cand = F.array(
        F.struct(F.lit("amount").alias("field"), F.lit(">").alias("op"), F.lit("0").alias("value"), income.alias("want")),
        F.struct(F.lit("amount").alias("field"), F.lit("<").alias("op"), F.lit("0").alias("value"), (~income & spending).alias("want")),
        F.struct(
            F.lit("profile").alias("field"),
            F.lit("=").alias("op"),
            (F.lit(sel) if sel else F.col("profile")).alias("value"),
            (F.lit(True) if sel else F.col("profile").isNotNull()).alias("want"),
        ),
        F.struct(F.lit("bank").alias("field"), F.lit("=").alias("op"), F.col("bank").alias("value"), F.col("bank").isNotNull().alias("want")),
        F.struct(
            F.lit("category").alias("field"),
            F.lit("=").alias("op"),
            F.col("category").alias("value"),
            (F.col("category").isNotNull() & (F.col("category") != "Income") & ~income).alias("want"),
        ),
    )
    rows = tags.select("query_id", F.explode(cand).alias("r")).select("query_id", "r.*").where("want").drop("want")
    same = F.when((F.col("field") == "profile") & F.lit(sel is None), F.lower(F.coalesce("new_value", "value")))
    present = kept.where(F.col("field").isin(GUARDED)).select("query_id", "field", same.alias("only")).distinct()
    # The sign filter is always re-added (existing amount filters are dropped first).
    on = (rows["query_id"] == present["query_id"]) & (rows["field"] == present["field"])
    return rows.join(present, on & (present["only"].isNull() | (F.lower(rows["value"]) == present["only"])), "left_anti")


def guard_adjusted(actions: DataFrame, required: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: True when any filter is replaced or removed, or any filter is added."""
    changed = actions.where(F.col("action") != "keep").select("query_id").union(required.select("query_id")).distinct()
    return queries.select("query_id").distinct().join(
        changed.withColumn("adjusted", F.lit(True)), "query_id", "left"
    ).select("query_id", F.coalesce("adjusted", F.lit(False)).alias("adjusted"))


def proposed_filters_from_sql(logged: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Extract ``column = 'value'`` filters on the guarded columns and sign filters on the amount from SQL text."""

    def found(pattern: str) -> Column:
        each = F.regexp_extract_all(F.col(sql_col), F.lit(pattern), 0)
        return F.transform(
            each, lambda m: F.struct(F.lower(F.regexp_extract(m, pattern, 1)).alias("field"), F.regexp_extract(m, pattern, 2).alias("value"))
        )

    return logged.select("query_id", F.posexplode(F.concat(found(VALUE_FILTER), found(SIGN_FILTER))).alias("pos", "f")).select(
        "query_id", "pos", "f.field", "f.value"
    )
