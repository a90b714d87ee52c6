"""Question in, result out, for a table of questions with logged replies.

A reply's statement is used where it is one safe SELECT: its profile, bank, category and sign filters go through the
guards (dropped, corrected, completed), and the answer is the total and count of what they leave, whatever else the
statement selects. A question falls back to the rules (``questions.answer_batch``) where there is no usable statement, or
where the guarded result is zero-like: no total, or a total of 0.

Questions with the same guarded filters share a cell, as in ``questions``: transactions are aggregated once, a cell's
figures are joined to its questions, and only the questions that fall back are answered by the rules.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.money import MONEY
from spendlens.functions.vocab import DEFAULT, Vocabulary
from spendlens.operators import guards, sqllog, tagging
from spendlens.operators.results import zero_like_row
from spendlens.plans.questions import CELL, MEASURES, _all_exact, _mask, _null_safe_on, _to_cells, answer_batch, base_grain
from spendlens.sources.table import written

SIGNS = {"neg": (-1, ["<", "<="]), "zero": (0, ["<=", ">="]), "pos": (1, [">", ">="])}


def guarded_filters(tags: DataFrame, actions: DataFrame, required: DataFrame) -> DataFrame:
    """One row per query: the value that each guarded column must have (or NULL), which signs of the amount are allowed,
    and ``never``, where two filters contradict each other."""
    kept = actions.where(F.col("action") != "remove").select("query_id", "field", F.coalesce("new_value", "value").alias("value"), F.regexp_extract("value", "^[<>]=?", 0).alias("op"))
    rows = kept.unionByName(required.select("query_id", "field", "value", "op"))
    rows = tags.select("query_id").distinct().join(rows, "query_id", "left")
    of = lambda f, v: F.when(F.col("field") == f, v)
    found = rows.groupBy("query_id").agg(
        *[F.min(of(f, F.col("value"))).alias(f) for f in guards.GUARDED],
        *[F.max(of(f, F.col("value"))).alias(f"other_{f}") for f in guards.GUARDED],
        *[F.coalesce(F.bool_and(of("amount", F.col("op").isin(ops))), F.lit(True)).alias(sign) for sign, (_, ops) in SIGNS.items()],
    )
    never = F.lit(False)
    for f in guards.GUARDED:
        never = never | F.coalesce(F.col(f) != F.col(f"other_{f}"), F.lit(False))
    return found.select("query_id", *guards.GUARDED, *SIGNS, never.alias("never"))


def guarded_figures(filters: DataFrame, transactions: DataFrame) -> DataFrame:
    """query_id, value, transaction_count: the total and count of the transactions that each query's filters leave."""
    slots = filters.where("not never").select("query_id", *SIGNS, F.lit(0).alias("kind"), F.lit(None).cast("int").alias("want"), "category", "bank", "profile", F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("month"), F.lit(None).cast("string").alias("term"))
    slots = written(slots.withColumn("mask", _mask()), "guarded")
    cells = written(slots.select(*CELL).distinct().withColumn("cell", F.monotonically_increasing_id()), "guarded-cells")
    masks = [(0, r["mask"]) for r in cells.select("mask").distinct().collect()]  # 8 at most: three columns
    if not masks:
        return filters.select("query_id", F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("transaction_count")).where("false")
    rows = _to_cells(base_grain(transactions), cells, masks, ["sign", *MEASURES])
    per_sign = rows.groupBy("cell", "sign").agg(F.sum("n").alias("n"), _all_exact("s_abs"), F.sum("f_abs").alias("f_abs"))
    figures = F.struct("n", "s_abs", "f_abs")
    per_cell = per_sign.groupBy("cell").agg(*[F.max(F.when(F.col("sign") == sign, figures)).alias(f"{name}_") for name, (sign, _) in SIGNS.items()])
    q = slots.join(cells, _null_safe_on(slots, cells, CELL)).select("query_id", *SIGNS, "cell").join(per_cell, "cell", "left")
    zero = {"n": "bigint", "s_abs": MONEY.simpleString(), "f_abs": "double"}

    def whole(c: str) -> Column:
        out = F.lit(0).cast(zero[c])
        for s in SIGNS:
            out = out + F.when(F.col(s), F.coalesce(F.col(f"{s}_.{c}"), F.lit(0).cast(zero[c]))).otherwise(F.lit(0).cast(zero[c]))
        return out

    inexact = F.lit(False)
    for s in SIGNS:
        inexact = inexact | (F.col(s) & F.col(f"{s}_.n").isNotNull() & F.col(f"{s}_.s_abs").isNull())
    total = F.when(inexact, F.round(whole("f_abs"), 2)).otherwise(F.round(whole("s_abs"), 2).cast("double"))
    return q.select("query_id", F.when(whole("n") > 0, total).alias("value"), whole("n").alias("transaction_count"))


def answer(question_replies: DataFrame, transactions: DataFrame, vocab: Vocabulary = DEFAULT, selected_profile: str | None = None, as_of: dt.date | None = None) -> DataFrame:
    """query_id, intent, branch (guarded or rules), adjusted, value, transaction_count, rows_returned.

    question_replies: query_id (unique), question, reply (NULL where the question has none: then the rules' answer is no
    adjustment, as nothing was proposed).
    """
    tagged = tagging.tag_questions(question_replies, "question", vocab)
    tags = tagged.select("query_id", "profile", "bank", "category", "is_income", "is_spending")
    logged = sqllog.sqllog_validate(sqllog.sqllog_clean(question_replies, "reply"), "sql")
    logged = written(logged.select("query_id", F.col("reply").isNotNull().alias("replied"), "sql", (F.col("status") == "ok").alias("usable")), "logged")
    actions = written(guards.guard_filters(guards.proposed_filters_from_sql(logged), tags, guards.value_domains(transactions), selected_profile), "actions")
    required = written(guards.guard_required(tags, actions.where(F.col("action") != "remove"), selected_profile), "required")
    filters = guarded_filters(tags, actions, required).join(logged.where("usable").select("query_id"), "query_id", "left_semi")
    guarded = guarded_figures(filters, transactions)
    chosen = logged.join(guarded, "query_id", "left").join(guards.guard_adjusted(actions, required, question_replies), "query_id", "left")
    chosen = chosen.withColumn("guarded", F.col("usable") & ~zero_like_row([F.col("value")]))
    chosen = written(chosen.select("query_id", "replied", "guarded", "adjusted", "value", "transaction_count"), "chosen")
    rest = tagged.join(chosen.where("not guarded").select("query_id"), "query_id", "left_semi")
    rules = answer_batch(rest, transactions, ["query_id"], selected_profile, as_of)
    rules = rules.select("query_id", F.lit("rules").alias("branch"), "value", "transaction_count", "rows_returned")
    own = chosen.where("guarded").select("query_id", F.lit("guarded").alias("branch"), "value", "transaction_count", F.lit(1).cast("bigint").alias("rows_returned"))
    intents = tagged.select("query_id", "intent")
    adjusted = F.col("replied") & (F.col("adjusted") | ~F.col("guarded"))
    return (
        intents.join(chosen.select("query_id", adjusted.alias("adjusted")), "query_id")
        .join(own.unionByName(rules), "query_id")
        .select("query_id", "intent", "branch", "adjusted", "value", "transaction_count", "rows_returned")
    )
