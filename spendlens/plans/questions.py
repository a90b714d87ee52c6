"""Answering a table of questions in one job: all 19 intents.

Questions are tagged (slots + intent) as column expressions. Questions that ask for the same thing share a *cell*:
the kind of answer, the sign and the slot values. Cells are answered, not questions:

1. The intents without slots (#1, 4, 5, 6, 7, 13, 14, 19) give one result each for all questions; they run as they do
   for a single question.
2. Transactions are pre-aggregated once to (category, bank, profile, year, month, sign) with exact decimal measures,
   and, for the merchant lists (#2, 8) and merchant terms, once more with the merchant.
3. A row of that grain goes to the slot patterns that occur among the cells (at most 32 a kind, the only value list
   brought to the driver): the slots that a pattern leaves open become NULL, and a null-safe equi-join finds the cell. What no
   question asks for is dropped there, before the shuffle that sums each cell by its group columns.
4. Ranked lists keep the best rows of each cell (k <= 50) by a limited row number, which Spark also applies before the
   shuffle: a cell over all merchants costs k rows from each task.
5. Merchant terms (case-insensitive substrings) are matched to merchants exactly through an n-gram candidate join -
   each term joins the merchant gram index on its rarest gram, then ``contains`` verifies. No cap on matches.
6. Questions join their cell's rows or figures. A hot cell is small on the other side; AQE's skew-join handling
   splits the question side.

The tagged slots and the cells are written (shared folder) once.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlens.functions.money import MONEY, exact_sum, float_sum, half_up_mean, money_sum
from spendlens.functions.vocab import DEFAULT, Vocabulary
from spendlens.operators.filters import ALL, flt_last_month
from spendlens.operators.intents import run_intent
from spendlens.operators.tagging import tag_questions
from spendlens.sources.table import written

DIMS = ["category", "bank", "profile", "year", "month"]
FIXED = (1, 4, 5, 6, 7, 13, 14, 19)  # intents that ignore slots
TOTALS = (10, 11, 12, 18)  # one row of figures; their cells are of kind 0, those of other intents of the intent's number
BY_MERCHANT, BY_OTHER, LAST_MONTH, LATEST = (2, 8), (9, 15, 16), 17, 3
MOST = {2: 3, 8: 10, 9: 10}  # rows of a ranked list (of #2 three or one)
MOST_ROWS = 50  # of #3
#: The columns of an answer's rows; those that an intent's result doesn't have are NULL.
ROW = {
    "rank": "int", "date": "date", "month": "string", "year": "string", "merchant": "string", "description": "string", "category": "string",
    "profile": "string", "bank": "string", "amount": "double", "total": "double", "average": "double", "transaction_count": "bigint",
}
TX = ["date", "merchant", "description", "amount", "category", "profile", "bank"]


def base_grain(transactions: DataFrame, *more: Column) -> DataFrame:
    keys = [
        "category",
        "bank",
        "profile",
        F.year("date").alias("year"),
        F.month("date").alias("month"),
        F.signum("amount").cast("int").alias("sign"),
    ]
    return transactions.groupBy(*keys, *more).agg(
        F.count(F.lit(1)).alias("n"),
        money_sum(F.abs("amount")).alias("s_abs"),
        money_sum("amount").alias("s_amt"),
        float_sum(F.abs("amount")).alias("f_abs"),
        float_sum("amount").alias("f_amt"),
    )


def question_slots(tagged: DataFrame, key_cols: list[str], selected_profile: str | None = None) -> DataFrame:
    """Questions with what their cell depends on: kind, want (sign), the slots as filter keys, mask (which are set)."""
    sel = None if not selected_profile or selected_profile == ALL else selected_profile
    intent = F.col("intent")
    fixed, last = intent.isin(*FIXED), intent == LAST_MONTH
    income = F.coalesce("is_income", F.lit(False))
    kind = F.when(intent.isin(*TOTALS), 0).otherwise(intent)
    slot = lambda c: F.when(~fixed & ~last, F.col(c))
    category = F.when(last, F.col("category")).otherwise(F.when(F.col("category") != "Income", slot("category")))
    profile = slot("profile").cast("string")
    out = tagged.select(
        *key_cols, "intent", income.alias("is_income"), F.coalesce("top3", F.lit(False)).alias("top3"), kind.cast("int").alias("kind"),
        F.when(fixed | (kind == 0), None).when(income & ~last, 1).otherwise(-1).cast("int").alias("want"),
        category.cast("string").alias("category"), slot("bank").cast("string").alias("bank"),
        (F.when(~fixed, F.coalesce(profile, F.lit(sel))) if sel else profile).alias("profile"),
        *[slot(c).cast("int").alias(c) for c in ("year", "month")], slot("merchant").cast("string").alias("term"),
    )
    return out.withColumn("mask", _mask())


def _mask() -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(DIMS)])


CELL = ["kind", "want", *DIMS, "term", "mask"]


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in cols])


def gram_matches(terms: DataFrame, merchants: DataFrame, max_k: int = 3) -> DataFrame:
    """Exact (term, merchant_l) pairs with merchant_l containing term.

    terms: column ``term`` (lower case, non-empty); merchants: ``merchant_l``.
    Each term uses grams of length k = min(max_k, len(term)); a merchant can
    contain the term only if it contains every gram of it, so joining on the
    term's least frequent gram and then checking ``contains`` is exact.
    """
    t = terms.select("term").distinct().withColumn("k", F.least(F.length("term"), F.lit(max_k)))
    t_grams = t.select(
        "term", "k",
        F.explode(F.expr("transform(sequence(1, length(term) - k + 1), i -> substring(term, i, k))")).alias("gram"),
    ).distinct()
    m = merchants.select("merchant_l").distinct()
    # Merchant grams are exploded map-side and immediately cut to the grams that
    # occur in some term (a semi-join against the small term-gram set), so only
    # relevant grams are shuffled, counted and joined.
    m_grams = (
        m.withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(1, max_k + 1)])))
        .where(F.length("merchant_l") >= F.col("k"))
        .select(
            "merchant_l", "k",
            F.explode(F.expr("transform(sequence(1, length(merchant_l) - k + 1), i -> substring(merchant_l, i, k))")).alias("gram"),
        )
        .join(t_grams.select("k", "gram").distinct(), ["k", "gram"], "left_semi")
        .distinct()
    )
    freq = m_grams.groupBy("k", "gram").agg(F.count(F.lit(1)).alias("f"))
    rarest = (
        t_grams.join(freq, ["k", "gram"], "left")
        .groupBy("term", "k")
        .agg(F.min_by("gram", F.struct(F.coalesce("f", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    return (
        rarest.join(m_grams, ["k", "gram"])
        .where(F.col("merchant_l").contains(F.col("term")))
        .select("term", "merchant_l")
    )


def _to_cells(rows: DataFrame, cells: DataFrame, sets: list[tuple[int, int]] | None, carry: list[str]) -> DataFrame:
    """(cell, kind, carry...): each row for every cell that it belongs to. Without ``sets``, the rows of each term go to
    that term's sets; ``rows`` have DIMS, sign and carry, and with terms ``term``."""
    if sets is None:
        own = cells.where("term is not null").groupBy("term").agg(F.collect_set(F.struct("kind", "mask")).alias("sets"))  # at most 32 a kind
        rows = rows.join(own, "term").withColumn("set", F.explode("sets"))
        cells = cells.where("term is not null")
    else:
        rows = rows.withColumn("set", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(m).alias("mask")) for k, m in sets])))
        cells = cells.where("term is null")
    held = [F.when(F.col("set.mask").bitwiseAND(F.lit(1 << i)) != 0, F.col(c)).alias(f"_{c}") for i, c in enumerate(DIMS)]
    want = F.when(F.col("set.kind") != 0, F.col("sign")).alias("_want")
    rows = rows.select(*held, want, F.col("set.kind").alias("_kind"), F.col("set.mask").alias("_mask"), *([F.col("term").alias("_term")] if sets is None else []), *[F.col(c).alias(f"r_{c}") for c in carry])
    names = [c for c in CELL if c != "term" or sets is None]
    on = reduce(lambda a, b: a & b, [rows[f"_{c}"].eqNullSafe(cells[c]) for c in names])
    return rows.join(cells.select("cell", *names), on).select("cell", F.col("_kind").alias("kind"), *[F.col(f"r_{c}").alias(c) for c in carry])


MEASURES = ["n", "s_abs", "s_amt", "f_abs", "f_amt"]  # exact decimal sums, NULL where only doubles hold them


def _all_exact(c: str) -> Column:
    """Aggregate: sum of exact sums, NULL if one of them is missing."""
    return F.when(F.count(c) == F.count(F.lit(1)), F.try_sum(c)).alias(c)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell", "kind", "g1", "g2").agg(
        F.sum("n").alias("n"), _all_exact("s_abs"), _all_exact("s_amt"), F.sum("f_abs").alias("f_abs"), F.sum("f_amt").alias("f_amt")
    )


def _grouped(base: DataFrame) -> DataFrame:
    """The base grain with the group columns of every kind (g1, g2 as text) beside the measures."""
    month = F.concat_ws("-", F.lpad(F.col("year").cast("string"), 4, "0"), F.lpad(F.col("month").cast("string"), 2, "0"))
    return base.withColumns({"g_month": month, "g_category": F.col("category"), "g_sign": F.col("sign").cast("string")})


def _labelled(rows: DataFrame, merchants: bool) -> DataFrame:
    kind = F.col("kind")
    g1 = F.when(kind == 0, F.col("g_sign")).when(kind == 9, F.col("g_category")).when(kind == 15, F.col("g_month")).when(kind == 16, F.substring("g_month", 1, 4))
    if merchants:
        g1 = F.when(kind.isin(*BY_MERCHANT), F.col("merchant")).otherwise(g1)
        return rows.select("cell", "kind", g1.alias("g1"), F.when(kind.isin(*BY_MERCHANT), F.col("g_category")).alias("g2"), *MEASURES)
    return rows.select("cell", "kind", g1.alias("g1"), F.lit(None).cast("string").alias("g2"), *MEASURES)


def _union(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionByName, parts) if parts else None


def _row_columns(rows: DataFrame, keys: list[str], **given: Column) -> DataFrame:
    return rows.select(*keys, *[given.get(c, F.lit(None)).cast(t).alias(c) for c, t in ROW.items()])


class Batch:
    """The cells of a question table and their answers, as lazily computed DataFrames."""

    def __init__(self, tagged: DataFrame, transactions: DataFrame, key_cols: list[str], selected_profile: str | None = None, as_of: dt.date | None = None):
        self.key_cols, self.selected, self.as_of, self.tx = key_cols, selected_profile, as_of or dt.date.today(), transactions
        self._matches: DataFrame | None = None
        # Tagging (regex over whole texts) runs once, and a lost executor does not re-tag the question table.
        slots = written(question_slots(tagged, key_cols, selected_profile), "slots")
        fixed = F.col("kind").isin(*FIXED)
        self.cells = written(slots.where(~fixed).select(*CELL).distinct().withColumn("cell", F.monotonically_increasing_id()), "cells")
        kinds = self.cells.select("kind", "mask", F.col("term").isNotNull().alias("with_term")).distinct().collect()  # 32 a kind at most, twice
        self.sets = {(r["kind"], r["mask"], r["with_term"]) for r in kinds}
        self.fixed = [r["kind"] for r in slots.where(fixed).select("kind").distinct().collect()]
        self.questions = slots.join(self.cells, _null_safe_on(slots, self.cells, CELL), "left").select(*[slots[c] for c in (*key_cols, "intent", "is_income", "top3", "kind")], "cell")

    def _of(self, *kinds: int) -> list[tuple[int, int]]:
        return sorted((k, m) for k, m, with_term in self.sets if k in kinds and not with_term)

    def _sums(self) -> DataFrame | None:
        """cell, kind, g1, g2 and measures: totals by sign, lists by their group columns."""
        parts = []
        if sets := self._of(0, *BY_OTHER):
            parts.append(_labelled(_to_cells(_grouped(base_grain(self.tx)), self.cells, sets, ["g_month", "g_category", "g_sign", *MEASURES]), False))
        if sets := self._of(*BY_MERCHANT):
            parts.append(_labelled(_to_cells(_grouped(base_grain(self.tx, F.col("merchant"))), self.cells, sets, ["g_month", "g_category", "g_sign", "merchant", *MEASURES]), True))
        terms = self.cells.where(F.col("term").isNotNull() & (F.col("kind") != LATEST))
        if any(with_term and kind != LATEST for kind, _, with_term in self.sets):
            rows = base_grain(self._matching(terms), F.col("merchant")).withColumn("merchant_l", F.lower("merchant"))
            rows = _grouped(rows).join(self._of_terms(terms), "merchant_l")
            parts.append(_labelled(_to_cells(rows, terms, None, ["g_month", "g_category", "g_sign", "merchant", *MEASURES]), True))
        if sets := self._of(LAST_MONTH):
            parts.append(_labelled(_to_cells(_grouped(base_grain(self.tx.where(flt_last_month(self.as_of)))), self.cells, sets, ["g_month", "g_category", "g_sign", *MEASURES]), False))
        found = _union(parts)
        return None if found is None else _summed(found)

    def _of_terms(self, terms: DataFrame) -> DataFrame:
        """(term, merchant_l) for these cells' terms; the matches of all terms are found once."""
        if self._matches is None:
            every = self.cells.where("term is not null").select("term")
            self._matches = written(gram_matches(every, self.tx.select(F.lower("merchant").alias("merchant_l")).distinct()), "matches")
        return self._matches.join(terms.select("term").distinct(), "term", "left_semi")

    def _matching(self, terms: DataFrame) -> DataFrame:
        """The transactions of merchants that some term matches."""
        matched = self._of_terms(terms).select("merchant_l").distinct()
        return self.tx.join(matched, F.lower(self.tx["merchant"]) == matched["merchant_l"], "left_semi")

    def totals(self, sums: DataFrame) -> DataFrame:
        """cell, n_all, pos, neg: the figures of each total cell by sign (structs of n, exact and plain sums)."""
        figures = F.struct("n", "s_abs", "s_amt", "f_abs", "f_amt")
        own = sums.where("kind = 0").groupBy("cell")
        return own.agg(F.sum("n").alias("n_all"), F.max(F.when(F.col("g1") == "1", figures)).alias("pos"), F.max(F.when(F.col("g1") == "-1", figures)).alias("neg"))

    def lists(self, sums: DataFrame | None) -> DataFrame | None:
        """cell, kind and the answer's columns: the rows of the list cells."""
        parts = []
        total = F.coalesce(F.round("s_abs", 2).cast("double"), F.round("f_abs", 2))
        kind = F.col("kind")
        if sums is not None:
            rows = sums.where(kind != 0).withColumn("total", total)
            ranked = Window.partitionBy("cell").orderBy(F.when(kind == 2, F.col("n")).desc(), F.desc("total"), "g1", "g2")
            best = rows.where(kind.isin(*MOST)).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= max(MOST.values()))
            best = best.where(F.when(kind == 2, F.col("rank") <= MOST[2]).otherwise(True))
            parts.append(_row_columns(
                best, ["cell", "kind"], rank=F.col("rank"), merchant=F.when(kind != 9, F.col("g1")), category=F.coalesce("g2", "g1"),
                total=F.col("total"), transaction_count=F.col("n"),
            ))
            # One row a month or year of the calendar.
            spans = rows.where(kind.isin(15, 16)).withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("g1")))
            parts.append(_row_columns(
                spans, ["cell", "kind"], rank=F.col("rank"), month=F.when(kind == 15, F.col("g1")), year=F.when(kind == 16, F.col("g1")),
                total=F.col("total"), transaction_count=F.col("n"),
            ))
        if any(k == LATEST for k, _, _ in self.sets):
            terms = self.cells.where(F.col("kind") == LATEST)
            rows = self._matching(terms).withColumns({"merchant_l": F.lower("merchant"), "year": F.year("date"), "month": F.month("date"), "sign": F.signum("amount").cast("int")})
            rows = _to_cells(rows.join(self._of_terms(terms), "merchant_l"), terms, None, TX)
            newest = Window.partitionBy("cell").orderBy(F.desc("date"), *TX[1:])
            rows = rows.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= MOST_ROWS)
            parts.append(_row_columns(rows, ["cell", "kind"], rank=F.col("rank"), **{c: F.col(c) for c in TX}))
        return _union(parts)

    def fixed_rows(self) -> DataFrame | None:
        """intent and the answer's columns: the results that ignore slots."""
        names = {"total": "total_spent", "average": "average_amount"}
        parts = []
        for intent in self.fixed:
            result = run_intent(self.tx, intent, selected_profile=self.selected)
            order = {1: [F.desc("transaction_count"), F.desc("average_amount"), "merchant", "category"], 4: ["month", F.desc("total_spent"), "category"]}
            by = order.get(intent, [F.desc("total_spent"), result.columns[0]])
            # A result of a few rows (a limit, or one a profile, bank, or month and category): ranked in one task.
            result = result.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
            parts.append(_row_columns(result.withColumn("intent", F.lit(intent)), ["intent"], **{c: F.col(names.get(c, c)) for c in ROW if names.get(c, c) in result.columns}))
        return _union(parts)

    def _total_rows(self, totals: DataFrame) -> DataFrame:
        """The key columns, intent, and the one row of each total question."""
        q = self.questions.where("kind = 0").join(totals, "cell", "left")
        intent, want = F.col("intent"), F.when(F.col("is_income"), F.col("pos")).otherwise(F.col("neg"))
        n = F.when(intent == 11, F.col("n_all")).when(intent == 12, F.col("pos.n")).when(intent == 18, F.col("neg.n")).otherwise(want["n"])
        average = F.when(intent == 10, half_up_mean(want["s_abs"], want["f_abs"], want["n"]))
        total = (
            F.when(intent == 12, F.coalesce(F.round("pos.s_amt", 2).cast("double"), F.round("pos.f_amt", 2)))
            .when(intent == 18, F.coalesce(F.round("neg.s_abs", 2).cast("double"), F.round("neg.f_abs", 2)))
        )
        return _row_columns(q, [*self.key_cols, "intent"], rank=F.lit(1), total=total, average=average, transaction_count=F.coalesce(n, F.lit(0)))

    def _last_month_rows(self, sums: DataFrame) -> DataFrame:
        q = self.questions.where(F.col("kind") == LAST_MONTH).join(sums.where(F.col("kind") == LAST_MONTH).drop("kind"), "cell", "left")
        total = F.coalesce(F.round("s_abs", 2).cast("double"), F.round("f_abs", 2))
        return _row_columns(q, [*self.key_cols, "intent"], rank=F.lit(1), total=total, transaction_count=F.coalesce("n", F.lit(0)))

    def one_row_answers(self, sums: DataFrame | None) -> DataFrame:
        """The answers that always have one row: #10, 11, 12, 17, 18."""
        sums = self.questions.sparkSession.createDataFrame([], f"cell long, kind int, g1 string, n long, s_abs {MONEY.simpleString()}, s_amt {MONEY.simpleString()}, f_abs double, f_amt double") if sums is None else sums
        return self._total_rows(self.totals(sums)).unionByName(self._last_month_rows(sums))

    def rows(self) -> DataFrame:
        """(key_cols..., intent, ROW...): every row of every answer."""
        sums = self._sums()
        sums = None if sums is None else written(sums, "cell-sums")
        parts, keys = [self.one_row_answers(sums)], [*self.key_cols, "intent"]
        lists = self.lists(sums)
        if lists is not None:
            found = self.questions.join(lists.drop("kind"), "cell").where((F.col("intent") != 2) | F.col("top3") | (F.col("rank") == 1))
            parts.append(found.select(*keys, *ROW))
        fixed = self.fixed_rows()
        if fixed is not None:
            parts.append(self.questions.join(fixed, "intent").select(*keys, *ROW))
        return _union(parts)

    def figures(self) -> DataFrame:
        """(key_cols..., intent, value, transaction_count, rows_returned) for every question.

        value: the average (10), the income (12), else the sum of the result's total_spent; NULL where the result has none.
        """
        sums = self._sums()
        sums = None if sums is None else written(sums, "cell-sums")
        keys = [*self.key_cols, "intent"]
        figures = [F.round(exact_sum("total"), 2).alias("value"), F.sum("transaction_count").alias("transaction_count"), F.count(F.lit(1)).alias("rows_returned")]
        parts = [self.one_row_answers(sums).select(*keys, F.coalesce("total", "average").alias("value"), "transaction_count", F.lit(1).cast("bigint").alias("rows_returned"))]
        lists = self.lists(sums)
        if lists is not None:  # summed once a cell; the first row apart, for #2
            first = F.struct("total", "transaction_count")
            per_cell = lists.groupBy("cell").agg(*figures, F.max(F.when(F.col("rank") == 1, first)).alias("first"))
            q = self.questions.where(~F.col("kind").isin(0, LAST_MONTH, *FIXED)).join(per_cell, "cell", "left")
            one = (F.col("intent") == 2) & ~F.col("top3")
            pick = lambda c: F.when(one, F.col(f"first.{c}" if c != "value" else "first.total")).otherwise(F.col(c)).alias(c)
            returned = F.when(one, F.when(F.col("first").isNotNull(), 1).otherwise(0)).otherwise(F.coalesce("rows_returned", F.lit(0)))
            parts.append(q.select(*keys, pick("value"), pick("transaction_count"), returned.cast("bigint").alias("rows_returned")))
        else:
            q = self.questions.where(~F.col("kind").isin(0, LAST_MONTH, *FIXED))
            parts.append(q.select(*keys, F.lit(None).cast("double").alias("value"), F.lit(None).cast("bigint").alias("transaction_count"), F.lit(0).cast("bigint").alias("rows_returned")))
        q = self.questions.where(F.col("kind").isin(*FIXED))
        fixed = self.fixed_rows()
        if fixed is not None:
            per_intent = fixed.groupBy("intent").agg(*figures)
            parts.append(q.join(per_intent, "intent", "left").select(*keys, "value", "transaction_count", F.coalesce("rows_returned", F.lit(0)).cast("bigint").alias("rows_returned")))
        return _union(parts)


def answer_rows(tagged: DataFrame, transactions: DataFrame, key_cols: list[str], selected_profile: str | None = None, as_of: dt.date | None = None) -> DataFrame:
    """(key_cols..., intent, rank, date ... transaction_count): the result rows of every question."""
    return Batch(tagged, transactions, key_cols, selected_profile, as_of).rows()


def answer_batch(tagged: DataFrame, transactions: DataFrame, key_cols: list[str], selected_profile: str | None = None, as_of: dt.date | None = None) -> DataFrame:
    """(key_cols..., intent, value, transaction_count, rows_returned): the figures of every question's result."""
    return Batch(tagged, transactions, key_cols, selected_profile, as_of).figures()


def q_batch_totals(questions: DataFrame, transactions: DataFrame, text_col: str, key_cols: list[str], vocab: Vocabulary = DEFAULT, **options) -> DataFrame:
    return answer_batch(tag_questions(questions, text_col, vocab), transactions, key_cols, **options)


def batch_report(questions: DataFrame, transactions: DataFrame, text_col: str, key_cols: list[str], vocab: Vocabulary = DEFAULT, **options) -> DataFrame:
    """(question keys, intent, rows returned): the notebook's answer table."""
    return q_batch_totals(questions, transactions, text_col, key_cols, vocab, **options).select(*key_cols, "intent", "rows_returned")
