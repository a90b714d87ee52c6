from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from spendlens.operators import intents, sqllog, tagging
from spendlens.operators.filters import Slots
from spendlens.plans import answers, questions

# (question, intent, selected slots) - FIXTURES.md section 4.
ROUTING = [
    ("How much did I spend on transportation?", 18, {"category": "Transportation"}),
    ("Show my Starbucks transactions.", 3, {"merchant": "starbucks"}),
    ("What did I spend in March 2025?", 18, {"year": 2025, "month": 3}),
    ("What are my top merchants?", 8, {}),
    ("How much income did I receive in 2026?", 12, {"year": 2026, "category": "Income"}),
    ("Compare January and February spending.", 4, {}),
    ("What is my largest expense category?", 5, {}),
    ("How many transactions do I have?", 11, {}),
    ("What did the Family profile spend on groceries?", 18, {"profile": "Family", "category": "Groceries"}),
    ("How much did I spend with TD?", 18, {"bank": "TD", "merchant": None}),
    ("How much did I spend on groceries last month?", 17, {"category": "Groceries"}),
    ("What are my top categories?", 9, {}),
    ("What is my average transaction amount?", 10, {}),
    ("What are my recurring payments?", 1, {}),
    ("How much did I spend by bank?", 13, {}),
    ("What did I spend by month?", 15, {}),
    ("How much did I save or invest?", 18, {"category": "Savings/Investments"}),
    ("What are the top expense categories?", 19, {}),
    ("Compare Student, Professional, and Family spending.", 7, {}),
    ("Which profile spent the most?", 6, {}),
]


@pytest.fixture(scope="module")
def tagged(spark):
    df = spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ROUTING)], "qid int, text string")
    return {r.qid: r for r in tagging.tag_questions(df, "text").collect()}


@pytest.mark.parametrize("i", range(len(ROUTING)))
def test_routing(tagged, i):
    q, intent, slots = ROUTING[i]
    row = tagged[i]
    assert row.intent == intent, q
    for k, v in slots.items():
        assert row[k] == v, (q, k)


def test_merchant_patterns(spark):
    qs = [
        "show coffee transactions",  # alias -> rejected by pattern 1; no pattern 2 match
        "how much did i spend at tim hortons in 2025",
        "spent from january to march",  # kept as the rule set reads it
        "paid at metro.",
    ]
    df = spark.createDataFrame([(q,) for q in qs], "text string")
    got = [r.merchant for r in tagging.tag_questions(df, "text").collect()]
    assert got == [None, "tim hortons", "january to march", "metro"]


def test_whole_word_aliases(spark):
    df = spark.createDataFrame([("tdbank stuff",), ("studentloan",), ("the may report",), ("march 2024",)], "text string")
    rows = tagging.tag_questions(df, "text").collect()
    assert rows[0].bank is None and rows[1].profile is None
    assert rows[2].month == 5 and rows[3].year == 2024 and rows[3].month == 3


def test_tag_sql_matches_spark(spark):
    import duckdb

    texts = [q for q, _, _ in ROUTING] + ["Éfamily école at café x", "with rbc for school?"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    srows = tagging.tag_questions(df, "text").select("text", "category", "bank", "profile", "year", "month", "merchant", "intent").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE q(text VARCHAR)")
    con.executemany("INSERT INTO q VALUES (?)", [(t,) for t in texts])
    tags = tagging.tag_sql("text")
    sql = "SELECT text, " + ", ".join(f"{v} AS {k}" for k, v in tags.items() if k in ("category", "bank", "profile", "year", "month", "merchant"))
    sql += f", {tagging.intent_sql('text', tags)} AS intent FROM q"
    drows = con.execute(sql).fetchall()
    assert sorted(tuple(r) for r in srows) == sorted(drows)


def test_intents_on_fixture(txn):
    res = intents.average_amount(txn, Slots(category="Groceries", year=2026)).first()
    assert res.average_transaction_amount == 1.01 and res.transaction_count == 2  # 1.005 -> 1.01 half-up
    res = intents.slot_total(txn, Slots(merchant="STARBUCKS")).first()
    assert (res.total_spent, res.transaction_count) == (13.0, 2)
    res = intents.income_total(txn, Slots(year=2025)).first()
    assert (res.total_income, res.income_transactions) == (2000.0, 1)
    # Count ignores the sign filter and keeps the selected profile.
    assert intents.count_transactions(txn, Slots(), "Professional").first().transaction_count == 4
    res = intents.category_last_month(txn, Slots(category="Groceries"), as_of=dt.date(2025, 2, 10)).first()
    assert (res.total_spent, res.transaction_count) == (80.25, 2)
    res = intents.slot_total(txn, Slots(bank="Nope")).first()
    assert res.total_spent is None and res.transaction_count == 0
    top = intents.top_categories(txn, Slots()).collect()
    assert [r.category for r in top] == ["Groceries", "Subscriptions", "Coffee"]


def test_half_up_average(spark):
    from spendlens.functions.money import avg_abs_2

    df = spark.createDataFrame([(1, 2.00), (1, 2.01), (1, 2.02), (2, 1.00), (2, 1.01)], "g int, amount double")
    got = {r.g: r.a for r in df.groupBy("g").agg(avg_abs_2("amount").alias("a")).collect()}
    assert got == {1: 2.01, 2: 1.01}


BATCH = [q for q, _, _ in ROUTING] + [
    "What is my average spending at starbucks?",
    "How many transactions do I have with TD?",
    "How much income did I receive in 2024?",
    "How much did I spend with RBC in march?",
    "How much did I spend at metro?",
    "How much did I spend at nowhere shop?",
    "Show my metro transactions",
    "Show my nowhere transactions",
    "Show my e transactions in 2026",
    "What are my top 3 frequent subscription charges?",
    "What is my most frequent subscription in 2024?",
    "What are the top merchants for income deposits?",
    "Top merchants of Family in january 2025?",
    "Top categories with RBC",
    "Expenses by year for groceries",
    "Spending by month at metro",
    "How is my monthly spend with Scotiabank?",
    "How much went to coffee last month?",
    "What is my average salary?",
]
NAMES = {"total_spent": "total", "total_income": "total", "average_amount": "average", "average_transaction_amount": "average", "income_transactions": "transaction_count"}


@pytest.mark.parametrize("selected", [None, "Family"])
def test_batch_answers_equal_single_ones(spark, txn, selected):
    """Each question's rows are those of its intent, run by itself; the figures are the sums of these rows."""
    as_of = dt.date(2025, 2, 10)
    tagged = tagging.tag_questions(spark.createDataFrame(list(enumerate(BATCH)), "qid int, text string"), "text")
    rows = {}
    for r in questions.answer_rows(tagged, txn, ["qid"], selected, as_of).collect():
        rows.setdefault(r.qid, []).append(r)
    figures = {r.qid: r for r in questions.answer_batch(tagged, txn, ["qid"], selected, as_of).collect()}
    assert set(figures) == set(range(len(BATCH))) and len({r.intent for r in figures.values()}) >= 18
    for r in tagged.collect():
        slots = Slots(category=r.category, bank=r.bank, profile=r.profile, year=r.year, month=r.month, merchant=r.merchant, income=r.is_income, top3=r.top3)
        result = intents.run_intent(txn, r.intent, slots, selected, as_of)
        columns = [NAMES.get(c, c) for c in result.columns]
        want = [tuple(x) for x in result.collect()]
        got = [tuple(x[c] for c in columns) for x in sorted(rows.get(r.qid, []), key=lambda x: x["rank"])]
        assert got == want, (r.text, got, want)
        f = figures[r.qid]
        sums = [sum(x[columns.index(c)] or 0 for x in want) if c in columns and want else None for c in ("total", "transaction_count")]
        assert f.rows_returned == len(want) and f.transaction_count == sums[1], r.text
        if r.intent == 10:
            assert f.value == want[0][0]
        elif sums[0] is not None and any(x[columns.index("total")] is not None for x in want):
            assert f.value == pytest.approx(sums[0])
        else:
            assert f.value is None


def test_batch_answers_without_questions(spark, txn):
    tagged = tagging.tag_questions(spark.createDataFrame([], "qid int, text string"), "text")
    assert questions.answer_rows(tagged, txn, ["qid"]).collect() == [] == questions.answer_batch(tagged, txn, ["qid"]).collect()


def test_answer_takes_the_guarded_statement_or_the_rules(spark, txn):
    replies = [
        ("How much did the Family profile spend with TD?", "SELECT SUM(amount) FROM transactions WHERE bank = 'td'", "guarded", True, 50.0, 1),  # corrected and completed
        ("How much did the Family profile spend with TD?", "SELECT 1 FROM transactions WHERE bank = 'TD' AND profile = 'Family' AND amount < 0", "guarded", True, 50.0, 1),  # the sign is always set anew
        ("Totals of TD", "SELECT 1 FROM transactions WHERE bank = 'TD'", "guarded", False, 2057.56, 6),
        ("Totals of TD", "SELECT 1 FROM transactions WHERE bank = 'TD' AND amount >= 0", "guarded", False, 2000.0, 2),
        ("Totals of TD", "DROP TABLE transactions", "rules", True, 57.56, 4),
        ("Totals of TD", None, "rules", False, 57.56, 4),
        ("Totals of TD", "SELECT 1 FROM transactions WHERE bank = 'TD' AND amount > 0 AND amount < 0", "rules", True, 57.56, 4),  # nothing left
        ("How much income did I receive in 2024?", "SELECT 1 FROM transactions WHERE bank = 'RBC'", "guarded", True, 2900.0, 2),  # an income question drops a bank it doesn't name
        ("What are my top merchants?", "no idea", "rules", True, 112.25, 7),
    ]
    frame = spark.createDataFrame([(f"q{i}", q, r) for i, (q, r, *_) in enumerate(replies)], "query_id string, question string, reply string")
    got = {r.query_id: r for r in answers.answer(frame, txn).collect()}
    for i, (question, reply, branch, adjusted, value, n) in enumerate(replies):
        r = got[f"q{i}"]
        assert (r.branch, r.adjusted, r.transaction_count) == (branch, adjusted, n), (question, reply, r)
        assert r.value == pytest.approx(value), (question, reply, r)
    assert len(got) == len(replies)


def test_sqllog(spark):
    replies = [
        "Here you go:\n```sql\nSELECT * FROM transactions;\n```\nThanks",
        "SELECT 1; SELECT 2",
        "DELETE FROM transactions",
        "SELECT * FROM transactions WHERE merchant = 'update'",
        "",
        "sure: select merchant from transactions",
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, text string")
    out = sqllog.sqllog_validate(sqllog.sqllog_clean(df, "text"), "sql").orderBy("i").collect()
    assert [r.sql for r in out] == [
        "SELECT * FROM transactions;",
        "SELECT 1;",
        "DELETE FROM transactions;",
        "SELECT * FROM transactions WHERE merchant = 'update';",
        "",
        "select merchant from transactions;",
    ]
    assert [r.status for r in out] == ["ok", "ok", "not_select", "forbidden", "empty", "ok"]
    assert out[3].forbidden_word == "update"


def test_guards(spark, txn):
    from spendlens.operators import guards

    tags = spark.createDataFrame(
        [("q1", "Family", None, "Groceries", False, True), ("q2", None, None, "Income", True, False)],
        "query_id string, profile string, bank string, category string, is_income boolean, is_spending boolean",
    )
    proposed = spark.createDataFrame(
        [("q1", "category", "groceries"), ("q1", "bank", "RBC"), ("q1", "profile", "Familly"),
         ("q2", "category", "Income"), ("q2", "bank", "TD")],
        "query_id string, field string, value string",
    )
    sql = spark.createDataFrame([("q1", "SELECT 1 FROM t WHERE profile = 'Student' AND Amount <= 0")], "query_id string, sql string")
    found = guards.proposed_filters_from_sql(sql)
    assert [(r.field, r.value) for r in found.orderBy("pos").collect()] == [("profile", "Student"), ("amount", "<= 0")]
    acts = guards.guard_filters(found, tags, guards.value_domains(txn).unionByName(
        spark.createDataFrame([("profile", "student", "Student")], "field string, lookup string, canonical string")))
    assert {(r.field, r.action) for r in acts.collect()} == {("profile", "keep"), ("amount", "remove")}
    added = guards.guard_required(tags.where("query_id = 'q1'"), acts.where("action <> 'remove'"))
    assert ("profile", "Family") in {(r.field, r.value) for r in added.collect()}
    domains = guards.value_domains(txn)
    acts = {(r.query_id, r.field): (r.action, r.new_value) for r in guards.guard_filters(proposed, tags, domains).collect()}
    assert acts == {
        ("q1", "category"): ("replace", "Groceries"),
        ("q1", "bank"): ("remove", None),
        ("q1", "profile"): ("remove", None),
        ("q2", "category"): ("keep", None),
        ("q2", "bank"): ("remove", None),
    }
    sel = {(r.query_id, r.field): (r.action, r.new_value)
           for r in guards.guard_filters(proposed, tags, domains, "Student").collect()}
    assert sel[("q1", "profile")] == ("replace", "Student")
    actions = guards.guard_filters(proposed, tags, domains)
    req = guards.guard_required(tags, actions.where(F.col("action") != "remove"))
    assert sorted(tuple(r) for r in req.collect()) == [
        ("q1", "amount", "<", "0"), ("q1", "profile", "=", "Family"), ("q2", "amount", ">", "0")
    ]
    adj = {r.query_id: r.adjusted for r in guards.guard_adjusted(actions, req, tags).collect()}
    assert adj == {"q1": True, "q2": True}


def test_month_filter_with_year_span_is_the_same_filter(txn):
    from spendlens.operators import filters

    for months in ([1], [2, 3], [12]):
        plain = filters.apply(txn, filters.flt_months_in(months)).collect()
        ranged = filters.apply(txn, filters.flt_months_in(months, (2024, 2026))).collect()
        assert sorted(plain) == sorted(ranged)
    with_span = intents.slot_total(txn, Slots(month=1, years=(2024, 2026))).first()
    without = intents.slot_total(txn, Slots(month=1)).first()
    assert with_span == without


def test_asked_questions_reach_every_rule(spark):
    """What the registered tagging, reply and guard keys run on holds a case of everything they tell apart."""
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL

    def values(key, column):
        return {r[0] for r in E.queries()[key](spark, SF_SMALL).select(column).distinct().collect()}

    assert values("q_intent", "intent") == set(range(1, 20))
    for key, column in (("q_bank", "bank"), ("q_profile", "profile"), ("q_year", "year"), ("q_month", "month"), ("q_category", "category")):
        assert len(values(key, column) - {None}) >= 3, key
    for key in ("is_income", "is_income_detail", "is_spending", "is_listing"):
        assert values(f"q_{key}", key) == {True, False}
    assert values("sqllog_validate", "status") == {"ok", "empty", "not_select", "forbidden"}
    for suffix in ("", "_no_profile"):
        assert values(f"guard_filters{suffix}", "action") == {"keep", "replace", "remove"}
        assert values(f"guard_required{suffix}", "field") == {"amount", "profile", "bank", "category"}
        assert values(f"guard_adjusted{suffix}", "adjusted") == {True, False} or not suffix
    answered = E.queries()["q_batch_totals"](spark, SF_SMALL).collect()
    for intent in range(1, 20):
        mine = [r for r in answered if r.intent == intent]
        assert any(r.rows_returned > 0 for r in mine) and (intent in (3, 4, 5) or any(r.transaction_count for r in mine)) and (intent in (1, 3, 11) or any(r.value for r in mine)), intent
    for suffix in ("", "_selected"):
        assert values(f"answer{suffix}", "branch") == {"guarded", "rules"}
