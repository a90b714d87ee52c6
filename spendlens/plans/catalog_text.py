"""Text-table queries: question tagging, logged-reply checks, guards, batch answers.

The question table is ``talk``: the driver's ``conversations`` (every turn, whole
text) and the questions and replies of ``sources.asked``. Each turn is tagged as a
question, and each reply that follows a user turn is the logged reply to it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from spendlens.functions.text import sql_str
from spendlens.functions.vocab import DEFAULT, TOP_THREE_PHRASES, binding_vocabulary
from spendlens.operators import filters, guards, sqllog, tagging
from spendlens.plans import answers, questions
from spendlens.plans.catalog import AS_OF, AVG_ABS, TOTAL_SPENT, register, txn
from spendlens.sources.asked import talk, with_talk
from spendlens.sources.binding import with_transactions

KEYS = ["conv_id", "turn"]
BIND_VOCAB = binding_vocabulary()


# --- 2.8 tagging ------------------------------------------------------------------------------

TAG_KEYS = {
    "q_category": "category",
    "q_bank": "bank",
    "q_profile": "profile",
    "q_year": "year",
    "q_month": "month",
    "q_merchant": "merchant",
    "q_is_income": "is_income",
    "q_is_income_detail": "is_income_detail",
    "q_is_spending": "is_spending",
    "q_is_listing": "is_listing",
}
_SQL_TAGS = tagging.tag_sql("text", DEFAULT)


def _tag_query(key: str, tag: str):
    @register(key, with_talk(f"SELECT conv_id, turn, {_SQL_TAGS[tag]} AS {tag} FROM talk"), raw_sql=True)
    def q(spark, sf_dir):
        return tagging.tag_questions(talk(spark, sf_dir), "text", DEFAULT).select(*KEYS, tag)

    return q


for _k, _t in TAG_KEYS.items():
    _tag_query(_k, _t)


@register("q_intent", with_talk(f"SELECT conv_id, turn, {tagging.intent_sql('text', _SQL_TAGS, DEFAULT)} AS intent FROM talk"), raw_sql=True)
def q_intent(spark, sf_dir):
    return tagging.tag_questions(talk(spark, sf_dir), "text", DEFAULT).select(*KEYS, "intent")


# --- 2.8 batch answers ----------------------------------------------------------------------------


def _batch_sql(vocab, select: str, selected: str | None = None, questions_from: str = "talk", keys: str = "conv_id, turn", text: str = "text") -> str:
    """``select`` over q (questions with the number ``rid`` of what they ask for) and res (rid, rank, result columns)."""
    tags = tagging.tag_sql(text, vocab)
    intent = tagging.intent_sql(text, tags, vocab)
    tag_cols = ", ".join(f"{v} AS {k}" for k, v in tags.items())
    top3 = " OR ".join(f"contains(lower({text}), {sql_str(w)})" for w in TOP_THREE_PHRASES)
    fixed, sel = "(1, 4, 5, 6, 7, 13, 14, 19)", "NULL" if selected is None else sql_str(selected)
    slot = lambda c: f"CASE WHEN intent NOT IN (1, 4, 5, 6, 7, 13, 14, 17, 19) THEN {c} END AS {c}"
    q = (
        f"SELECT {keys}, intent, CASE WHEN intent IN {fixed} OR intent = 17 THEN false ELSE is_income END AS is_income, intent = 2 AND ({top3}) AS top3,"
        " CASE WHEN intent = 17 THEN category WHEN intent NOT IN (1, 4, 5, 6, 7, 13, 14, 19) AND category <> 'Income' THEN category END AS category,"
        f" {slot('bank')}, COALESCE(CASE WHEN intent NOT IN {fixed} AND intent <> 17 THEN profile END, {sel}) AS profile, {slot('year')}, {slot('month')}, {slot('merchant')}"
        f" FROM (SELECT {keys}, {text}, {tag_cols}, {intent} AS intent FROM {questions_from}) t"
    )
    slots = "intent, is_income, top3, category, bank, profile, year, month, merchant"
    low, high = filters.month_bounds(AS_OF, "last month")
    m = (
        "SELECT s.rid, s.intent, s.is_income, s.top3, t.* FROM s JOIN transactions t ON (s.category IS NULL OR t.category = s.category)"
        " AND (s.bank IS NULL OR t.bank = s.bank) AND (s.profile IS NULL OR t.profile = s.profile) AND (s.year IS NULL OR year(t.date) = s.year)"
        " AND (s.month IS NULL OR month(t.date) = s.month) AND (s.merchant IS NULL OR contains(lower(t.merchant), s.merchant))"
        " AND CASE WHEN s.intent = 11 THEN true WHEN s.is_income THEN t.amount > 0 ELSE t.amount < 0 END"
        " AND (s.intent <> 4 OR month(t.date) IN (1, 2))"
        f" AND (s.intent <> 17 OR (t.date >= DATE '{low}' AND t.date < DATE '{high}'))"
    )
    keyed = (
        "SELECT rid, intent, any_value(top3) AS top3, CASE WHEN intent IN (4, 15) THEN strftime(date, '%Y-%m') END AS month, CASE WHEN intent = 16 THEN strftime(date, '%Y') END AS year,"
        " CASE WHEN intent IN (1, 2, 8) THEN merchant END AS merchant, CASE WHEN intent IN (1, 2, 4, 5, 8, 9, 19) THEN category END AS category,"
        " CASE WHEN intent IN (6, 7, 14) THEN profile END AS profile, CASE WHEN intent = 13 THEN bank END AS bank,"
        f" {TOTAL_SPENT} AS spent, {AVG_ABS} AS average, COUNT(*) AS n FROM m WHERE intent <> 3 GROUP BY ALL HAVING intent <> 1 OR COUNT(*) >= 6"
    )
    ranked = (
        "SELECT *, row_number() OVER (PARTITION BY rid ORDER BY COALESCE(month, year), CASE WHEN intent IN (1, 2) THEN n END DESC,"
        " CASE WHEN intent = 1 THEN average ELSE spent END DESC, merchant, category, profile, bank) AS rank FROM keyed"
    )
    newest = "date DESC, merchant, description, amount, category, profile, bank"
    res = (
        "SELECT rid, CAST(rank AS INTEGER) AS rank, CAST(NULL AS DATE) AS date, month, year, merchant, CAST(NULL AS VARCHAR) AS description, category, profile, bank, CAST(NULL AS DOUBLE) AS amount,"
        " CASE WHEN intent NOT IN (1, 10, 11) THEN spent END AS total, CASE WHEN intent IN (1, 10) THEN average END AS average,"
        " CASE WHEN intent NOT IN (4, 5) THEN n END AS transaction_count FROM ranked"
        " WHERE rank <= CASE WHEN intent = 1 THEN 20 WHEN top3 THEN 3 WHEN intent IN (2, 5, 6) THEN 1 WHEN intent IN (8, 9, 19) THEN 10 ELSE 1000000 END"
        " UNION ALL SELECT rid, 1, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM s"
        " WHERE intent IN (10, 11, 12, 17, 18) AND rid NOT IN (SELECT rid FROM keyed)"
        " UNION ALL SELECT rid, CAST(row_number() OVER (PARTITION BY rid ORDER BY " + newest + ") AS INTEGER) AS r, date, NULL, NULL, merchant, description, category, profile, bank, amount, NULL, NULL, NULL"
        " FROM m WHERE intent = 3 QUALIFY r <= 50"
    )
    return (
        f"q AS (SELECT *, dense_rank() OVER (ORDER BY {slots}) AS rid FROM ({q}) a), s AS (SELECT DISTINCT rid, {slots} FROM q), m AS ({m}), keyed AS ({keyed}),"
        f" ranked AS ({ranked}), res AS ({res}) {select}"
    )


def _batch(vocab, select: str) -> str:
    return with_talk(with_transactions("WITH " + _batch_sql(vocab, select), stored=True))


_FIGURES_SQL = (
    "SELECT conv_id, turn, intent, value, transaction_count, rows_returned FROM q JOIN (SELECT s.rid,"
    " COALESCE(CAST(SUM(CAST(total AS DECIMAL(18,2))) AS DOUBLE), CASE WHEN any_value(s.intent) = 10 THEN any_value(average) END) AS value,"
    " CAST(SUM(transaction_count) AS BIGINT) AS transaction_count, COUNT(res.rid) AS rows_returned FROM s LEFT JOIN res ON res.rid = s.rid GROUP BY s.rid) f USING (rid)"
)
_ROWS_SQL = (
    "SELECT conv_id, turn, intent, rank, date, res.month, res.year, res.merchant, description, res.category, res.profile, res.bank, amount, total, average, transaction_count"
    " FROM q JOIN res USING (rid)"
)


@register("q_batch_totals", _batch(BIND_VOCAB, _FIGURES_SQL), raw_sql=True)
def q_batch_totals(spark, sf_dir):
    return questions.q_batch_totals(talk(spark, sf_dir), txn(spark, sf_dir), "text", KEYS, BIND_VOCAB, as_of=AS_OF)


@register("q_batch_totals_default_vocab", _batch(DEFAULT, _FIGURES_SQL), raw_sql=True)
def q_batch_totals_default(spark, sf_dir):
    return questions.q_batch_totals(talk(spark, sf_dir), txn(spark, sf_dir), "text", KEYS, DEFAULT, as_of=AS_OF)


@register("q_batch_rows", _batch(BIND_VOCAB, _ROWS_SQL), raw_sql=True)
def q_batch_rows(spark, sf_dir):
    tagged = tagging.tag_questions(talk(spark, sf_dir), "text", BIND_VOCAB)
    return questions.answer_rows(tagged, txn(spark, sf_dir), KEYS, as_of=AS_OF)


@register("batch_report", _batch(BIND_VOCAB, f"SELECT conv_id, turn, intent, rows_returned FROM ({_FIGURES_SQL}) f"), raw_sql=True)
def q_batch_report(spark, sf_dir):
    return questions.batch_report(talk(spark, sf_dir), txn(spark, sf_dir), "text", KEYS, BIND_VOCAB, as_of=AS_OF)


# --- 2.9 logged replies ------------------------------------------------------------------------


@register("sqllog_clean", with_talk(f"SELECT conv_id, turn, {sqllog.clean_sql_sql('text')} AS sql FROM talk"), raw_sql=True)
def q_sqllog_clean(spark, sf_dir):
    return sqllog.sqllog_clean(talk(spark, sf_dir), "text").select(*KEYS, "sql")


_V = sqllog.validate_sql("sql")


@register(
    "sqllog_validate",
    with_talk(
        f"SELECT conv_id, turn, {_V['status']} AS status, {_V['forbidden_word']} AS forbidden_word"
        f" FROM (SELECT conv_id, turn, {sqllog.clean_sql_sql('text')} AS sql FROM talk)"
    ),
    raw_sql=True,
)
def q_sqllog_validate(spark, sf_dir):
    cleaned = sqllog.sqllog_clean(talk(spark, sf_dir), "text")
    return sqllog.sqllog_validate(cleaned, "sql").select(*KEYS, "status", "forbidden_word")


# --- 2.9 guards ----------------------------------------------------------------------------------


def _question_reply(spark, sf_dir):
    """A user turn (the question) and the reply that follows it in the same conversation."""
    conv = talk(spark, sf_dir)
    qs = conv.where(F.col("role") == "user").select(
        F.concat_ws(":", "conv_id", "turn").alias("query_id"), "conv_id", F.col("turn").alias("q_turn"), F.col("text").alias("question")
    )
    replies = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("q_turn"), F.col("text").alias("reply")
    )
    return qs.join(replies, ["conv_id", "q_turn"], "left")


def _guard_inputs(spark, sf_dir, vocab):
    qr = _question_reply(spark, sf_dir)
    tags = tagging.tag_questions(qr, "question", vocab).select("query_id", "profile", "bank", "category", "is_income", "is_spending")
    logged = sqllog.sqllog_clean(qr, "reply").select("query_id", "sql")
    proposed = guards.proposed_filters_from_sql(logged, "sql")
    return qr, tags, proposed


_QR_SQL = (
    "qr AS (SELECT CAST(u.conv_id AS VARCHAR) || ':' || CAST(u.turn AS VARCHAR) AS query_id, u.text AS question, a.text AS reply"
    " FROM talk u LEFT JOIN talk a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'"
    " WHERE u.role = 'user')"
)
_PROPOSED_SQL = f"lg AS (SELECT query_id, {sqllog.clean_sql_sql('reply')} AS sql FROM qr), pf AS (" + " UNION ALL ".join(
    f"SELECT query_id, lower(regexp_extract(m, {sql_str(p)}, 1)) AS field, regexp_extract(m, {sql_str(p)}, 2) AS value"
    f" FROM (SELECT query_id, unnest(regexp_extract_all(sql, {sql_str(p)}, 0)) AS m FROM lg)"
    for p in (guards.VALUE_FILTER, guards.SIGN_FILTER)
) + ")"
_BT = tagging.tag_sql("question", BIND_VOCAB)


def _guard_sql(select: str, selected: str | None, stored: bool = False) -> str:
    sel = None if selected is None else sql_str(selected)
    valid = "canonical" if sel is None else f"CASE WHEN field = 'profile' THEN {sel} ELSE canonical END"
    allow = "mentioned IS NOT NULL" if sel is None else "(mentioned IS NOT NULL OR field = 'profile')"
    profile = "profile FROM t WHERE profile IS NOT NULL" if sel is None else f"{sel} FROM t"
    only = " AND (c.field <> 'profile' OR lower(COALESCE(k.new_value, k.value)) = lower(c.value))" if sel is None else ""
    return with_talk(with_transactions(
        f"WITH {_QR_SQL}, {_PROPOSED_SQL},"
        f" t AS (SELECT query_id, {_BT['profile']} AS profile, {_BT['bank']} AS bank, {_BT['category']} AS category,"
        f" {_BT['is_income']} AS is_income, {_BT['is_spending']} AS is_spending FROM qr),"
        " d AS (SELECT field, lower(v) AS lookup, max(v) AS canonical FROM (SELECT 'profile' AS field, profile AS v FROM transactions"
        " UNION SELECT 'bank', bank FROM transactions UNION SELECT 'category', category FROM transactions) GROUP BY 1, 2),"
        " j AS (SELECT pf.query_id, pf.field, pf.value, d.canonical, t.profile, t.bank, t.category, COALESCE(t.is_income, false) AS is_income,"
        " COALESCE(t.is_spending, false) AS is_spending FROM pf"
        " LEFT JOIN t ON t.query_id = pf.query_id LEFT JOIN d ON d.field = pf.field AND d.lookup = lower(pf.value)),"
        f" a AS (SELECT *, CASE field WHEN 'profile' THEN profile WHEN 'bank' THEN bank ELSE category END AS mentioned, {valid} AS valid FROM j),"
        f" b AS (SELECT *, ({allow} AND NOT (field IN ('bank', 'category') AND is_income AND mentioned IS NULL)) AS allow FROM a),"
        " act AS (SELECT query_id, field, value, CASE WHEN field = 'amount' THEN CASE WHEN is_income OR is_spending THEN 'remove' ELSE 'keep' END"
        " WHEN NOT allow OR valid IS NULL THEN 'remove' WHEN value <> valid THEN 'replace' ELSE 'keep' END AS action,"
        " CASE WHEN field <> 'amount' AND allow AND value <> valid THEN valid END AS new_value FROM b),"
        " cand AS (SELECT query_id, 'amount' AS field, '>' AS op, '0' AS value FROM t WHERE is_income"
        " UNION ALL SELECT query_id, 'amount', '<', '0' FROM t WHERE NOT is_income AND is_spending"
        f" UNION ALL SELECT query_id, 'profile', '=', {profile}"
        " UNION ALL SELECT query_id, 'bank', '=', bank FROM t WHERE bank IS NOT NULL"
        " UNION ALL SELECT query_id, 'category', '=', category FROM t WHERE category IS NOT NULL AND category <> 'Income' AND NOT is_income),"
        " req AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM act k WHERE k.action <> 'remove' AND k.query_id = c.query_id"
        f" AND k.field = c.field{only})) {select}",
        stored,
    ))


def _guarded(spark, sf_dir, selected):
    """(question-reply rows, filter actions, filters to add) for a selected profile or none."""
    qr, tags, proposed = _guard_inputs(spark, sf_dir, BIND_VOCAB)
    actions = guards.guard_filters(proposed, tags, guards.value_domains(txn(spark, sf_dir)), selected)
    return qr, actions, guards.guard_required(tags, actions.where(F.col("action") != "remove"), selected)


_ADJUSTED = (
    "SELECT query_id, query_id IN (SELECT query_id FROM act WHERE action <> 'keep'"
    " UNION SELECT query_id FROM req) AS adjusted FROM (SELECT DISTINCT query_id FROM qr)"
)


def _guard_queries(suffix: str, selected: str | None):
    @register(f"guard_filters{suffix}", _guard_sql("SELECT * FROM act", selected), raw_sql=True)
    def filters(spark, sf_dir):
        return _guarded(spark, sf_dir, selected)[1]

    @register(f"guard_required{suffix}", _guard_sql("SELECT * FROM req", selected), raw_sql=True)
    def required(spark, sf_dir):
        return _guarded(spark, sf_dir, selected)[2]

    @register(f"guard_adjusted{suffix}", _guard_sql(_ADJUSTED, selected), raw_sql=True)
    def adjusted(spark, sf_dir):
        qr, actions, required_ = _guarded(spark, sf_dir, selected)
        return guards.guard_adjusted(actions, required_, qr)


# --- question in, result out -------------------------------------------------------------------------


def _answer_sql(selected: str | None) -> str:
    same = " AND ".join(f"(gs.{f} IS NULL OR t.{f} = gs.{f})" for f in guards.GUARDED)
    one = ", ".join(f"min(value) FILTER (WHERE field = '{f}') AS {f}, max(value) FILTER (WHERE field = '{f}') AS {f}2" for f in guards.GUARDED)
    signs = ", ".join(
        f"COALESCE(bool_and(op IN ({', '.join(map(sql_str, ops))})) FILTER (WHERE field = 'amount'), true) AS {s}" for s, (_, ops) in answers.SIGNS.items()
    )
    select = (
        "SELECT o.query_id, o.intent, CASE WHEN o.guarded THEN 'guarded' ELSE 'rules' END AS branch, o.replied AND (o.adjusted OR NOT o.guarded) AS adjusted,"
        " CASE WHEN o.guarded THEN o.value ELSE f.value END AS value, CASE WHEN o.guarded THEN o.n ELSE f.transaction_count END AS transaction_count,"
        " CASE WHEN o.guarded THEN 1 ELSE f.rows_returned END AS rows_returned FROM o JOIN f USING (query_id)"
    )
    figures = _FIGURES_SQL.replace("conv_id, turn", "query_id")
    return _guard_sql(
        f", st AS (SELECT query_id, {_V['status']} = 'ok' AS usable FROM lg), adj AS ({_ADJUSTED}),"
        " flt AS (SELECT query_id, field, COALESCE(new_value, value) AS value, regexp_extract(value, '^[<>]=?') AS op FROM act WHERE action <> 'remove'"
        " UNION ALL SELECT query_id, field, value, op FROM req),"
        f" g AS (SELECT qr.query_id, {one}, {signs} FROM qr LEFT JOIN flt ON flt.query_id = qr.query_id GROUP BY 1),"
        " gk AS (SELECT *, dense_rank() OVER (ORDER BY profile, bank, category, neg, zero, pos) AS gid FROM g"
        " WHERE profile IS NOT DISTINCT FROM profile2 AND bank IS NOT DISTINCT FROM bank2 AND category IS NOT DISTINCT FROM category2),"
        f" gf AS (SELECT gs.gid, {TOTAL_SPENT} AS value, COUNT(*) AS n FROM (SELECT DISTINCT gid, profile, bank, category, neg, zero, pos FROM gk) gs JOIN transactions t"
        f" ON {same} AND ((gs.neg AND t.amount < 0) OR (gs.zero AND t.amount = 0) OR (gs.pos AND t.amount > 0)) GROUP BY 1), "
        + _batch_sql(BIND_VOCAB, "", selected, "qr", "query_id", "question")
        + f", f AS ({figures}), o AS (SELECT q.query_id, q.intent, qr.reply IS NOT NULL AS replied, adj.adjusted, gf.value, gf.n,"
        " st.usable AND COALESCE(gf.value, 0) <> 0 AS guarded FROM q JOIN qr USING (query_id) JOIN st USING (query_id) JOIN adj USING (query_id)"
        f" LEFT JOIN gk USING (query_id) LEFT JOIN gf USING (gid)) {select}",
        selected,
        stored=True,
    )


def _answer_query(suffix: str, selected: str | None):
    @register(f"answer{suffix}", _answer_sql(selected), raw_sql=True)
    def q(spark, sf_dir):
        return answers.answer(_question_reply(spark, sf_dir), txn(spark, sf_dir), BIND_VOCAB, selected, AS_OF)


_answer_query("", None)
_answer_query("_selected", "BUILDING")
_guard_queries("", "BUILDING")
_guard_queries("_no_profile", None)
