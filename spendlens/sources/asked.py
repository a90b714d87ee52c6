"""Fixture: questions about the bound transactions and logged replies to them, from the driver tables.

The driver's ``conversations`` hold invented prose in which nobody asks about money. So every customer also asks two
questions, one in the words of the bound tables and one in those of the default vocabulary, and each gets a logged
reply. Which phrase a customer uses follows from the key; region, segment and part type fill it in. The phrases reach
all 19 intents, and the replies every status and guard action. One SQL text serves both engines.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from spendlens.functions.text import sql_str
from spendlens.functions.vocab import BANK_ALIASES, CATEGORY_ALIASES, MONTH_NAMES, PROFILE_ALIASES, YEARS
from spendlens.sources.binding import read_table, table_path
from spendlens.sources.table import fingerprint, path_exists, tables_root

TABLES = ("customer", "nation", "region", "part")

QUESTIONS = [
    "Show my recurring payments",
    "What are my top 3 frequent subscription charges?",
    "Show my <shop> transactions",
    "Compare january and february spending",
    "What is my largest category in <yr>?",
    "Which profile spent the most in <mon>?",
    "Compare <prof> and the others",
    "What are my top merchants?",
    "What are the top categories in <mon> <yr>?",
    "What is my average <cat> spending in <yr>?",
    "How many purchases did I make at <bank>?",
    "How much income did I receive in <yr>?",
    "Spending by bank of <prof>",
    "Expenses by profile in <yr>",
    "How is my monthly spend on <cat>?",
    "Show yearly totals of <bank>",
    "How much went to <cat> last month?",
    "How much did I spend on <cat> in <mon> <yr>?",
    "Tell me something useful",
    "How much did I spend at <shop> in <mon>?",
    "What was the average deposit from <bank> in <yr>?",
    "Count the <prof> payments at <shop> in <yr>",
    "Total <prof> expenses with <bank> on <cat> in <mon> <yr>?",
    "Show every <cat> transaction of <prof> in <yr>",
]
REPLIES = [
    "Here it is:<nl>```sql<nl>SELECT SUM(amount) FROM transactions WHERE profile = <q><prof><q> AND bank = <q><bank_value><q>;<nl>```",
    "SELECT * FROM transactions WHERE category = <q><cat><q> AND amount < 0; SELECT 2",
    "DELETE FROM transactions WHERE bank = <q><bank_value><q>",
    "select merchant from transactions where merchant = <q>update<q>",
    "",
    "Sure: SELECT COUNT(*) FROM transactions WHERE profile = <q><prof_value><q> AND amount >= 0",
    "SELECT * FROM transactions WHERE bank = <q>Nowhere Bank<q> AND category=<q>Unknown Thing<q>",
    "```<nl>SELECT category, SUM(amount) FROM transactions WHERE category = <q><cat_value><q> AND profile = <q><prof_value><q> GROUP BY category<nl>```",
    "I cannot answer that.",
    "SELECT * FROM transactions; DROP TABLE transactions",
    "SELECT * FROM transactions WHERE bank = <q><bank><q> AND amount > 0 LIMIT 5",
]
_SPECIAL = {"nl": "chr(10)", "q": "chr(39)"}


def _filled(phrase: str) -> str:
    """The phrase as a concatenation of literals and columns."""
    parts = re.split(r"<(\w+)>", phrase)
    out = [_SPECIAL.get(p, p) if i % 2 else sql_str(p) for i, p in enumerate(parts) if i % 2 or p]
    return " || ".join(out) or "''"


def _pick(expressions: list[str], by: str) -> str:
    return f"(CASE ({by}) % {len(expressions)} " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(expressions)) + " END)"


def _pair(pairs, by: str, names: tuple[str, str]) -> str:
    alias, value = ([sql_str(str(p[i])) for p in pairs] for i in (0, 1))
    return f"{_pick(alias, by)} AS {names[0]}, {_pick(value, by)} AS {names[1]}"


_MONTH = _pick([sql_str(m) for m, _ in MONTH_NAMES], "k % 7 + k % 6")
_BOUND = (
    "SELECT k, CAST(0 AS BIGINT) AS turn, lower(p_type) AS cat, p_type AS cat_value, lower(r_name) AS bank, r_name AS bank_value,"
    f" lower(c_mktsegment) AS prof, c_mktsegment AS prof_value, CAST(1995 + k % 7 AS STRING) AS yr, {_MONTH} AS mon,"
    " lpad(CAST(k % 100 AS STRING), 9, '0') AS shop FROM rows"
)
_DEFAULT = (
    f"SELECT k, CAST(2 AS BIGINT) AS turn, {_pair(CATEGORY_ALIASES, 'k % 29', ('cat', 'cat_value'))},"
    f" {_pair(BANK_ALIASES, 'k % 7 + k % 5', ('bank', 'bank_value'))}, {_pair(PROFILE_ALIASES, 'k % 5 + k % 7', ('prof', 'prof_value'))},"
    f" {_pick([sql_str(y) for y in YEARS], 'k % 7')} AS yr, {_MONTH} AS mon, {_pick([sql_str(s) for s in ('starbucks', 'metro', 'uber eats')], 'k % 5')} AS shop"
    " FROM rows"
)
#: {customer} and so on stand for the tables.
_ASKED = (
    "SELECT -1 - k AS conv_id, turn + side AS turn, CASE side WHEN 0 THEN 'user' ELSE 'assistant' END AS role,"
    f" CASE side WHEN 0 THEN {_pick([_filled(p) for p in QUESTIONS], 'k')} ELSE {_pick([_filled(p) for p in REPLIES], 'k')} END AS text"
    f" FROM (SELECT 0 AS side, f.* FROM ({_BOUND}) f UNION ALL SELECT 1, f.* FROM ({_BOUND}) f"
    f" UNION ALL SELECT 0, f.* FROM ({_DEFAULT}) f UNION ALL SELECT 1, f.* FROM ({_DEFAULT}) f) a"
)
ASKED_SQL = (
    "WITH rows AS (SELECT c_custkey AS k, c_mktsegment, r_name, p_type FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"
    " JOIN {region} ON n_regionkey = r_regionkey JOIN {part} ON p_partkey = c_custkey) " + _ASKED
)


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, text): the given conversations and what the customers ask (stored once for these inputs and this text)."""
    files = fingerprint(spark, [table_path(sf_dir, t) for t in TABLES])
    path = f"{tables_root(spark)}/asked-{files}-{hashlib.sha1(ASKED_SQL.encode()).hexdigest()[:12]}"
    if not path_exists(spark, f"{path}/_SUCCESS"):
        spark.sql(ASKED_SQL, **{t: read_table(spark, sf_dir, t) for t in TABLES}).write.mode("overwrite").parquet(path)
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return given.unionByName(spark.read.schema("conv_id long, turn long, role string, text string").parquet(path))


def with_talk(sql: str) -> str:
    """Prefix a DuckDB query over ``talk`` with the same rows."""
    talk_sql = "SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (" + ASKED_SQL.format(**{t: t for t in TABLES}) + ")"
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH talk AS ({talk_sql}),\n{body[5:]}"
    return f"WITH talk AS ({talk_sql})\n{body}"
