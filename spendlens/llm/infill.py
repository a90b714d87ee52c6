"""Fill-in-the-middle transformation by counted-quantifier patterns (operator 11).

A text is a sequence of units: a word with the white space before it, or the white space at the end. ``regexp_count``
gives their number n; two cuts a <= b follow from a hash of the id. Then each row gets a pattern of its own,
``\\A((?:unit){a}+)((?:unit){b-a}+)(.*+)\\z``, whose groups are prefix, middle and suffix: one replacement with it writes
the output. The counted groups are possessive, so matching neither backtracks nor recurses, however long the text.

The three marks occur in no text that is cut (such texts stay plain), and no mark can begin inside another, so the
output splits at the marks into exactly the parts: ``restored`` is rebuilt from output and form alone.

Cases: null text counts as empty and stays plain; a null id is hashed as an empty string; rows are judged one by one,
so repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import sha_of, table, text_of

SPACE, SIGN = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
UNIT = f"(?:{SPACE}*+{SIGN}++|{SPACE}++)"
MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 42, 50, 80  # per cent of the texts that are cut, and of these in spm form


def _draw(key: Column, k: int) -> Column:
    """The k-th 8-digit group of the hex hash as an unsigned integer."""
    return F.conv(F.substring(key, 8 * k + 1, 8), 16, 10).cast("long")


def infilled(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output, restored: one row per row of ``docs``."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select("doc_id", text_of().alias("text"), key.alias("key"))
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("long").alias("n"), *[_draw(F.col("key"), k).alias(f"h{k + 1}") for k in range(4)])
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_rate, "spm").otherwise("psm"))
    x, y = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    counted = lambda c: F.concat(F.lit(f"((?:{UNIT}){{"), c.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), counted(F.least(x, y)), counted(F.greatest(x, y) - F.least(x, y)), F.lit(r"(.*+)\z"))
    p, s, m = MARKS
    filled = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, filled))
    rows = rows.select("doc_id", "n", "form", output.alias("output"))
    parts = F.when(F.col("form") != "plain", F.split("output", f"<[{''.join(x[1] for x in MARKS)}]>", -1))
    rows = rows.withColumn("parts", parts)
    psm = F.col("form") == "psm"
    prefix, suffix = F.when(psm, F.get("parts", F.lit(1))).otherwise(F.get("parts", F.lit(2))), F.when(psm, F.get("parts", F.lit(2))).otherwise(F.get("parts", F.lit(1)))
    middle = F.get("parts", F.lit(3))
    return rows.select(
        "doc_id", "n", "form", F.char_length(prefix).cast("long").alias("prefix_chars"), F.char_length(middle).cast("long").alias("middle_chars"),
        "output", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, middle, suffix)).alias("restored"),
    )


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infilled(table(spark, sf_dir, "documents"))
    return out.select(*[c for c in out.columns if c not in ("output", "restored")], sha_of(F.col("output")).alias("output_sha256"), sha_of(F.col("restored")).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
 CAST('0x' || k[1:8] AS BIGINT) AS h1, CAST('0x' || k[9:16] AS BIGINT) AS h2, CAST('0x' || k[17:24] AS BIGINT) AS h3, CAST('0x' || k[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS pre, coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:n], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(t) AS restored_sha256 FROM p
"""
