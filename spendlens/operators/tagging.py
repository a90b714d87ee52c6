"""Tagging a table of questions.

Input: any DataFrame with a text column. Output: the same rows plus slot
columns (category, bank, profile, year, month, merchant), the question-type
flags and the routed intent. Every tag is a JVM column expression (``rlike``,
``regexp_extract``, ``contains``, ``when`` chains): no Python UDF, no shuffle;
tagging is a map over the whole text of every row and scales with the number
of partitions.

The same rules are also emitted as DuckDB SQL (``tag_sql``) for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.functions.text import NON_WORD, SPACE, alternatives_word_pattern, escape, sql_str, word_pattern
from spendlens.functions.vocab import (
    DEFAULT,
    DEFAULT_INTENT,
    INCOME_DETAIL_WORDS,
    INCOME_WORDS,
    INTENT_RULES,
    LISTING_WORDS,
    PROFILE_WORD,
    SPENDING_WORDS,
    TOP_THREE_PHRASES,
    Vocabulary,
)

_CHARS = r"[a-z0-9&.' +\-]"
# The two merchant patterns of the reference, in order (explicit classes, see functions.text).
MERCHANT_PATTERNS = [
    rf"(?:^|{NON_WORD})show{SPACE}+(?:my{SPACE}+)?({_CHARS}+?){SPACE}+transactions",
    rf"(?:^|{NON_WORD})(?:with|at|from){SPACE}+({_CHARS}+?)"
    rf"(?:{SPACE}+in{SPACE}+|{SPACE}+on{SPACE}+|{SPACE}+during{SPACE}+|{SPACE}+for{SPACE}+|\n?$|\?)",
]
STRIP_MERCHANT = r"^[ ?.]+|[ ?.]+$"


# --- Spark --------------------------------------------------------------------------------------


def _nested(pairs) -> bool:
    """True if one alias occurs as a whole-word part of another (then a single scan could miss it)."""
    import re

    words = [a for a, _ in pairs]
    return any(a != b and re.search(rf"(?<![\w]){re.escape(a)}(?![\w])", b) for a in words for b in words)


def _first_alias(q: Column, pairs) -> Column:
    """Value of the first alias (in list order) present in ``q`` as a whole word.

    One regex scan collects every whole-word alias occurrence (Java look-around
    keeps the boundaries unconsumed); the earliest list position among them wins.
    """
    if not pairs:
        return F.lit(None)
    if _nested(pairs):
        return F.coalesce(*[F.when(q.rlike(word_pattern(a)), F.lit(v)) for a, v in pairs])
    first_rank: dict[str, int] = {}
    for i, (a, _) in enumerate(pairs):
        first_rank.setdefault(a, i)
    pattern = rf"(?<![\pL\pN_])({'|'.join(escape(a) for a, _ in pairs)})(?![\pL\pN_])"
    ranks = F.create_map(*[x for a, i in first_rank.items() for x in (F.lit(a), F.lit(i))])
    values = F.array(*[F.lit(str(v)) for _, v in pairs])
    found = F.regexp_extract_all(q, F.lit(pattern), 1)
    best = F.array_min(F.transform(found, lambda a: ranks[a]))
    return F.when(F.size(found) > 0, F.element_at(values, best + 1))


def _rank_lookup(ranks: Column):
    return lambda alias: F.try_element_at(ranks, alias)  # NULL for another slot's alias


def _slot_kinds(vocab: Vocabulary) -> dict[str, list]:
    return {"category": vocab.categories, "bank": vocab.banks, "profile": vocab.profiles, "month": vocab.months}


def slot_aliases_found(q: Column, vocab: Vocabulary) -> Column | None:
    """Every whole-word alias occurrence of any slot vocabulary, from ONE regex scan
    (None when an alias is a whole-word part of another: then one scan per slot)."""
    every = [pair for pairs in _slot_kinds(vocab).values() for pair in pairs]
    if _nested(every):
        return None
    aliases = list(dict.fromkeys(a for a, _ in every))
    pattern = rf"(?<![\pL\pN_])({'|'.join(escape(a) for a in aliases)})(?![\pL\pN_])"
    return F.regexp_extract_all(q, F.lit(pattern), 1)


def _slot_scan(q: Column, vocab: Vocabulary, found: Column | None = None) -> dict[str, Column]:
    """category, bank, profile, month: per slot, the alias earliest in that slot's list
    among the aliases found in the text."""
    kinds = _slot_kinds(vocab)
    found = found if found is not None else slot_aliases_found(q, vocab)
    if found is None:
        return {k: _first_alias(q, pairs) for k, pairs in kinds.items()}
    out = {}
    for kind, pairs in kinds.items():
        if not pairs:
            out[kind] = F.lit(None)
            continue
        first_rank: dict[str, int] = {}
        for i, (a, _) in enumerate(pairs):
            first_rank.setdefault(a, i)
        ranks = F.create_map(*[x for a, i in first_rank.items() for x in (F.lit(a), F.lit(i))])
        values = F.array(*[F.lit(str(v)) for _, v in pairs])
        best = F.array_min(F.transform(found, _rank_lookup(ranks)))
        out[kind] = F.when(best.isNotNull(), F.element_at(values, best + 1))
    return out


def _any_sub(q: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | q.contains(w)
    return out


def _all_sub(q: Column, words) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & q.contains(w)
    return out


def tag_columns(question: Column, vocab: Vocabulary = DEFAULT, found: Column | None = None) -> dict[str, Column]:
    q = F.lower(question)
    slots = _slot_scan(q, vocab, found)
    category, bank, profile = slots["category"], slots["bank"], slots["profile"]
    year = F.nullif(F.regexp_extract(q, alternatives_word_pattern(vocab.years), 1), F.lit("")).cast("int")
    month = slots["month"].cast("int")

    blocked = F.array(*[F.lit(a) for a in vocab.blocked()])
    merchant = None
    for pattern in reversed(MERCHANT_PATTERNS):
        m = F.regexp_replace(F.regexp_extract(q, pattern, 1), STRIP_MERCHANT, "")
        ok = (m != "") & ~F.array_contains(blocked, m)
        merchant = F.when(ok, m) if merchant is None else F.when(ok, m).otherwise(merchant)
    if vocab.merchant_override:
        merchant = F.when(q.contains(vocab.merchant_override), F.lit(vocab.merchant_override)).otherwise(merchant)
    return {
        "category": category,
        "bank": bank,
        "profile": profile,
        "year": year,
        "month": month,
        "merchant": merchant,
        "is_income": _any_sub(q, INCOME_WORDS),
        "is_income_detail": _any_sub(q, INCOME_DETAIL_WORDS),
        "is_spending": _any_sub(q, SPENDING_WORDS),
        "is_listing": _all_sub(q, LISTING_WORDS),
    }


SLOTS = ("category", "bank", "profile", "year", "month", "merchant")


def _compile_rules(has, all_of, any_of, is_set, is_true, negate, vocab: Vocabulary):
    """The rule table as nested conditions, built with the given dialect's primitives."""
    profile_word = any_of([has(a) for a, _ in vocab.profiles])
    compiled = []
    for num, alternatives in INTENT_RULES:
        alts = []
        for phrases, slot_conds in alternatives:
            parts = [profile_word if p == PROFILE_WORD else has(p) for p in phrases]
            for slot, want in slot_conds.items():
                if slot == "any_slot":
                    parts.append(any_of([is_set(k) for k in SLOTS]))
                elif slot == "is_income":
                    parts.append(is_true("is_income"))
                else:
                    parts.append(is_set(slot) if want else negate(is_set(slot)))
            alts.append(all_of(parts))
        compiled.append((num, any_of(alts)))
    return compiled


def intent_column(question: Column, tags: dict[str, Column], vocab: Vocabulary = DEFAULT) -> Column:
    """Intent number 1-19: the first rule of ``INTENT_RULES`` that matches."""
    q = F.lower(question)

    def all_of(xs):
        out = F.lit(True)
        for x in xs:
            out = out & x
        return out

    def any_of(xs):
        out = F.lit(False)
        for x in xs:
            out = out | x
        return out

    rules = _compile_rules(q.contains, all_of, any_of, lambda k: tags[k].isNotNull(), lambda k: tags[k], lambda c: ~c, vocab)
    out = F.lit(DEFAULT_INTENT)
    for num, cond in reversed(rules):
        out = F.when(cond, F.lit(num)).otherwise(out)
    return out


def tag_questions(df: DataFrame, text_col: str = "text", vocab: Vocabulary = DEFAULT) -> DataFrame:
    """Adds slot, flag and intent columns; also ``top3`` for the frequency intent."""
    # The slot-alias scan is its own column, so the four slots share one regex pass.
    found = slot_aliases_found(F.lower(F.col(text_col)), vocab)
    if found is not None:
        df = df.withColumn("_slot_aliases", found)
        found = F.col("_slot_aliases")
    tags = tag_columns(F.col(text_col), vocab, found)
    out = df.withColumns(tags)
    q = F.lower(F.col(text_col))
    tag_cols = {k: F.col(k) for k in tags}
    return out.withColumns(
        {
            "intent": intent_column(F.col(text_col), tag_cols, vocab),
            "top3": _any_sub(q, TOP_THREE_PHRASES),
        }
    ).drop("_slot_aliases")


# --- DuckDB oracle text --------------------------------------------------------------------------


def _sql_first_alias(q: str, pairs, cast: str | None = None) -> str:
    if not pairs:
        return "NULL"
    whens = " ".join(
        f"WHEN regexp_matches({q}, {sql_str(word_pattern(a))}) THEN {v if cast else sql_str(str(v))}" for a, v in pairs
    )
    return f"(CASE {whens} END)"


def _sql_any_sub(q: str, words) -> str:
    return "(" + " OR ".join(f"contains({q}, {sql_str(w)})" for w in words) + ")"


def tag_sql(text: str, vocab: Vocabulary = DEFAULT) -> dict[str, str]:
    q = f"lower({text})"
    blocked = "[" + ", ".join(sql_str(a) for a in vocab.blocked()) + "]"
    merchant = "NULL"
    for pattern in reversed(MERCHANT_PATTERNS):
        m = f"regexp_replace(regexp_extract({q}, {sql_str(pattern)}, 1), {sql_str(STRIP_MERCHANT)}, '', 'g')"
        merchant = f"(CASE WHEN {m} <> '' AND NOT list_contains({blocked}, {m}) THEN {m} ELSE {merchant} END)"
    if vocab.merchant_override:
        o = sql_str(vocab.merchant_override)
        merchant = f"(CASE WHEN contains({q}, {o}) THEN {o} ELSE {merchant} END)"
    return {
        "category": _sql_first_alias(q, vocab.categories),
        "bank": _sql_first_alias(q, vocab.banks),
        "profile": _sql_first_alias(q, vocab.profiles),
        "year": f"CAST(NULLIF(regexp_extract({q}, {sql_str(alternatives_word_pattern(vocab.years))}, 1), '') AS INTEGER)",
        "month": f"CAST({_sql_first_alias(q, vocab.months, cast='int')} AS INTEGER)",
        "merchant": merchant,
        "is_income": _sql_any_sub(q, INCOME_WORDS),
        "is_income_detail": _sql_any_sub(q, INCOME_DETAIL_WORDS),
        "is_spending": _sql_any_sub(q, SPENDING_WORDS),
        "is_listing": "(" + " AND ".join(f"contains({q}, {sql_str(w)})" for w in LISTING_WORDS) + ")",
    }


def intent_sql(text: str, tags: dict[str, str], vocab: Vocabulary = DEFAULT) -> str:
    q = f"lower({text})"
    rules = _compile_rules(
        lambda p: f"contains({q}, {sql_str(p)})",
        lambda xs: "(" + " AND ".join(xs) + ")" if xs else "true",
        lambda xs: "(" + " OR ".join(xs) + ")" if xs else "false",
        lambda k: f"({tags[k]} IS NOT NULL)",
        lambda k: f"({tags[k]})",
        lambda c: f"(NOT {c})",
        vocab,
    )
    return "(CASE " + " ".join(f"WHEN {c} THEN {n}" for n, c in rules) + f" ELSE {DEFAULT_INTENT} END)"
