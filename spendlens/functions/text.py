"""Regex helpers shared by the Spark expressions and the DuckDB oracle.

Patterns avoid look-around and use explicit character classes, so Java
regex (Spark) and RE2 (DuckDB) read them the same way. A "word" boundary is
spelled out as a non-letter, non-digit, non-underscore character or the text
edge; Java's ``\\b`` and RE2's ``\\b`` disagree on accented letters.
"""

from __future__ import annotations

NON_WORD = r"[^\pL\pN_]"
SPACE = r"[\t\n\x0B\f\r ]"
_META = set(r"\.^$*+?()[]{}|-#&~/")


def escape(text: str) -> str:
    return "".join("\\" + ch if ch in _META else ch for ch in text)


def word_pattern(term: str) -> str:
    """Matches ``term`` as a whole word anywhere in the text."""
    return f"(?:^|{NON_WORD}){escape(term)}(?:{NON_WORD}|$)"


def alternatives_word_pattern(terms: list[str]) -> str:
    """Group 1 = the leftmost whole-word occurrence of any of ``terms``."""
    return f"(?:^|{NON_WORD})({'|'.join(escape(t) for t in terms)})(?:{NON_WORD}|$)"


def sql_str(text: str) -> str:
    """A DuckDB string literal (backslashes are literal there)."""
    return "'" + text.replace("'", "''") + "'"
