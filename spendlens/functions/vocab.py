"""Question vocabulary: ordered alias -> value lists.

Order matters: the first alias (in list order) found in a question wins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values that must equal the reference's: alias lists in their order.
CATEGORY_ALIASES = [
    ("income", "Income"),
    ("housing", "Housing"),
    ("rent", "Housing"),
    ("mortgage", "Housing"),
    ("groceries", "Groceries"),
    ("grocery", "Groceries"),
    ("dining", "Dining"),
    ("restaurant", "Dining"),
    ("restaurants", "Dining"),
    ("coffee", "Coffee"),
    ("transportation", "Transportation"),
    ("transport", "Transportation"),
    ("transit", "Transportation"),
    ("utilities", "Utilities"),
    ("utility", "Utilities"),
    ("subscriptions", "Subscriptions"),
    ("subscription", "Subscriptions"),
    ("shopping", "Shopping"),
    ("healthcare", "Healthcare"),
    ("health", "Healthcare"),
    ("education", "Education"),
    ("childcare", "Childcare"),
    ("insurance", "Insurance"),
    ("travel", "Travel"),
    ("save", "Savings/Investments"),
    ("invest", "Savings/Investments"),
    ("savings", "Savings/Investments"),
    ("investments", "Savings/Investments"),
    ("investment", "Savings/Investments"),
]
BANK_ALIASES = [("rbc", "RBC"), ("td", "TD"), ("scotiabank", "Scotiabank"), ("scotia", "Scotiabank")]
PROFILE_ALIASES = [("student", "Student"), ("professional", "Professional"), ("family", "Family")]
MONTH_NAMES = [
    ("january", 1),
    ("february", 2),
    ("march", 3),
    ("april", 4),
    ("may", 5),
    ("june", 6),
    ("july", 7),
    ("august", 8),
    ("september", 9),
    ("october", 10),
    ("november", 11),
    ("december", 12),
]
YEARS = ["2024", "2025", "2026"]

# Word lists and phrases of the reference's question rules.
INCOME_WORDS = ["income", "receive", "received", "salary", "payroll", "deposit"]
INCOME_DETAIL_WORDS = ["income", "receive", "received"]
SPENDING_WORDS = ["spend", "spent", "spending", "expense", "expenses"]
LISTING_WORDS = ["show", "transaction"]  # all must occur
TOP_THREE_PHRASES = ["top 3", "top three"]
MERCHANT_OVERRIDE = "starbucks"  # found anywhere in a question, it is the merchant

# The question rules that SURVEY asks to keep, in precedence order (first match wins; 19 otherwise).
# Each rule is a list of alternatives; an alternative is (phrases that must all occur
# in the lower-cased question, slot conditions). PROFILE_WORD stands for any profile
# alias of the vocabulary; "any_slot" means some slot is set.
PROFILE_WORD = "<profile alias>"
INTENT_RULES = [
    (1, [(["recurring"], {})]),
    (2, [(["frequent", "subscription"], {})]),
    (3, [(["transaction"], {"merchant": True})]),
    (4, [(["compare", "january", "february"], {})]),
    (5, [(["largest", "category"], {})]),
    (6, [(["which profile", "spent the most"], {}), (["which profile", "spending"], {})]),
    (7, [(["compare", PROFILE_WORD], {})]),
    (8, [(["top merchant"], {})]),
    (9, [(["top categor"], {}), (["spending by category"], {"category": False})]),
    (10, [(["average"], {}), (["avg"], {})]),
    (11, [(["how many"], {}), (["count"], {}), (["number of transactions"], {})]),
    (12, [([], {"is_income": True})]),
    (13, [(["by bank"], {"bank": False})]),
    (14, [(["by profile"], {"profile": False})]),
    (15, [(["by month"], {}), (["monthly"], {})]),
    (16, [(["by year"], {}), (["yearly"], {})]),
    (17, [(["last month"], {"category": True})]),
    (18, [([], {"any_slot": True})]),
]
DEFAULT_INTENT = 19


@dataclass(frozen=True)
class Vocabulary:
    categories: list = field(default_factory=lambda: list(CATEGORY_ALIASES))
    banks: list = field(default_factory=lambda: list(BANK_ALIASES))
    profiles: list = field(default_factory=lambda: list(PROFILE_ALIASES))
    months: list = field(default_factory=lambda: list(MONTH_NAMES))
    years: list = field(default_factory=lambda: list(YEARS))
    merchant_override: str | None = MERCHANT_OVERRIDE

    def blocked(self) -> list[str]:
        """Aliases that can never be a merchant."""
        seen: list[str] = []
        for alias, _ in self.categories + self.banks + self.profiles:
            if alias not in seen:
                seen.append(alias)
        return seen


DEFAULT = Vocabulary()


def binding_vocabulary() -> Vocabulary:
    """Vocabulary of the bound driver tables: their values in lower case as aliases."""
    cats = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    banks = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    profiles = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return Vocabulary(
        categories=[("income", "Income")] + [(c.lower(), c) for c in cats],
        banks=[(b.lower(), b) for b in banks],
        profiles=[(p.lower(), p) for p in profiles],
        years=[str(y) for y in range(1995, 2002)],
        merchant_override=None,
    )
