"""The transaction table's schema and its fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that must equal the reference's: required columns in this order.
REQUIRED_COLUMNS = ["date", "merchant", "description", "amount", "category", "profile", "bank", "currency"]
TEXT_COLUMNS = ["merchant", "description", "category", "profile", "bank", "currency"]

# The category taxonomy, in the reference's order.
CATEGORY_TAXONOMY = [
    "Income",
    "Housing",
    "Groceries",
    "Dining",
    "Coffee",
    "Transportation",
    "Utilities",
    "Subscriptions",
    "Shopping",
    "Healthcare",
    "Education",
    "Childcare",
    "Insurance",
    "Travel",
    "Savings/Investments",
]

# Profiles of the reference's generated data.
PROFILES = ["Student", "Professional", "Family"]

TRANSACTIONS = T.StructType(
    [
        T.StructField("date", T.DateType(), False),
        T.StructField("merchant", T.StringType(), False),
        T.StructField("description", T.StringType(), False),
        T.StructField("amount", T.DoubleType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("profile", T.StringType(), False),
        T.StructField("bank", T.StringType(), False),
        T.StructField("currency", T.StringType(), False),
    ]
)
