from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from spendlens.session import local_session

    return local_session(shuffle_partitions=8)


@pytest.fixture(scope="session")
def txn_rows():
    """A small transaction table (already clean)."""
    import datetime as dt

    d = dt.date
    return [
        (d(2025, 1, 3), "Metro", "groceries run", -50.00, "Groceries", "Family", "TD", "CAD"),
        (d(2025, 1, 9), "Metro", "groceries run", -30.25, "Groceries", "Family", "RBC", "CAD"),
        (d(2025, 2, 1), "Payroll Deposit", "salary", 2000.00, "Income", "Family", "TD", "CAD"),
        (d(2025, 2, 14), "Starbucks", "coffee", -5.55, "Coffee", "Student", "TD", "CAD"),
        (d(2025, 3, 2), "Starbucks Reserve", "coffee", -7.45, "Coffee", "Student", "Scotiabank", "CAD"),
        (d(2024, 3, 20), "Netflix", "subscription", -16.99, "Subscriptions", "Professional", "RBC", "CAD"),
        (d(2024, 12, 31), "Scholarship Payment", "scholarship", 900.00, "Income", "Student", "RBC", "CAD"),
        (d(2026, 1, 15), "Metro", "groceries run", -1.00, "Groceries", "Professional", "TD", "CAD"),
        (d(2026, 1, 16), "Metro", "groceries run", -1.01, "Groceries", "Professional", "TD", "CAD"),
        (d(2026, 2, 1), "Zero Corp", "adjustment", 0.0, "Shopping", "Professional", "TD", "CAD"),
    ]


@pytest.fixture(scope="session")
def txn(spark, txn_rows):
    from spendlens.schema import TRANSACTIONS

    return spark.createDataFrame(txn_rows, TRANSACTIONS)
