from __future__ import annotations

import datetime as dt
import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from spendlens.operators import clean
from spendlens.sources import table as tbl

DIRTY = [
    ("2024-01-05", "12.50", " Metro "),
    ("2024-01-05 10:00:00", "-3", None),
    ("2024-02-30", "5", "Metro"),
    ("garbage", "5", "Metro"),
    ("2024-01-06", "1,000", "Metro"),
    ("2024-01-06", "$5", "Metro"),
    ("2024-01-06", "1e3", "   "),
    ("2024-01-06", "nan", "Metro"),
    ("2024-01-06", "1d", "Metro"),
    ("2024-01-06", "0", "Metro"),
]


def dirty_df(spark):
    rows = [(d, m, "desc", a, "Cat", "Student", "TD", "CAD", "spare") for d, a, m in DIRTY]
    cols = [" Date ", "Merchant", "description", "Amount", "category", "profile", "bank", "currency", "Extra Column"]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols))


def test_normalize_dirty_rows(spark):
    out = clean.normalize(dirty_df(spark)).orderBy("amount").collect()
    got = [(r.date, r.amount, r.merchant) for r in out]
    assert got == [
        (dt.date(2024, 1, 5), -3.0, "Unknown"),
        (dt.date(2024, 1, 6), 0.0, "Metro"),
        (dt.date(2024, 1, 5), 12.5, "Metro"),
        (dt.date(2024, 1, 6), 1000.0, ""),
    ]
    assert out[0].__fields__ == ["date", "merchant", "description", "amount", "category", "profile", "bank", "currency"]


def test_normalize_idempotent(spark):
    once = clean.normalize(dirty_df(spark))
    twice = clean.normalize(once)
    assert sorted(once.collect()) == sorted(twice.collect())


def test_missing_column_names_it(spark):
    df = dirty_df(spark).drop("bank")
    with pytest.raises(ValueError, match="bank"):
        clean.normalize(df)


def test_header_collision(spark):
    df = spark.createDataFrame([("a", "b")], "`Date` string, ` date ` string")
    with pytest.raises(ValueError):
        clean.norm_headers(df)


def test_expense_and_feature_views(spark, txn):
    ev = clean.expense_view(txn).where(F.col("merchant") == "Zero Corp").first()
    assert (ev.expense_amount, ev.income_amount, ev.month) == (0.0, 0.0, "2026-02")
    fv = clean.feature_view(txn).where(F.col("merchant") == "Netflix").first()
    # 2024-03-20 is a Wednesday: Monday = 0.
    assert (fv.month, fv.day_of_week, fv.is_income, fv.abs_amount) == (3, 2, 0, 16.99)
    assert fv.text == "Netflix subscription Professional RBC"


def _scratch(spark):
    return f"{tbl.tables_root(spark)}/test-{uuid.uuid4().hex[:8]}"


def test_sinks_replace_append_and_mode(spark, txn):
    root = _scratch(spark)
    assert tbl.sink_replace(spark, txn, root) == 10
    assert tbl.sink_append(spark, txn.where("amount > 0"), root) == 2
    assert tbl.src_table(spark, root).count() == 12
    assert tbl.sink_replace(spark, txn.where("amount < 0"), root) == 7
    assert tbl.src_table(spark, root).count() == 7
    with pytest.raises(ValueError, match="mode"):
        tbl.save_transactions(spark, txn, root, mode="upsert")
    # Bad input raises before anything is written: the table keeps its rows.
    with pytest.raises(ValueError):
        tbl.sink_replace(spark, txn.drop("bank"), root)
    assert tbl.src_table(spark, root).count() == 7


def test_seed_fallback(spark, txn):
    root = _scratch(spark)
    out = tbl.src_seed_fallback(spark, root, lambda: txn)
    assert out.count() == 10
    # Present and non-empty: the default is not loaded again.
    out = tbl.src_seed_fallback(spark, root, lambda: txn.limit(1))
    assert out.count() == 10


def test_src_csv_and_export(spark, txn):
    d = tempfile.mkdtemp(prefix="spendlens-csv-")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write(" Date ,Merchant,description,amount,category,profile,bank,currency,spare\n")
        f.write("2024-01-05,NA,d,-1.5,C,P,B,CAD,x\n")
        f.write("2024-01-06,Metro,d,oops,C,P,B,CAD,x\n")
        f.write("2024-01-07,,d,2,C,P,B,CAD,x\n")
    rows = tbl.src_csv(spark, path).orderBy("date").collect()
    assert [(r.date.day, r.merchant, r.amount) for r in rows] == [(5, "Unknown", -1.5), (7, "Unknown", 2.0)]
    with pytest.raises(FileNotFoundError):
        tbl.src_csv(spark, os.path.join(d, "missing.csv"))
    out = os.path.join(d, "export")
    tbl.sink_csv_export(txn.withColumn("id", F.lit(1)), out)
    back = tbl.src_csv(spark, out)
    assert "id" not in back.columns and back.count() == 10


def test_validate_select_sql():
    from spendlens.operators.sqllog import validate_select_sql

    assert validate_select_sql(" SELECT 1; ") == "SELECT 1"
    for bad in ["", "DELETE FROM t", "select * from t where x = 'update'"]:
        with pytest.raises(ValueError):
            validate_select_sql(bad)
