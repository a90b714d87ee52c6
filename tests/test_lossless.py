"""Nothing is lost or swapped: CSV quoting and headers, month filters beyond the recorded years, groups without a target."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from spendlens.operators import filters, ml, rescale
from spendlens.schema import REQUIRED_COLUMNS, TRANSACTIONS
from spendlens.sources import table as tbl


def _csv(path, header, rows):
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"{len(os.listdir(path))}.csv"), "w") as f:
        f.write("\n".join([",".join(header), *rows]) + "\n")


def test_quotes_and_line_breaks_survive_csv(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _csv(source, REQUIRED_COLUMNS, ['2025-01-01,"Joe ""Big"", Inc","two\nlines",-5.5,Coffee,Student,TD,CAD'])
    back = tbl.src_csv(spark, source)
    assert [(r["merchant"], r["description"]) for r in back.collect()] == [('Joe "Big", Inc', "two\nlines")]
    tbl.sink_csv_export(back, out)
    text = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert '"Joe ""Big"", Inc"' in text
    assert tbl.src_csv(spark, out).collect() == back.collect()


def test_reordered_header_is_an_error_not_a_swap(spark, tmp_path):
    source = str(tmp_path / "in")
    row = ["2025-01-01", "Metro", "x", "-5.5", "Coffee", "Student", "TD", "CAD"]
    _csv(source, REQUIRED_COLUMNS, [",".join(row)])
    swapped = list(range(8))
    swapped[1], swapped[6] = 6, 1
    _csv(source, [REQUIRED_COLUMNS[i] for i in swapped], [",".join(row[i] for i in swapped)])
    with pytest.raises(Exception, match="CSV header|header"):
        tbl.src_csv(spark, source).collect()


def test_month_filter_keeps_rows_beyond_the_recorded_years(spark):
    days = [dt.date(2019, 3, 1), dt.date(2020, 3, 9), dt.date(2020, 4, 1), dt.date(2031, 3, 31)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    assert df.where(filters.flt_month(3, (2020, 2020))).count() == 3
    assert df.where(filters.flt_months_in([3, 4], (2020, 2020))).count() == 4


def test_rows_without_a_target_stay(spark, txn_rows):
    rows = spark.createDataFrame(txn_rows, TRANSACTIONS).where("amount < 0").withColumn("year", F.year("date"))
    targets = rows.select("profile", "year").distinct().where("profile = 'Family'").withColumn("target", F.lit(1000.0))
    got = rescale.rescale_to_target(rows, targets)
    assert got.count() == rows.count()
    assert got.where("profile <> 'Family'").select(*rows.columns).exceptAll(rows.where("profile <> 'Family'")).isEmpty()


def test_report_has_classes_that_are_only_predicted(spark):
    got = {r["class"]: r for r in ml.report(spark.createDataFrame([("A", "A"), ("A", "Z")], "actual string, predicted string")).collect()}
    assert got["Z"]["support"] == 0 and got["Z"]["precision"] == 0.0
    assert got["macro avg"]["precision"] == 0.5 and got["A"]["recall"] == 0.5


def test_sums_of_very_large_and_very_small_amounts(spark):
    from spendlens.functions.money import avg_abs_2, exact_sum, round_sum_2

    rows = [("large", 1e15), ("large", 0.25), ("huge", 1e30), ("huge", -2e30), *[("small", 0.00004)] * 1000, ("none", None)]
    df = spark.createDataFrame(rows, "g string, amount double")
    got = {r.g: r for r in df.groupBy("g").agg(exact_sum("amount").alias("s"), round_sum_2("amount").alias("r"), avg_abs_2("amount").alias("a")).collect()}
    assert got["large"].s == 1e15 + 0.25 and got["large"].a == 500000000000000.13
    assert got["huge"].s == got["huge"].r == -1e30
    assert got["small"].s == 0.04 and got["small"].r == 0.04
    assert got["none"].s is None and got["none"].a is None


def test_rescale_of_amounts_outside_the_integers(spark):
    from spendlens.operators.rescale import rescale_to_target

    rows = [("a", 2024, -1e15), ("a", 2024, -3e15), ("b", 2024, -0.125), ("c", 2024, -7.0)]
    df = spark.createDataFrame(rows, "profile string, year int, amount double")
    targets = spark.createDataFrame([("a", 2024, 8.0), ("b", 2024, 2.0)], "profile string, year int, target double")
    assert sorted(r.amount for r in rescale_to_target(df, targets).collect()) == [-7.0, -6.0, -2.0, -2.0]
