"""The stored table: writers at the same time, writers that die, the layout by date, CSV files read in splits."""

from __future__ import annotations

import datetime as dt
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from spendlens.operators import ml
from spendlens.operators.filters import flt_year
from spendlens.schema import REQUIRED_COLUMNS
from spendlens.sources import table as tbl


def _root(spark):
    return f"{tbl.tables_root(spark)}/test-{uuid.uuid4().hex[:8]}"


def test_appends_at_the_same_time_all_count(spark, txn):
    root, done = _root(spark), []
    tbl.sink_replace(spark, txn, root)

    def work(n):
        done.append(tbl.sink_append(spark, txn.limit(n), root))

    threads = [threading.Thread(target=work, args=(n,)) for n in (1, 2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    state = tbl.current_state(spark, root)
    assert sorted(done) == [1, 2, 3, 4] and state["rows"] == 20 and state["number"] == 5
    assert tbl.src_table(spark, root).count() == 20


def test_one_of_two_writers_gets_the_claim(spark):
    path, got = f"{_root(spark)}/_log/claim", []
    threads = [threading.Thread(target=lambda: got.append(tbl._create_new(spark, path))) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [False] * 7 + [True]


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, txn, monkeypatch):
    root = _root(spark)
    tbl.sink_replace(spark, txn, root)
    before = tbl.src_table(spark, root).count()
    with monkeypatch.context() as m:  # the rows are written, the state is not
        m.setattr(tbl, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        for write in (tbl.sink_append, tbl.sink_replace):
            with monkeypatch.context() as short, pytest.raises(RuntimeError, match="killed"):
                short.setattr(tbl, "STALE_SECONDS", 0.2)
                write(spark, txn.limit(3), root)
    assert tbl.src_table(spark, root).count() == before and tbl.current_state(spark, root)["number"] == 1
    monkeypatch.setattr(tbl, "STALE_SECONDS", 0.2)  # the dead writers' claim is taken over
    assert tbl.sink_append(spark, txn.limit(3), root) == 3
    assert tbl.src_table(spark, root).count() == before + 3 == tbl.current_state(spark, root)["rows"]


def test_a_replace_keeps_the_files_of_running_queries(spark, txn):
    root = _root(spark)
    tbl.sink_replace(spark, txn, root)
    running = tbl.src_table(spark, root)
    tbl.sink_replace(spark, txn.limit(1), root)
    assert running.count() == 10 and tbl.src_table(spark, root).count() == 1
    for _ in range(3):
        tbl.sink_replace(spark, txn.limit(2), root)
    folders = [n for n in tbl._names(spark, root) if n.startswith("v-")]
    assert len(folders) == tbl.KEPT_STATES and len(tbl._names(spark, f"{root}/_log")) <= 2 * tbl.KEPT_STATES


def test_years_cover_all_appends(spark, txn):
    root = _root(spark)
    tbl.sink_replace(spark, txn.where("year(date) = 2025"), root)
    assert tbl.current_state(spark, root)["years"] == [2025, 2025]
    tbl.sink_append(spark, txn.where("year(date) <> 2025"), root)
    assert tbl.current_state(spark, root)["years"] == [2024, 2026]
    tbl.sink_replace(spark, txn.where("false"), root)
    assert tbl.current_state(spark, root)["years"] is None and tbl.src_table(spark, root).count() == 0


def test_a_year_lies_in_few_files(spark):
    root, days = _root(spark), 6 * 365
    rows = spark.range(40_000).select(
        F.date_add(F.lit(dt.date(2020, 1, 1)), (F.col("id") * 7919 % days).cast("int")).alias("date"),
        *[F.concat(F.lit(c), F.col("id").cast("string")).alias(c) for c in ("merchant", "description")],
        (F.col("id") * -1.0).alias("amount"), *[F.lit("v").alias(c) for c in ("category", "profile", "bank", "currency")],
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tbl.sink_replace(spark, rows.repartition(16), root)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    table = tbl.src_table(spark, root)
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    every, year = files(table), files(table.where(flt_year(2022)))
    assert every >= 8 and year <= every // 3, (every, year)
    assert table.where(flt_year(2022)).count() == rows.where("year(date) = 2022").count()


def _csv(path, rows):
    with open(path, "w") as f:
        f.write(",".join(REQUIRED_COLUMNS) + "\n")
        f.writelines(rows)


def test_one_large_csv_is_read_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "large.csv")
    line = '2025-01-{:02d},"Joe ""Big"", Inc {}",desc,-{}.5,Coffee,Student,TD,CAD\n'
    _csv(path, [line.format(1 + i % 28, i, i) for i in range(60_000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        assert not tbl.spans_lines(spark, path)
        got = tbl.src_csv(spark, path)
        assert got.rdd.getNumPartitions() > 2
        assert got.count() == 60_000 and got.where("merchant = 'Joe \"Big\", Inc 59999'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_over_several_lines_are_found(spark, tmp_path):
    path = str(tmp_path / "lines.csv")
    _csv(path, ['2025-01-01,"two\nlines",d,-1,C,P,B,CAD\n', "2025-01-02,Metro,d,-2,C,P,B,CAD\n"])
    assert tbl.spans_lines(spark, path)
    assert sorted(r.merchant for r in tbl.src_csv(spark, path).collect()) == ["Metro", "two\nlines"]


def test_na_markers_are_compared_as_they_are(spark, tmp_path):
    path = str(tmp_path / "na.csv")
    _csv(path, ["2025-01-01,NA,d,-1,C,P,B,CAD\n", "2025-01-02, NA ,d,-2,C,P,B,CAD\n", '2025-01-03,"",d,-3,C,P,B,CAD\n', "2025-01-04,   ,d,-4,C,P,B,CAD\n"])
    assert [r.merchant for r in tbl.src_csv(spark, path).orderBy("date").collect()] == ["Unknown", "NA", "Unknown", ""]


def test_upload_cleans_predicts_and_saves(spark, tmp_path, txn):
    path, model_path, root = str(tmp_path / "up.csv"), str(tmp_path / "model"), _root(spark)
    rows = txn.unionByName(txn.withColumn("amount", F.col("amount") - 1)).unionByName(txn.withColumn("amount", F.col("amount") - 2))
    ml.save_model(ml.train_model(rows, num_trees=3, max_depth=3)[0], model_path)
    _csv(path, ["2025-01-01, Metro ,d,-1,?,Family,TD,CAD\n", "never,Metro,d,-2,?,Family,TD,CAD\n", "2025-01-03T10:00:00Z,Metro,d,-3,?,Family,TD,CAD\n"])
    assert tbl.upload(spark, path, root) == 2
    assert {(r.merchant, r.category) for r in tbl.src_table(spark, root).collect()} == {("Metro", "?")}
    assert tbl.upload(spark, path, root, "append", model_path) == 2
    stored = tbl.src_table(spark, root)
    assert stored.count() == 4 and stored.where("category <> '?'").count() == 2
    assert tbl.upload(spark, path, root, "replace", str(tmp_path / "no-model")) == 2
    with pytest.raises(FileNotFoundError):
        tbl.upload(spark, os.path.join(tmp_path, "none.csv"), root)
