"""The load of the driver tables: rows are shuffled by order and part only, and lie in files by year."""

from __future__ import annotations

import datetime as dt
import os
import uuid

from pyspark.sql import functions as F

from spendlens.schema import TRANSACTIONS
from spendlens.sources import binding
from spendlens.sources import table as tbl


def test_rows_are_not_shuffled_to_be_laid_out(spark, txn):
    root = f"{tbl.tables_root(spark)}/test-{uuid.uuid4().hex[:8]}"
    rows = [(dt.date(y, 3, d), "m", "d", -float(d), "c", "p", "b", "CAD") for y in (2019, 2020, 2021) for d in range(1, 29)]
    df = spark.createDataFrame(rows, TRANSACTIONS).coalesce(1)
    tbl.sink_replace(spark, df, root)
    table = tbl.src_table(spark, root)
    got = table.select(F.input_file_name().alias("f"), F.year("date").alias("y"), "date").collect()
    files = {}
    for r in got:
        files.setdefault(r.f, []).append(r)
    assert len(files) == 3 and all(len({r.y for r in f}) == 1 for f in files.values())  # one task, one file a year
    assert all([r.date for r in f] == sorted(r.date for r in f) for f in files.values())
    assert sorted(map(tuple, table.collect())) == sorted(rows) and table.columns == TRANSACTIONS.names


def test_lineitem_is_shuffled_by_order_and_part_only(spark):
    """Also where nothing is below the broadcast threshold; the few suppliers are broadcast by their count."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = binding.bind_transactions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(l_" in line]
    assert len(dealt) == 2 and "l_suppkey" not in "".join(d.split("hashpartitioning(")[1].split(")")[0] for d in dealt)


def test_repeated_and_missing_keys(spark, tmp_path):
    """Repeated keys give one row a pair and missing ones none, as a plain join does."""
    d = str(tmp_path)
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "R")]),
        "nation": ("n_nationkey int, n_regionkey int", [(0, 0), (1, None)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 0, "S"), (2, 1, "S"), (3, 0, None)]),
        "supplier": ("s_suppkey long, s_name string", [(1, "a"), (1, "b"), (None, "c")]),
        "part": ("p_partkey long, p_name string, p_type string", [(1, "n", "t"), (2, None, None)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp", [(1, 1, dt.datetime(2020, 5, 1, 23)), (2, 2, None), (3, 3, None)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double, l_returnflag string",
            [(1, 1, 1, 2.5, "R"), (1, 2, 1, 2.5, None), (1, 1, None, 1.0, "N"), (None, 1, 1, 1.0, "N"), (2, 1, 1, 1.0, "N"), (3, 1, 1, None, "N")],
        ),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(os.path.join(d, f"{name}.parquet"))
    day = dt.date(2020, 5, 1)
    want = [(day, s, "n", 2.5, "t", "S", "R", "CAD") for s in "ab"] + [(day, s, None, -2.5, None, "S", "R", "CAD") for s in "ab"]
    want += [(None, s, "n", None, "t", None, "R", "CAD") for s in "ab"]
    assert sorted(map(str, map(tuple, binding.bind_transactions(spark, d).collect()))) == sorted(map(str, want))
