from __future__ import annotations

import os
import tempfile
import uuid

from spendlens.sources import table as tbl
from spendlens.streaming import ingest

HEADER = "date,merchant,description,amount,category,profile,bank,currency\n"


def _write(folder, name, rows):
    with open(os.path.join(folder, name), "w") as f:
        f.write(HEADER)
        for r in rows:
            f.write(",".join(r) + "\n")


def test_stream_ingest_incremental_and_idempotent(spark):
    src = tempfile.mkdtemp(prefix="spendlens-upload-")
    root = f"{tbl.tables_root(spark)}/test-stream-{uuid.uuid4().hex[:8]}"
    _write(src, "a.csv", [("2024-01-05", "Metro", "d", "-3.5", "Groceries", "Family", "TD", "CAD"),
                          ("garbage", "Metro", "d", "1", "Groceries", "Family", "TD", "CAD")])
    ingest.ingest(spark, src, root).awaitTermination()
    assert ingest.read_ingested(spark, root).count() == 1

    _write(src, "b.csv", [("2024-02-01", " Payroll ", "salary", "2000", "Income", "Family", "TD", "CAD")])
    ingest.ingest(spark, src, root).awaitTermination()  # only the new file is read
    rows = sorted((r.merchant, r.amount) for r in ingest.read_ingested(spark, root).collect())
    assert rows == [("Metro", -3.5), ("Payroll", 2000.0)]

    ingest.ingest(spark, src, root).awaitTermination()  # nothing new: unchanged
    assert ingest.read_ingested(spark, root).count() == 2
